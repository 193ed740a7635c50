"""Media columns: FLAC streams to PCM blocks with seekable sample offsets.

Each frame's header (CRC-8) and whole (CRC-16) are verified before its samples are restored.
Subframes may be constant, verbatim, fixed or linear predictors of any order, with wasted
bits; residuals are Rice codes of 4- or 5-bit parameters with escapes; stereo may be
independent, left/side, right/side or mid/side. A partition's Rice codes are found by an automaton
that takes a byte a step; quotients, remainders and checksums are whole-array operations, and the
predictors of all frames of a batch are run side by side.

A row per frame: its first sample's offset, number of samples, and interleaved
little-endian PCM. A frame that fails its checks, or whose samples don't fit their depth, gives a
row with error and null PCM, and decoding goes on at the next frame header that verifies; its
offset is then the one that the header names. A stream that can't be read at all gives one row with
error. Null media give no row; an empty table gives none. Repeated rows and null keys are as they
are, each decoded by itself. Other columns make no difference, and their names may clash. A stream is
decoded whole, however long, and its frames leave the worker a few hundred at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.runtime import in_slices, only

SCHEMA = "media_id long, block int, sample_offset long, n_samples int, channels int, sample_rate int, bits int, pcm binary, error string"
FIELDS = ["media_id", "block", "sample_offset", "n_samples", "channels", "sample_rate", "bits", "pcm", "error"]


def _table(poly: int, width: int) -> list[int]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        v = byte << (width - 8)
        for _ in range(8):
            v = ((v << 1) ^ poly if v & top else v << 1) & mask
        out.append(v)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)
RATES = [0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000]
SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def crc8(data: bytes) -> int:
    v = 0
    for b in data:
        v = _CRC8[v ^ b]
    return v


@cache
def _crc16_by_place() -> np.ndarray:
    """(place, byte): what a byte with so many bytes after it adds to the checksum."""
    step = np.array(_CRC16, np.uint16)
    out = [step]
    for _ in range(1023):
        out.append((out[-1] << np.uint16(8)) ^ step[out[-1] >> np.uint16(8)])
    return np.stack(out)


def crc16(data: np.ndarray | bytes) -> int:
    raw, by_place, v = np.frombuffer(data, np.uint8), _crc16_by_place(), 0
    for a in range(0, len(raw), len(by_place)):
        part = raw[a : a + len(by_place)]
        if v:
            part = part.copy()
            part[0] ^= v >> 8
            if len(part) == 1:
                v = int(by_place[0, part[0]]) ^ (v & 255) << 8
                continue
            part[1] ^= v & 255
        v = int(np.bitwise_xor.reduce(by_place[np.arange(len(part) - 1, -1, -1), part]))
    return v


class FlacError(ValueError):
    pass


@cache
def _automaton(k: int) -> tuple[list[int], np.ndarray]:
    """Of Rice codes of parameter k. State: low bits still to pass over, times 256. Next state by state and byte; where unary parts end in the byte."""
    skip, byte = (x.ravel() for x in np.meshgrid(np.arange(k + 1), np.arange(256), indexing="ij"))
    stops = np.zeros(len(skip), np.uint8)
    for bit in range(7, -1, -1):
        unary, one = skip == 0, byte >> bit & 1 == 1
        stops |= ((unary & one) << bit).astype(np.uint8)
        skip = np.where(unary, np.where(one, k, 0), skip - 1)
    return (skip << 8).tolist(), stops


class Bits:
    """Fields of a byte string, most significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        a, b = self.at, self.at + n
        if b > self.size:
            raise FlacError("frame ends early")
        self.at = b
        return (int.from_bytes(self.data[a >> 3 : (b + 7) >> 3], "big") >> (-b & 7)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n

    def plain(self, n: int, width: int) -> np.ndarray:
        """n signed fields."""
        a, b = self.at, self.at + n * width
        if b > self.size:
            raise FlacError("frame ends early")
        self.at = b
        if not n or not width:
            return np.zeros(n, np.int64)
        raw = np.unpackbits(np.frombuffer(self.data, np.uint8, (b + 7 >> 3) - (a >> 3), a >> 3))[a & 7 :][: n * width].reshape(n, width)
        out = -raw[:, 0].astype(np.int64)
        for k in range(1, width):
            out = (out << 1) | raw[:, k]
        return out

    def rice(self, n: int, k: int) -> np.ndarray:
        """n signed Rice codes of parameter k."""
        if not n:
            return np.zeros(0, np.int64)
        step, marks = _automaton(k)
        first = begin = self.at >> 3
        state, states, found, have = 0, [], [], 0
        while have < n:
            end = min(len(self.data), begin + ((n - have) * (k + 2) >> 3) + 8)
            if begin == end:
                raise FlacError("frame ends early")
            part = self.data[begin:end]
            if begin == first:
                part = bytes([part[0] & 0xFF >> (self.at & 7)]) + part[1:]
            states = []
            for byte in part:
                states.append(state)
                state = step[state | byte]
            at = np.flatnonzero(np.unpackbits(marks[np.array(states) | np.frombuffer(part, np.uint8)])) + 8 * begin
            found.append(at)
            have += len(at)
            begin = end
        stop = (np.concatenate(found) if len(found) > 1 else found[0])[:n]
        end = int(stop[-1]) + 1 + k
        if end > self.size:
            raise FlacError("frame ends early")
        u = np.diff(stop, prepend=self.at - k - 1) - k - 1 << k
        if k:
            raw = np.unpackbits(np.frombuffer(self.data, np.uint8, (end + 7 >> 3) - first, first))
            low, place = np.zeros(n, np.int64), stop - 8 * first
            for i in range(1, k + 1):
                low = low << 1 | raw[place + i]
            u |= low
        self.at = end
        return (u >> 1) ^ -(u & 1)


def residual(bits: Bits, size: int, order: int) -> np.ndarray:
    method = bits.take(2)
    if method > 1:
        raise FlacError("reserved residual coding")
    width = 4 + method
    parts = bits.take(4)
    if size % (1 << parts) or (size >> parts) < order:
        raise FlacError("bad partition order")
    out = []
    for p in range(1 << parts):
        n = (size >> parts) - (order if p == 0 else 0)
        k = bits.take(width)
        out.append(bits.plain(n, bits.take(5)) if k == (1 << width) - 1 else bits.rice(n, k))
    return np.concatenate(out) if len(out) > 1 else out[0]


@dataclass
class Sub:
    """A subframe whose samples are still to be restored."""

    order: int
    depth: int
    wasted: int
    rest: np.ndarray
    warm: list[int]
    coefficients: list[int] | None = None
    shift: int = 0


def subframe(bits: Bits, size: int, depth: int) -> Sub:
    if bits.take(1):
        raise FlacError("bad subframe")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    depth -= wasted
    if depth < 1:
        raise FlacError("bad wasted bits")
    if kind == 0:
        return Sub(0, depth, wasted, np.full(size, bits.signed(depth), np.int64), [])
    if kind == 1:
        return Sub(0, depth, wasted, bits.plain(size, depth), [])
    if 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > size:
            raise FlacError("bad predictor")
        warm = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            return Sub(order, depth, wasted, residual(bits, size, order), warm)
        precision = bits.take(4) + 1
        shift = bits.signed(5)
        if precision == 16 or shift < 0:
            raise FlacError("bad predictor")
        coefficients = [bits.signed(precision) for _ in range(order)]
        return Sub(order, depth, wasted, residual(bits, size, order), warm, coefficients, shift)
    raise FlacError("reserved subframe")


def restore_fixed(warm: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Undo the differences of fixed predictors, a row each: one running sum for each order."""
    order = warm.shape[1]
    lead = [warm]
    for _ in range(order):
        lead.append(np.diff(lead[-1], axis=1))
    out = rest
    for k in range(order - 1, -1, -1):
        out = np.cumsum(out, axis=1) + lead[k][:, -1:]
    return np.concatenate([warm, out], axis=1)


def restore_lpc(warm: np.ndarray, rest: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Run linear predictors side by side, a row each. Whatever the residuals, there is a result: 64-bit integers wrap."""
    order, n = warm.shape[1], rest.shape[1]
    out = np.concatenate([warm, rest], axis=1).T.copy()
    backward = coefficients[:, ::-1].T.copy()
    for i in range(order, order + n):
        out[i] += (backward * out[i - order : i]).sum(axis=0) >> shift
    return out.T


def restore(subs: list[Sub]) -> list[np.ndarray | None]:
    """Samples of each subframe; None if they don't fit its depth."""
    kinds: dict[tuple, list[int]] = {}
    for k, s in enumerate(subs):
        kinds.setdefault((s.order, len(s.rest), s.coefficients is not None), []).append(k)
    out: list[np.ndarray | None] = [None] * len(subs)
    for (order, _, linear), at in kinds.items():
        x = np.stack([subs[k].rest for k in at])
        if order:
            warm = np.array([subs[k].warm for k in at], np.int64)
            x = restore_lpc(warm, x, np.array([subs[k].coefficients for k in at], np.int64), np.array([subs[k].shift for k in at], np.int64)) if linear else restore_fixed(warm, x)
        bound = np.left_shift(np.int64(1), np.array([subs[k].depth - 1 for k in at], np.int64))
        fits = (x.max(axis=1) < bound) & (x.min(axis=1) >= -bound)
        for r, k in enumerate(at):
            if fits[r]:
                out[k] = x[r] << subs[k].wasted
    return out


@dataclass
class Header:
    size: int
    rate: int
    assignment: int
    bits: int
    number: int
    variable: bool
    length: int

    @property
    def channels(self) -> int:
        return self.assignment + 1 if self.assignment < 8 else 2


def header(data: bytes, at: int, rate: int, depth: int) -> Header | None:
    """The frame header at a place, if there is one and its CRC-8 is right."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size_code, rate_code, assignment, depth_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if size_code == 0 or rate_code == 15 or assignment > 10 or depth_code == 3:
        return None
    p = at + 4
    lead = data[p]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and not 1 <= more <= 6:
        return None
    number = lead if lead < 0x80 else lead & (0x3F >> more)
    tail = data[p + 1 : p + 1 + more]
    if len(tail) < more or any(b & 0xC0 != 0x80 for b in tail):
        return None
    for b in tail:
        number = number << 6 | b & 0x3F
    p += 1 + more
    extra = {6: 1, 7: 2}.get(size_code, 0) + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if len(data) <= p + extra:
        return None
    if size_code == 1:
        size = 192
    elif size_code <= 5:
        size = 576 << (size_code - 2)
    elif size_code <= 7:
        n = size_code - 5
        size = int.from_bytes(data[p : p + n], "big") + 1
        p += n
    else:
        size = 256 << (size_code - 8)
    if rate_code and rate_code < 12:
        rate = RATES[rate_code]
    elif rate_code >= 12:
        n = 1 if rate_code == 12 else 2
        rate = int.from_bytes(data[p : p + n], "big") * {12: 1000, 13: 1, 14: 10}[rate_code]
        p += n
    if crc8(data[at:p]) != data[p]:
        return None
    return Header(size, rate, assignment, SIZES.get(depth_code, depth), number, bool(data[at + 1] & 1), p + 1 - at)


def parse_frame(data: bytes, at: int, h: Header) -> tuple[list[Sub], int]:
    """Subframes of the frame at a place, its checksum verified, and where it ends."""
    # A frame never takes more than its samples verbatim and some headers; escapes at most double it.
    most = at + h.length + h.channels * (h.size * (h.bits + 3) * 2 // 8 + 4096)
    bits = Bits(data[at + h.length : min(len(data), most)])
    found = [subframe(bits, h.size, h.bits + ((h.assignment, c) in ((8, 1), (9, 0), (10, 1)))) for c in range(h.channels)]
    end = at + h.length + (bits.at + 7) // 8
    if end + 2 > len(data) or crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise FlacError("frame checksum")
    return found, end + 2


def mixed_down(found: list[np.ndarray], assignment: int) -> np.ndarray:
    """Samples (sample, channel)."""
    if assignment == 8:
        found = [found[0], found[0] - found[1]]
    elif assignment == 9:
        found = [found[0] + found[1], found[1]]
    elif assignment == 10:
        mid = (found[0] << 1) | (found[1] & 1)
        found = [(mid + found[1]) >> 1, (mid - found[1]) >> 1]
    return np.stack(found, axis=1)


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    width = (bits + 7) // 8
    flat = np.ascontiguousarray(samples.astype("<i8")).view(np.uint8).reshape(-1, 8)
    return flat[:, :width].tobytes()


@dataclass
class Frame:
    """What a stream has at one place: subframes, or an error."""

    block: int
    offset: int
    header: Header | None
    subs: list[Sub]
    error: str | None = None


def frames(data: bytes) -> Iterator[Frame]:
    """The frames of a stream in order, with their checksums verified."""
    if data[:4] != b"fLaC":
        yield Frame(0, 0, None, [], "not a FLAC stream")
        return
    at, last, info = 4, False, None
    while not last:
        if len(data) < at + 4:
            yield Frame(0, 0, None, [], "metadata ends early")
            return
        last, kind, size = bool(data[at] >> 7), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
    if info is None or len(info) < 34:
        yield Frame(0, 0, None, [], "no stream info")
        return
    fixed = int.from_bytes(info[:2], "big")
    packed = int.from_bytes(info[10:18], "big")
    rate, depth = packed >> 44, (packed >> 36 & 31) + 1
    block, expected = 0, at
    while at < len(data):
        h = header(data, at, rate, depth)
        if h is None:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                break
            continue
        offset = h.number if h.variable else h.number * (fixed or h.size)
        if at != expected:
            yield Frame(block, offset, None, [], f"{at - expected} bytes skipped")
            block += 1
        try:
            subs, end = parse_frame(data, at, h)
            yield Frame(block, offset, h, subs)
            at = expected = end
        except FlacError as e:
            yield Frame(block, offset, h, [], str(e))
            at = expected = next((p for p in _syncs(data, at + 1) if header(data, p, rate, depth)), len(data))
        block += 1
    if expected < len(data):
        yield Frame(block, 0, None, [], f"{len(data) - expected} bytes skipped")
    elif not block:
        yield Frame(0, 0, None, [], "no frames")


def samples_of(found: list[Frame]) -> Iterator[tuple]:
    """(block, sample_offset, n_samples, channels, sample_rate, bits, pcm, error) for each frame, predictors run side by side."""
    restored = iter(restore([s for f in found for s in f.subs]))
    for f in found:
        h, error, pcm = f.header, f.error, None
        own = [next(restored) for _ in f.subs]
        if own and any(x is None for x in own):
            error = "samples out of range"
        elif own:
            pcm = pcm_bytes(mixed_down(own, h.assignment), h.bits)
        yield (f.block, f.offset, *((h.size, h.channels, h.rate, h.bits) if h else (0, 0, 0, 0)), pcm, error)


def decode(data: bytes) -> Iterator[tuple]:
    """The rows of samples_of() of one stream."""
    yield from samples_of(list(frames(data)))


def _syncs(data: bytes, at: int) -> Iterator[int]:
    at = data.find(b"\xff", at)
    while at >= 0:
        yield at
        at = data.find(b"\xff", at + 1)


AT_ONCE = 512


def decode_media(df: DataFrame, media: str = "media", key: str = "media_id") -> DataFrame:
    """A row for each frame of each stream."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if data.is_valid:
                    yield from ((k, f) for f in frames(data.as_py()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        samples = 0
        for pair in found(in_slices(batches)):
            held.append(pair)
            samples += pair[1].header.size * len(pair[1].subs) if pair[1].subs else 0
            if len(held) >= AT_ONCE or samples >= 1 << 21:
                yield _batch(held)
                held, samples = [], 0
        if held:
            yield _batch(held)

    return only(df, key=key, media=media).select(F.col("key").cast("long"), "media").mapInArrow(run, SCHEMA)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    rows = [(k, *r) for (k, _), r in zip(held, samples_of([f for _, f in held]))]
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], FIELDS)


def seek(blocks: DataFrame, start: int, count: int) -> DataFrame:
    """(media_id, sample_offset, n_samples, channels, bits, pcm) of the samples start..start+count of each stream, from the blocks of decode_media() that hold them.

    Only offsets are compared, so a store sorted by media_id and sample_offset is read where the samples lie.
    Blocks with errors hold none.
    """
    first, end = F.greatest("sample_offset", F.lit(start)), F.least(F.col("sample_offset") + F.col("n_samples"), F.lit(start + count))
    width = F.col("channels") * F.ceil(F.col("bits") / 8)
    cut = F.substring("pcm", ((first - F.col("sample_offset")) * width + 1).cast("int"), ((end - first) * width).cast("int"))
    return blocks.where(F.col("pcm").isNotNull() & (F.col("sample_offset") < start + count) & (F.col("sample_offset") + F.col("n_samples") > start)).select("media_id", first.alias("sample_offset"), (end - first).cast("int").alias("n_samples"), "channels", "bits", cut.alias("pcm"))


class Writer:
    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, width: int) -> None:
        if width:
            v = value & ((1 << width) - 1)
            self.parts.append(np.unpackbits(np.frombuffer(v.to_bytes((width + 7) // 8, "big"), np.uint8))[-width:])

    def rice(self, values: np.ndarray, k: int) -> None:
        u = (values << 1) ^ (values >> 63)
        q = u >> k
        starts = np.concatenate([[0], np.cumsum(q + 1 + k)])
        out = np.zeros(int(starts[-1]), np.uint8)
        stop = starts[:-1] + q
        out[stop] = 1
        for i in range(k):
            out[stop + 1 + i] = u >> (k - 1 - i) & 1
        self.parts.append(out)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes()


def _write_residual(w: Writer, rest: np.ndarray, size: int, order: int, parts: int, escape: bool) -> None:
    w.put(1, 2)
    w.put(parts, 4)
    at = 0
    for p in range(1 << parts):
        n = (size >> parts) - (order if p == 0 else 0)
        part = rest[at : at + n]
        at += n
        if escape:
            raw = max([1, *(int(abs(int(v))).bit_length() + 1 for v in part)])
            w.put(31, 5)
            w.put(raw, 5)
            for v in part:
                w.put(int(v), raw)
        else:
            mean = float(np.abs(part).mean()) if n else 0.0
            k = min(30, max(0, int(np.log2(mean + 1))))
            w.put(k, 5)
            w.rice(part, k)


def write_subframe(w: Writer, x: np.ndarray, depth: int, method: str, parts: int = 0, escape: bool = False, wasted: int = 0, coefficients: list[int] | None = None, shift: int = 0) -> None:
    order = len(coefficients) if coefficients else int(method[5:]) if method.startswith("fixed") else 0
    kind = {"constant": 0, "verbatim": 1}.get(method, 31 + order if coefficients else 8 + order)
    w.put(0, 1)
    w.put(kind, 6)
    w.put(1 if wasted else 0, 1)
    if wasted:
        w.put(1, wasted)
    x, depth = x >> wasted, depth - wasted
    if method == "constant":
        w.put(int(x[0]), depth)
    elif method == "verbatim":
        for v in x:
            w.put(int(v), depth)
    else:
        for v in x[:order]:
            w.put(int(v), depth)
        if coefficients:
            w.put(13, 4)  # 14-bit coefficients
            w.put(shift, 5)
            for c in coefficients:
                w.put(c, 14)
            guess = sum(c * x[order - 1 - i : len(x) - 1 - i] for i, c in enumerate(coefficients)) >> shift
            rest = x[order:] - guess
        else:
            rest = np.diff(x, n=order) if order else x
        _write_residual(w, rest, len(x), order, parts, escape)


def coded_number(n: int) -> bytes:
    """A frame number of up to 36 bits, as UTF-8 would write it if it went that far."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << 5 * k + 6)
    lead = 0xFF << 7 - more & 0xFF
    return bytes([lead | n >> 6 * more, *(0x80 | n >> 6 * k & 0x3F for k in range(more - 1, -1, -1))])


def encode(samples: np.ndarray, rate: int = 16000, bits: int = 16, block: int = 512, stereo: int | None = None, **options) -> bytes:
    """A FLAC stream of samples (sample, channel). stereo: 8, 9 or 10 for left/side, right/side, mid/side. Without a method, the fixed order of least residual."""
    n, channels = samples.shape
    samples = samples.astype(np.int64)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    out = [b"fLaC", bytes([0x80]), len(info).to_bytes(3, "big"), info]
    for number, at in enumerate(range(0, n, block)):
        part = samples[at : at + block]
        sides = [part[:, c] for c in range(channels)]
        if stereo == 8:
            sides[1] = sides[0] - sides[1]
        elif stereo == 9:
            sides[0] = sides[0] - sides[1]
        elif stereo == 10:
            sides = [(sides[0] + sides[1]) >> 1, sides[0] - sides[1]]
        code = next(k for k, v in SIZES.items() if v == bits)
        head = bytes([0xFF, 0xF8, 7 << 4, (stereo or channels - 1) << 4 | code << 1]) + coded_number(number) + (len(part) - 1).to_bytes(2, "big")
        w = Writer()
        for c, x in enumerate(sides):
            depth = bits + ((stereo, c) in ((8, 1), (9, 0), (10, 1)))
            own = dict(options)
            if "method" not in own:
                own["method"] = f"fixed{min(range(min(4, len(x) - 1) + 1), key=lambda k: int(np.abs(np.diff(x, n=k)).sum()))}"
            write_subframe(w, x, depth, **own)
        body = head + bytes([crc8(head)]) + w.bytes()
        out += [body, crc16(body).to_bytes(2, "big")]
    return b"".join(out)


#: Streams of media_of by vec_id: channel assignment, and order of its linear predictors (0: fixed ones).
VARIANTS = [(0, 0), (10, 3), (8, 0), (9, 8)]


def _difference(x: np.ndarray, assignment: int) -> np.ndarray:
    """(stream, channel, sample) as the assignment writes it."""
    if assignment < 8:
        return x
    left, right = x[:, 0], x[:, 1]
    side = left - right
    return np.stack({8: [left, side], 9: [side, right], 10: [left + right >> 1, side]}[assignment], axis=1)


def predictors(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear predictors of the rows by autocorrelation (Levinson-Durbin): 14-bit coefficients and shifts."""
    x = x.astype(np.float64)
    r = np.stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(axis=1) for k in range(order + 1)], axis=1)
    a, left = np.zeros((len(x), order)), r[:, 0] + 1e-9
    for k in range(order):
        turn = (r[:, k + 1] - (a[:, :k] * r[:, k:0:-1]).sum(axis=1)) / left
        a[:, :k], a[:, k] = a[:, :k] - turn[:, None] * a[:, :k][:, ::-1], turn
        left = np.maximum(left * (1 - turn * turn), 1e-9)
    shift = np.clip(np.floor(np.log2(8191 / np.maximum(np.abs(a).max(axis=1), 1e-3))), 0, 15).astype(np.int64)
    return np.clip(np.rint(a * 2.0 ** shift[:, None]), -8192, 8191).astype(np.int64), shift


def encode_many(x: np.ndarray, assignment: int, order: int, rate: int = 16000, bits: int = 16, block: int = 512) -> list[bytes]:
    """A FLAC stream for each of x (stream, channel, sample), all written side by side: linear predictors of the order, or with 0 the fixed ones of least residual."""
    streams, channels, n = x.shape
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    out = [[b"fLaC", bytes([0x80]), len(info).to_bytes(3, "big"), info] for _ in range(streams)]
    code = next(k for k, v in SIZES.items() if v == bits)
    depth = np.tile([bits + ((assignment, c) in ((8, 1), (9, 0), (10, 1))) for c in range(channels)], streams)
    for number, first in enumerate(range(0, n, block)):
        rows = _difference(x[:, :, first : first + block], assignment).reshape(streams * channels, -1)
        size = rows.shape[1]
        head = bytes([0xFF, 0xF8, 7 << 4, (assignment or channels - 1) << 4 | code << 1]) + coded_number(number) + (size - 1).to_bytes(2, "big")
        head += bytes([crc8(head)])
        linear = 0 < order < size
        if linear:
            taps, shift = predictors(rows, order)
            guess = sum(taps[:, k, None] * rows[:, order - 1 - k : size - 1 - k] for k in range(order)) >> shift[:, None]
            orders, rests = np.full(len(rows), order), {order: rows[:, order:] - guess}
        else:
            taps, shift = np.zeros((len(rows), 0), np.int64), np.zeros(len(rows), np.int64)
            rests = {k: np.diff(rows, n=k, axis=1) for k in range(min(4, size - 1) + 1)}
            orders = np.stack([np.abs(r).sum(axis=1) for r in rests.values()]).argmin(axis=0)
        total = np.zeros(len(rows), np.int64)
        todo = []
        for k in np.unique(orders):
            own = np.flatnonzero(orders == k)
            rest = rests[int(k)][own]
            low = np.clip(np.log2(np.abs(rest).mean(axis=1) + 1).astype(np.int64), 0, 30)
            u = (rest << 1) ^ (rest >> 63)
            ends = np.cumsum((u >> low[:, None]) + 1 + low[:, None], axis=1)
            lead = 8 + k * depth[own] + (9 + 14 * k if linear else 0) + 11
            total[own] = lead + ends[:, -1]
            todo.append((int(k), own, low, u, ends, lead))
        body = total.reshape(streams, channels)
        width = (8 * len(head) + body.sum(axis=1) + 7) // 8 + 2
        edges = np.concatenate([[0], np.cumsum(width)])
        start = ((8 * (edges[:-1] + len(head)))[:, None] + np.cumsum(body, axis=1) - body).ravel()
        raw = np.zeros(8 * int(edges[-1]), np.uint8)

        def put(at: np.ndarray, value: np.ndarray, length: int, raw: np.ndarray = raw) -> None:
            for i in range(length):
                raw[at + i] = value >> (length - 1 - i) & 1

        for k, own, low, u, ends, lead in todo:
            at = start[own]
            put(at, np.full(len(own), (31 + k if linear else 8 + k) << 1), 8)
            at = at + 8
            for deep in np.unique(depth[own]):
                those = depth[own] == deep
                for i in range(k):
                    put(at[those] + i * deep, rows[own[those], i], int(deep))
            at = at + k * depth[own]
            if linear:
                put(at, np.full(len(own), 13 << 5) | shift[own], 9)
                for i in range(k):
                    put(at + 9 + 14 * i, taps[own, i], 14)
            put(start[own] + lead - 11, 1 << 9 | low, 11)
            stop = (start[own] + lead)[:, None] + ends - 1 - low[:, None]
            raw[stop] = 1
            for i in range(int(low.max())):
                deep = low > i
                raw[stop[deep] + 1 + i] = u[deep] >> (low[deep, None] - 1 - i) & 1
        data = np.packbits(raw)
        for s in range(streams):
            whole = head + data[edges[s] + len(head) : edges[s + 1] - 2].tobytes()
            out[s] += [whole, crc16(whole).to_bytes(2, "big")]
    return [b"".join(parts) for parts in out]


def media_of(vectors: DataFrame, oversample: int = 16) -> DataFrame:
    """(media_id, media): each embedding as a FLAC stream, its values the corners of a 16-bit curve.

    By vec_id the streams are mono or stereo (the other channel runs backward), of every channel assignment, with fixed
    or linear predictors. Null vectors and empty ones: null media; null values and NaN count as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                out: list[bytes | None] = [None] * part.num_rows
                alike: dict[tuple, list[int]] = {}
                for r, (k, v) in enumerate(zip(part.column(0).to_pylist(), part.column(1))):
                    if v.is_valid and len(v):
                        alike.setdefault((len(v), (k or 0) % len(VARIANTS)), []).append(r)
                for (_, kind), own in alike.items():
                    assignment, order = VARIANTS[kind]
                    x = np.stack([signal(np.nan_to_num(part.column(1)[r].values.to_numpy(zero_copy_only=False).astype(float), posinf=0.0, neginf=0.0), oversample) for r in own])
                    x = np.stack([x, x[:, ::-1]], axis=1) if assignment else x[:, None]
                    for r, stream in zip(own, encode_many(x, assignment, order)):
                        out[r] = stream
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["media_id", "media"])

    return only(vectors, k="vec_id", v="embedding").select(F.col("k").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, "media_id long, media binary")


def signal(vector: np.ndarray, oversample: int = 16) -> np.ndarray:
    at = np.arange(len(vector) * oversample) / oversample
    return np.rint(np.clip(np.interp(at, np.arange(len(vector)), vector) * 8192, -32768, 32767)).astype(np.int64)
