"""Files to page images: PNG, TIFF of many pages, BMP and PNM by NumPy alone; other formats by a reader that is registered for them.

A page is a row: path, page_number from 1, height, width, channels (1 or 3), its pixels row by row, and error.
A file that can't be read gives one row with the error and no pixels; a file of no known type gives none.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = "path string, page_number int, height int, width int, channels int, pixels binary, error string"
PAGES_ARROW = pa.schema([("path", pa.string()), *[(c, pa.int32()) for c in ("page_number", "height", "width", "channels")], ("pixels", pa.binary()), ("error", pa.string())])


class ImageError(ValueError):
    pass


def _samples(raw: bytes, width: int, height: int, per_pixel: int, depth: int) -> np.ndarray:
    """(height, width, per_pixel) of packed rows, each from a whole byte on; 16-bit samples by their high byte."""
    stride = (width * per_pixel * depth + 7) // 8
    if len(raw) < stride * height:
        raise ImageError("image data ends early")
    rows = np.frombuffer(raw, np.uint8, stride * height).reshape(height, stride)
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * per_pixel * depth].reshape(height, -1, depth)
        rows = np.packbits(np.pad(bits, ((0, 0), (0, 0), (8 - depth, 0))), axis=2)[:, :, 0]
    return rows[:, : width * per_pixel].reshape(height, width, per_pixel)


def _to_full_range(x: np.ndarray, depth: int) -> np.ndarray:
    return x * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else x


def _unfilter(raw: bytes, width: int, height: int, per_pixel: int, depth: int) -> bytes:
    """Undo PNG's row filters."""
    step, stride = max(1, per_pixel * depth // 8), (width * per_pixel * depth + 7) // 8
    if len(raw) < (stride + 1) * height:
        raise ImageError("image data ends early")
    data = np.frombuffer(raw, np.uint8, (stride + 1) * height).reshape(height, stride + 1)
    above, out = np.zeros(stride, np.uint8), np.empty((height, stride), np.uint8)
    for y in range(height):
        kind, row = data[y, 0], data[y, 1:].copy()
        if kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            now, up = row.tolist(), above.tolist()
            for i in range(stride):
                left, corner = (now[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
                now[i] = (now[i] + guess) & 255
            row = np.array(now, np.uint8)
        elif kind:
            raise ImageError("bad row filter")
        out[y] = above = row
    return out.tobytes()


def read_png(data: bytes) -> list[np.ndarray]:
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or zlib.crc32(kind + part) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ImageError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not body:
        raise ImageError("no image data")
    width, height, depth, color, _, _, interlaced = head
    per_pixel = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if per_pixel is None or interlaced:
        raise ImageError("interlaced images aren't read" if interlaced else "bad color type")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ImageError("damaged image data") from e
    x = _samples(_unfilter(raw, width, height, per_pixel, depth), width, height, per_pixel, depth)
    if color == 3:
        if palette is None or x.max(initial=0) >= len(palette):
            raise ImageError("bad palette")
        return [palette[x[:, :, 0]]]
    return [_to_full_range(x[:, :, : 3 if per_pixel > 2 else 1], depth)]


def read_bmp(data: bytes) -> list[np.ndarray]:
    if len(data) < 54:
        raise ImageError("image data ends early")
    start, size, width, height, _, depth, packing = struct.unpack("<IIiiHHI", data[10:34])
    if packing or depth not in (8, 24, 32) or width <= 0 or not height:
        raise ImageError("packed or unusual bitmap")
    stride = (width * depth // 8 + 3) // 4 * 4
    if len(data) < start + stride * abs(height):
        raise ImageError("image data ends early")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * depth // 8].reshape(abs(height), width, -1)
    rows = rows if height < 0 else rows[::-1]
    if depth == 8:
        colors = np.frombuffer(data[14 + size : start], np.uint8).reshape(-1, 4)
        rows = colors[rows[:, :, 0]]
    return [rows[:, :, 2::-1]]


def read_pnm(data: bytes) -> list[np.ndarray]:
    fields: list[bytes] = []
    at = 2
    while len(fields) < (2 if data[1:2] == b"4" else 3):
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if at == end or not data[at:end].isdigit():
            raise ImageError("bad header")
        fields.append(data[at:end])
        at = end
    width, height = int(fields[0]), int(fields[1])
    if data[1:2] == b"4":
        return [255 * (1 - _samples(data[at + 1 :], width, height, 1, 1))]
    return [_samples(data[at + 1 :], width, height, 1 if data[1:2] == b"5" else 3, 16 if int(fields[2]) > 255 else 8)]


def unpack_bits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, a code longer one entry early."""
    table, out, last, width, at = [bytes([k]) for k in range(256)] + [b"", b""], [], b"", 9, 0
    while at + width <= 8 * len(data):
        chunk = int.from_bytes(data[at >> 3 : (at + width + 7) >> 3], "big")
        code = chunk >> (-(at + width) & 7) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            del table[258:]
            last, width = b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ImageError("damaged image data")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def read_tiff(data: bytes) -> list[np.ndarray]:
    order = "<" if data[:2] == b"II" else ">"
    sizes = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
    at, seen, pages = struct.unpack(order + "I", data[4:8])[0], set(), []

    def values(kind: int, n: int, field: bytes) -> list[int]:
        if kind not in sizes:
            return []
        code, size = sizes[kind]
        raw = field[: n * size] if n * size <= 4 else data[(p := struct.unpack(order + "I", field)[0]) : p + n * size]
        if len(raw) < n * size:
            raise ImageError("directory ends early")
        return list(struct.unpack(f"{order}{n}{code}", raw))

    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise ImageError("directory ends early")
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        if at + 6 + 12 * n > len(data):
            raise ImageError("directory ends early")
        tags = {}
        for k in range(n):
            tag, kind, many = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            tags[tag] = values(kind, many, data[at + 10 + 12 * k : at + 14 + 12 * k])
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
        one = lambda tag, other=None: (tags.get(tag) or [other])[0]  # noqa: E731, B023
        width, height, depth, packing, per_pixel = one(256), one(257), one(258, 1), one(259, 1), one(277, 1)
        if not width or not height or 273 not in tags or per_pixel not in (1, 3, 4) or depth not in (1, 2, 4, 8, 16) or one(284, 1) != 1:
            raise ImageError("unusual layout")
        strips = []
        for start, size in zip(tags[273], tags.get(279) or [len(data)]):
            part = data[start : start + size]
            if packing in (8, 32946):
                try:
                    part = zlib.decompress(part)
                except zlib.error as e:
                    raise ImageError("damaged image data") from e
            elif packing in (5, 32773):
                part = unpack_lzw(part) if packing == 5 else unpack_bits(part)
            elif packing != 1:
                raise ImageError(f"compression {packing} isn't read")
            strips.append(part)
        x = _samples(b"".join(strips), width, height, per_pixel, depth)
        if depth == 16 and order == "<":
            raise ImageError("16-bit samples of this byte order aren't read")
        if one(317, 1) == 2:
            x = np.cumsum(x, axis=1, dtype=np.uint8)
        x = _to_full_range(x[:, :, : 3 if per_pixel > 1 else 1], depth)
        pages.append(255 - x if one(262, 1) == 0 else x)
    if not pages:
        raise ImageError("no pages")
    return pages


READERS: dict[str, tuple[bytes, Callable[[bytes], list[np.ndarray]]]] = {
    "png": (b"\x89PNG\r\n\x1a\n", read_png), "bmp": (b"BM", read_bmp), "pbm": (b"P4", read_pnm), "pgm": (b"P5", read_pnm), "ppm": (b"P6", read_pnm), "tiff": (b"II*\0", read_tiff), "tiff_big_endian": (b"MM\0*", read_tiff),
}
#: Formats that need a library, by how they begin: a reader for one goes to register_reader().
KNOWN = {"jpeg": b"\xff\xd8\xff", "pdf": b"%PDF"}


def register_reader(name: str, begins: bytes, read: Callable[[bytes], list[np.ndarray]]) -> None:
    """read gives the pages of a file as 8-bit arrays (height, width, channels)."""
    READERS[name] = (begins, read)


def decode_pages(data: bytes, readers: dict | None = None) -> list[np.ndarray]:
    """Pages of a file by how it begins; none for a file of no known type."""
    for begins, read in (READERS if readers is None else readers).values():
        if data.startswith(begins):
            return read(data)
    for name, begins in KNOWN.items():
        if data.startswith(begins):
            raise ImageError(f"no reader for {name}")
    return []


def read_pages(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Pages of (path, content). A damaged file is a row with its error; null content gives none."""
    readers = dict(READERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                if not batch.column(1)[at].is_valid:
                    continue
                name, rows = batch.column(0)[at].as_py(), []
                try:
                    for k, x in enumerate(decode_pages(batch.column(1)[at].as_py(), readers)):
                        rows.append({"path": name, "page_number": k + 1, "height": x.shape[0], "width": x.shape[1], "channels": x.shape[2], "pixels": np.ascontiguousarray(x).tobytes()})
                except (ValueError, IndexError, struct.error) as e:  # a file that can't be read is a result, not the end of the job
                    rows = [{"path": name, "error": str(e) or type(e).__name__}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, PAGES_ARROW)

    return files.select(F.col(path).cast("string"), F.col(content)).mapInArrow(run, PAGES)


def write_png(x: np.ndarray, row_filter: int = 0) -> bytes:
    """An 8-bit image (height, width, 1 or 3), its rows stored by differences of the kind."""
    h, w, c = x.shape
    flat = x.reshape(h, w * c)
    if row_filter == 1:
        flat = flat - np.pad(flat, ((0, 0), (c, 0)))[:, : w * c]
    elif row_filter == 2:
        flat = flat - np.pad(flat, ((1, 0), (0, 0)))[:h]
    raw = np.concatenate([np.full((h, 1), row_filter, np.uint8), flat], axis=1).tobytes()
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return READERS["png"][0] + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if c == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_bmp(x: np.ndarray) -> bytes:
    h, w = x.shape[:2]
    rows = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, ::-1]
    body = np.pad(rows.reshape(h, 3 * w), ((0, 0), (0, -3 * w % 4)))[::-1].tobytes()
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def write_tiff(pages: list[np.ndarray], packing: int = 1) -> bytes:
    """Gray or color pages, plain (1), by PackBits (32773) or deflated (8)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for x in pages:
        h, w, c = x.shape
        raw = x.tobytes()
        if packing == 8:
            raw = zlib.compress(raw)
        elif packing == 32773:
            raw = b"".join(bytes([len(p) - 1]) + p for p in (raw[a : a + 128] for a in range(0, len(raw), 128)))
        start = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, packing), (262, 3, 1 if c == 1 else 2), (273, 4, start), (277, 3, c), (278, 4, h), (279, 4, len(raw))]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)
