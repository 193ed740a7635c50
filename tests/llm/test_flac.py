import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import flac as A

RNG = np.random.default_rng(4)
WAVE = np.clip(np.cumsum(RNG.integers(-200, 200, (1500, 2)), axis=0), -32768, 32767)


def pcm(frames, channels, width=2):
    raw = np.frombuffer(b"".join(f[6] for f in frames), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    v = out.view("<i8")[:, 0]
    return np.where(v >> (8 * width - 1), v - (1 << (8 * width)), v).reshape(-1, channels)


@pytest.mark.parametrize(
    "options",
    [{}, {"stereo": 8}, {"stereo": 9}, {"stereo": 10}, {"method": "verbatim"}, {"method": "fixed0"}, {"method": "fixed4", "parts": 2, "block": 300}, {"method": "fixed1", "escape": True}, {"method": "lpc", "coefficients": [3000, -1200, 100], "shift": 11}, {"method": "lpc", "coefficients": [2048], "shift": 11, "block": 1500}],
)
def test_round_trip(options):
    data = A.encode(WAVE, **options)
    frames = list(A.decode(data))
    assert all(f[-1] is None for f in frames)
    assert (pcm(frames, 2) == WAVE).all()
    assert [f[1] for f in frames] == list(np.cumsum([0, *(f[2] for f in frames[:-1])]))


@pytest.mark.parametrize("bits, width", [(8, 1), (24, 3)])
def test_depths_and_wasted_bits(bits, width):
    x = (RNG.integers(-(1 << (bits - 4)), 1 << (bits - 4), (700, 1)) << 2).astype(np.int64)
    assert (pcm(list(A.decode(A.encode(x, bits=bits, method="fixed1", wasted=2))), 1, width) == x).all()
    flat = np.full((600, 1), -5)
    assert (pcm(list(A.decode(A.encode(flat, bits=bits, method="constant"))), 1, width) == flat).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**20), 2**20), max_size=80), st.integers(0, 14))
def test_rice_codes_match_bit_by_bit_reading(values, k):
    w = A.Writer()
    w.put(5, 3)
    w.rice(np.array(values, np.int64), k)
    bits = A.Bits(w.bytes())
    bits.take(3)
    text, at, plain = "".join(f"{b:08b}" for b in w.bytes()), 3, []
    for _ in values:
        stop = text.index("1", at)
        u = (stop - at) << k | (int(text[stop + 1 : stop + 1 + k], 2) if k else 0)
        at = stop + 1 + k
        plain.append(u >> 1 if u % 2 == 0 else -(u + 1) // 2)
    assert bits.rice(len(values), k).tolist() == plain == values


def test_checksums_against_bitwise_division():
    def slow(data, poly, width):
        v = 0
        for byte in data:
            for k in range(7, -1, -1):
                top = (v >> (width - 1)) ^ (byte >> k & 1)
                v = (v << 1) & ((1 << width) - 1) ^ (poly if top else 0)
        return v

    data = bytes(RNG.integers(0, 256, 300, dtype=np.uint8))
    assert A.crc8(data) == slow(data, 0x07, 8) and A.crc16(data) == slow(data, 0x8005, 16)


def test_damage_is_reported_and_survived():
    good = A.encode(WAVE, block=500)
    want = {f[1]: f[6] for f in A.decode(good)}
    starts = [k for k in range(42, len(good)) if A.header(good, k, 16000, 16)]
    for at in (starts[1] + 100, starts[1] + 2, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 0x10
        frames = list(A.decode(bytes(bad)))
        assert any(f[-1] for f in frames)
        fine = [f for f in frames if f[-1] is None]
        assert len(fine) == 2 and all(want[f[1]] == f[6] for f in fine)
    for junk in (b"", b"fLaC", good[:30], good[:42], b"RIFF" + good):
        frames = list(A.decode(junk))
        assert len(frames) == 1 and frames[0][-1]
    assert list(A.decode(good[:-50]))[-1][-1]


@pytest.mark.parametrize("steep", [False, True])
def test_no_bit_of_damage_stops_the_decoder(steep):
    """Every bit of a linear predictor's stream flipped in turn, with a stable predictor and with one whose errors explode."""
    x = WAVE[:120, :1] if not steep else (WAVE[:120, :1] // 300)
    good = A.encode(x, block=60, method="lpc", coefficients=[8000, 8000, 8000] if steep else [3000, -1200, 100], shift=9 if steep else 11)
    want = {f[1]: f[6] for f in A.decode(good)}
    assert len(want) == 2 and all(want.values())
    for bit in range(8 * 42, 8 * len(good)):
        bad = bytearray(good)
        bad[bit >> 3] ^= 0x80 >> (bit & 7)
        got = list(A.decode(bytes(bad)))
        assert any(f[-1] for f in got)
        assert all(f[6] == want[f[1]] for f in got if f[-1] is None)


def test_a_right_checksum_over_samples_that_overflow_is_an_error():
    x = np.full((64, 1), 30000)
    good = bytearray(A.encode(x, block=64, method="lpc", coefficients=[8191, 8191], shift=0, bits=16))
    assert list(A.decode(bytes(good)))[0][-1] is None
    head = A.header(bytes(good), 42, 16000, 16)
    first = 42 + head.length + 1  # the first warm-up sample
    good[first : first + 2] = (12345).to_bytes(2, "big")
    good[-2:] = A.crc16(bytes(good[42:-2])).to_bytes(2, "big")
    got = list(A.decode(bytes(good)))
    assert got[0][-1] == "samples out of range" and got[0][6] is None


def test_predictors_side_by_side_against_one_sample_at_a_time():
    warm, rest = RNG.integers(-500, 500, (5, 4)), RNG.integers(-90, 90, (5, 70))
    taps, shift = RNG.integers(-1000, 1000, (5, 4)), RNG.integers(12, 15, 5)
    got = A.restore_lpc(warm, rest, taps, shift)
    for r in range(5):
        out = warm[r].tolist()
        for e in rest[r].tolist():
            out.append(e + (sum(int(c) * s for c, s in zip(taps[r], out[::-1])) >> int(shift[r])))
        assert got[r].tolist() == out


@pytest.mark.parametrize("assignment, order", [*A.VARIANTS, (1, 0), (0, 12)])
def test_streams_written_side_by_side(assignment, order):
    channels = 2 if assignment else 1
    x = np.clip(np.cumsum(RNG.integers(-400, 400, (7, channels, 1300)), axis=2), -32768, 32767)
    x[3] = 0
    x[4] = RNG.integers(-32768, 32767, x[4].shape)
    for want, data in zip(x, A.encode_many(x, assignment, order, block=500)):
        got = list(A.decode(data))
        assert [f[1] for f in got] == [0, 500, 1000] and all(f[-1] is None for f in got)
        assert (pcm(got, channels) == want.T).all()
        kinds = {s.coefficients is not None for f in A.frames(data) for s in f.subs}
        assert kinds == {order > 0}


def test_frame_numbers_of_any_length():
    for n in (0, 127, 128, 2047, 2048, 55_296, 57_343, 65_535, 65_536, 1_114_112, 2**31 - 1, 2**36 - 1):
        raw = A.coded_number(n)
        head = bytes([0xFF, 0xF8, 0x70, 0x08]) + raw + b"\x01\xff"
        assert A.header(head + bytes([A.crc8(head)]) + b"\0\0", 0, 16000, 16).number == n
        if n < 55_296:
            assert raw == chr(n).encode()


def test_seek(spark):
    x = np.clip(np.cumsum(RNG.integers(-200, 200, (1700, 2)), axis=0), -32768, 32767)
    blocks = A.decode_media(spark.createDataFrame([(1, bytearray(A.encode(x, block=500))), (2, bytearray(A.encode(x[:600, :1], block=100, method="fixed2")))], "media_id long, media binary"))
    for start, count in ((0, 10), (499, 2), (450, 700), (1690, 50), (5000, 3)):
        got = sorted(A.seek(blocks, start, count).collect(), key=lambda r: (r.media_id, r.sample_offset))
        for k, channels, whole in ((1, 2, x), (2, 1, x[:600, :1])):
            mine = [r for r in got if r.media_id == k]
            raw = np.frombuffer(b"".join(r.pcm for r in mine), "<i2").reshape(-1, channels)
            assert (raw == whole[start : start + count]).all()
            assert not mine or mine[0].sample_offset == start


def test_table(spark):
    vectors = spark.createDataFrame([(1, [0.5, -1.0, 9.0, 0.25]), (1, [0.5, -1.0, 9.0, 0.25]), (2, None), (3, []), (None, [0.0] * 700), (4, [None, 1.0])], "vec_id long, embedding array<float>")
    media = A.media_of(vectors.selectExpr("*", "1 as media", "2 as pcm"))
    got = A.decode_media(media.selectExpr("*", "'x' as error")).collect()
    assert sorted((x.media_id or 0, x.sample_offset, x.n_samples, x.error) for x in got)[:2] == [(0, 0, 512, None), (0, 512, 512, None)]
    one = [x for x in got if x.media_id == 1]
    wave = A.signal(np.array([0.5, -1.0, 9.0, 0.25]))
    assert len(one) == 2 and (np.frombuffer(one[0].pcm, "<i2").reshape(-1, 2) == np.stack([wave, wave[::-1]], axis=1)).all()
    assert {x.media_id for x in got} == {1, 4, None}
    clash = A.decode_media(media.selectExpr("*", "media as media", "'x' as MEDIA")).collect()
    assert sorted(map(repr, clash)) == sorted(map(repr, got))
    odd = spark.createDataFrame([(1, bytearray(b"nonsense")), (2, None)], "media_id long, media binary")
    assert [(x.media_id, x.error) for x in A.decode_media(odd).collect()] == [(1, "not a FLAC stream")]
    assert A.decode_media(odd.where("false")).count() == 0
