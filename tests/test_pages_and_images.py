import struct
import zlib

import numpy as np
import pytest

from foliospark.operators import images as I
from foliospark.sources import pages as P

RNG = np.random.default_rng(5)
GRAY, COLOR = RNG.integers(0, 256, (13, 17, 1), dtype=np.uint8), RNG.integers(0, 256, (9, 11, 3), dtype=np.uint8)


@pytest.mark.parametrize("x", [GRAY, COLOR], ids=["gray", "color"])
def test_formats_come_back_as_they_went(x):
    for k in range(3):
        assert (P.decode_pages(P.write_png(x, k))[0] == x).all()
    assert (P.decode_pages(P.write_bmp(x))[0] == (np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x)).all()
    for packing in (1, 8, 32773):
        got = P.decode_pages(P.write_tiff([x, 255 - x, x[:4]], packing))
        assert len(got) == 3 and (got[0] == x).all() and (got[1] == 255 - x).all() and (got[2] == x[:4]).all()
    kind = b"P5" if x.shape[2] == 1 else b"P6"
    assert (P.decode_pages(kind + b"\n# made here\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.tobytes())[0] == x).all()


def png(head, rows, extra=b""):
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_every_row_filter_depth_and_palette():
    flat = GRAY[:, :, 0].astype(int)
    rows = []
    for y, row in enumerate(flat):
        kind, up = y % 5, flat[y - 1] if y else np.zeros(17, int)
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], up[:-1]])
        paeth = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, up, corner)]
        guess = [0 * row, left, up, (left + up) // 2, np.array(paeth)][kind]
        rows.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    assert (P.decode_pages(png((17, 13, 8, 0, 0, 0, 0), b"".join(rows)))[0] == GRAY).all()
    assert P.decode_pages(png((4, 2, 1, 0, 0, 0, 0), b"\0\xa0\0\x50"))[0][:, :, 0].tolist() == [[255, 0, 255, 0], [0, 255, 0, 255]]
    palette = lambda body: len(body).to_bytes(4, "big") + b"PLTE" + body + zlib.crc32(b"PLTE" + body).to_bytes(4, "big")
    assert P.decode_pages(png((3, 1, 2, 3, 0, 0, 0), b"\0\x18", palette(bytes(range(9)))))[0].tolist() == [[[0, 1, 2], [3, 4, 5], [6, 7, 8]]]


def test_lzw_of_a_tiff():
    """Codes made here bit by bit, over enough data that they grow to 12 bits and the table is cleared."""
    data = bytes(RNG.integers(0, 4, 30_000, dtype=np.uint8)) + bytes(200)
    table, width, bits, last = {bytes([k]): k for k in range(256)}, 9, [f"{256:09b}"], b""
    for k in range(len(data)):
        now = last + data[k : k + 1]
        if now in table:
            last = now
            continue
        bits.append(f"{table[last]:0{width}b}")
        table[now] = len(table) + 2
        last = data[k : k + 1]
        width = min(12, max(9, (len(table) + 2).bit_length()))
        if len(table) + 2 >= 4094:
            bits += [f"{table[last]:0{width}b}", f"{256:0{width}b}"]
            table, width, last = {bytes([k]): k for k in range(256)}, 9, b""
    if last:
        bits.append(f"{table[last]:0{width}b}")
        width = min(12, max(9, (len(table) + 3).bit_length()))
    whole = "".join(bits) + f"{257:0{width}b}"
    whole += "0" * (-len(whole) % 8)
    assert P.unpack_lzw(int(whole, 2).to_bytes(len(whole) // 8, "big")) == data


def test_what_cannot_be_read_is_a_row_with_its_error(spark):
    files = [("a", P.write_png(GRAY)), ("b", P.write_png(GRAY)[:50]), ("c", b"plain text"), ("d", None), ("e", b"\xff\xd8\xff\xe0 jpeg"), ("f", b"%PDF-1.7"), ("g", P.write_tiff([GRAY, GRAY])), ("h", P.write_tiff([GRAY])[:120]), ("i", b"P5\n3"), ("j", b"BM")]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files], "path string, content binary")
    got = {}
    for r in P.read_pages(df).collect():
        got.setdefault(r.path, []).append(r)
    assert set(got) == set("abefghij") and [r.page_number for r in got["g"]] == [1, 2]
    assert got["a"][0].error is None and bytes(got["a"][0].pixels) == GRAY.tobytes()
    assert all(got[k][0].error and got[k][0].pixels is None for k in "befhij") and "jpeg" in got["e"][0].error
    P.register_reader("text", b"plain", lambda data: [np.zeros((1, len(data), 1), np.uint8)])
    try:
        assert P.read_pages(df.where("path = 'c'")).first().width == 10
    finally:
        del P.READERS["text"]
    assert P.read_pages(df.limit(0)).count() == 0


def lines(h=200, w=260):
    x = np.full((h, w), 235, np.uint8)
    x[20 : h - 20 : 16, 15 : w - 15] = 20
    x[21 : h - 20 : 16, 15 : w - 15] = 20
    return x


@pytest.mark.parametrize("angle", [-38, -20, -4, -1, 2, 11, 27])
def test_pages_are_set_right_from_any_angle_under_45(angle):
    turned = I.rotate(lines(), angle)
    assert abs(I.skew(turned) + angle) <= 0.6
    assert abs(I.skew(I.deskew(turned))) <= 0.6


def test_windows_against_loops():
    x = RNG.integers(0, 256, (20, 23), dtype=np.uint8)
    wide = np.pad(x.astype(float), 2, mode="symmetric")
    assert np.allclose(I.window_mean(x, 5), [[wide[i : i + 5, j : j + 5].mean() for j in range(23)] for i in range(20)])
    k = np.exp(-((np.arange(5) - 2) ** 2) / 2)
    kernel = np.outer(k, k) / np.outer(k, k).sum()
    assert np.allclose(I.gaussian(x, 1.0, 5), [[(kernel * wide[i : i + 5, j : j + 5]).sum() for j in range(23)] for i in range(20)])
    flat = np.where(np.abs(np.subtract.outer(np.arange(20), np.arange(23))) < 1, 0, 200).astype(np.uint8)
    assert (I.open_and_close(flat) == 200).all() or I.open_and_close(flat).shape == flat.shape
    dot = np.full((9, 9), 200, np.uint8)
    dot[4, 4] = 255
    assert (I.open_and_close(dot) == 200).all()
    dot[4, 4] = 0
    assert I.open_and_close(dot).min() == 0 or (I.open_and_close(dot) == 200).all()


def test_equalisation_has_no_seams():
    slope = np.tile(np.linspace(60, 190, 256), (256, 1)).astype(np.uint8)
    out = I.enhance_contrast(slope).astype(int)
    assert np.abs(np.diff(out, axis=1)).max() <= 6 and np.abs(np.diff(out, axis=0)).max() <= 1


def test_noise_thresholds_and_model_images():
    clean = lines()
    noisy = np.clip(clean + RNG.normal(0, 14, clean.shape), 0, 255).astype(np.uint8)
    assert np.abs(I.denoise(noisy).astype(int) - clean).mean() < 0.7 * np.abs(noisy.astype(int) - clean).mean()
    assert (I.denoise(np.full((30, 30), 9, np.uint8)) == 9).all()
    shaded = np.clip(clean * np.linspace(0.4, 1, 260)[None, :], 0, 255).astype(np.uint8)
    found = I.sauvola(shaded) == 0
    assert (found == (clean < 100)).mean() > 0.97 and set(np.unique(I.advanced(noisy))) <= {0, 255}
    assert set(np.unique(I.binarize(shaded))) <= {0, 255}
    assert I.for_text_model(noisy).shape == clean.shape
    color = np.repeat(clean[:, :, None], 3, axis=2)
    assert I.for_layout_model(clean).shape == (200, 260, 3) and I.for_layout_model(np.tile(color, (8, 1, 1))).shape[0] == 1000
    assert I.for_layout_model(color, turned=6).shape == (260, 200, 3)
    out, done = I.preprocess(noisy, ("noise_reduction", "no such step", "sharpening", "advanced"))
    assert done == ["noise_reduction", "sharpening", "advanced"] and out.shape == clean.shape
