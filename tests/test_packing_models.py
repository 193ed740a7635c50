"""Folds and groupings against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import splitters as S
from foliospark.operators import engines as E
from foliospark.operators import layout as L
from foliospark.operators import packing as P
from foliospark.operators import tables as T


def greedy(texts, size, overlap, minimum):
    """(kind, places) of each chunk."""
    strip = [len(t.strip(" ")) for t in texts]
    joined = lambda ids: sum(strip[i] for i in ids) + len(ids) - 1
    everything = list(range(len(texts)))
    if joined(everything) <= size:
        return [("whole", everything)]
    out, held, length = [], [], 0
    for i in everything:
        if held and length + strip[i] > size:
            out.append(("split", held))
            tail, chars = [], 0
            if overlap > 0:
                for j in reversed(held):
                    if chars + len(texts[j]) > overlap:
                        break
                    tail.insert(0, j)
                    chars += len(texts[j])
            held = [*tail, i]
            length = chars + len(texts[i]) if overlap > 0 else strip[i]
        else:
            held = [*held, i]
            length += strip[i]
    return out + ([("final", held)] if joined(held) >= minimum else [])


@pytest.mark.parametrize("size, overlap, minimum", [(60, 25, 10), (60, 0, 30), (100, 100, 0), (10, 5, 50)])
def test_pack_matches_plain_python(spark, size, overlap, minimum):
    r = random.Random(size + overlap)
    groups = {g: [" " * r.randint(0, 2) + "x" * r.randint(1, 40) for _ in range(r.randint(1, 25))] for g in range(60)}
    rows = [(g, k, t) for g, ts in groups.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "g long, k int, text string")
    packed = P.pack(P.collect_items(df, ["g"], F.col("k"), ["text"]), size, overlap, minimum)
    got = {}
    for x in packed.select("g", "chunk_no", "kind", F.transform("items", lambda i: i["pos"]).alias("p")).orderBy("g", "chunk_no").collect():
        got.setdefault(x.g, []).append((x.kind, x.p))
    want = {g: chunks for g, ts in groups.items() if (chunks := greedy(ts, size, overlap, minimum))}
    assert got == want
    for g, chunks in got.items():
        seen = [i for _, c in chunks for i in c]
        assert all(c == list(range(c[0], c[-1] + 1)) for _, c in chunks)
        if minimum == 0:
            assert set(seen) == set(range(len(groups[g])))


def mixed(rows, size, overlap, variance):
    out, held = [], []
    for i, (t, c) in enumerate(rows):
        cs = [rows[j][1] for j in held]
        every = [*cs, c]
        mean = sum(every) / len(every)
        spread = sum((v - mean) ** 2 for v in every) / len(every)
        if held and (spread > variance or sum(len(rows[j][0]) for j in held) + len(t) > size or abs(c - sum(cs) / len(cs)) > 0.3):
            out.append(held)
            tail, chars = [], 0
            for j in reversed(held):
                if overlap <= 0 or chars + len(rows[j][0]) > overlap:
                    break
                tail.insert(0, j)
                chars += len(rows[j][0])
            held = [*tail, i]
        else:
            held = [*held, i]
    return [*out, held]


@pytest.mark.parametrize("overlap", [0, 30])
def test_mixed_pack_matches_plain_python(spark, overlap):
    r = random.Random(overlap)
    groups = {g: [("x" * r.randint(1, 30), r.randint(300, 999) / 1000) for _ in range(r.randint(1, 20))] for g in range(50)}
    df = spark.createDataFrame([(g, k, t, c) for g, rs in groups.items() for k, (t, c) in enumerate(rs)], "g long, k int, text string, confidence double")
    packed = P.pack_mixed(P.collect_items(df, ["g"], F.col("k"), ["text", "confidence"]), 80, overlap, 0.02)
    got = {}
    for x in packed.select("g", F.transform("items", lambda i: i["pos"]).alias("p")).orderBy("g", "chunk_no").collect():
        got.setdefault(x.g, []).append(x.p)
    assert got == {g: mixed(rs, 80, overlap, 0.02) for g, rs in groups.items()}


def columns_of(regions, tolerance=50):
    keys = {}
    for i, x1, y1, x2 in regions:
        c = (x1 + x2) / 2
        key = next((k for k in keys if abs(c - k) <= tolerance), c)
        keys.setdefault(key, []).append((i, x1, y1))
    cols = [keys[k] for k in sorted(keys) if len(keys[k]) >= 2]
    if len(cols) > 1:
        return [i for col in cols for i, _, _ in sorted(col, key=lambda r: r[2])]
    return [i for i, _, y1, _ in sorted(((i, x1, y1, x2) for i, x1, y1, x2 in regions), key=lambda r: (r[2], r[1]))]


def test_column_order_matches_plain_python(spark):
    r = random.Random(4)
    pages = {d: [(k, float(x := r.choice([50, 60, 350, 360, 700])), float(r.randint(0, 20) * 40), float(x + r.choice([100, 180, 240]))) for k in range(r.randint(1, 14))] for d in range(60)}
    df = spark.createDataFrame([(str(k), d, 1, k, x1, y1, x2) for d, rs in pages.items() for k, x1, y1, x2 in rs], "region_id string, doc_id long, page_number int, line_no int, x1 double, y1 double, x2 double")
    got = {}
    for x in L.column_reading_order(df).orderBy("doc_id", "column_order").collect():
        got.setdefault(x.doc_id, []).append(int(x.region_id))
    assert got == {d: columns_of(rs) for d, rs in pages.items()}


def bio(tokens):
    out, text, conf, label, first = [], [], None, None, None

    def close():
        if text:
            out.append((first, " ".join(text).replace(" ##", ""), conf, label))

    for k, (w, l, c) in enumerate(tokens):
        if w in ("[CLS]", "[SEP]", "[PAD]"):
            continue
        if l.startswith("B-"):
            close()
            text, conf, label, first = [w], c, l[2:], k
        elif l.startswith("I-") and label == l[2:]:
            text.append(w)
            conf = min(conf, c)
        else:
            close()
            text, label = [], None
            if l == "O" and w.strip():
                out.append((k, w, c, None))
    close()
    return sorted(out)


def test_token_entities_match_plain_python(spark):
    r = random.Random(6)
    labels = ["O", "B-HEADER", "I-HEADER", "B-LIST", "I-LIST", "I-TABLE"]
    docs = {d: [(r.choice(["word", "##piece", "[SEP]", "other"]), r.choice(labels), r.randint(1, 999) / 1000) for _ in range(r.randint(1, 30))] for d in range(60)}
    df = spark.createDataFrame([(d, k, w, l, c, 0.0, 0.0, 1.0, 1.0) for d, ts in docs.items() for k, (w, l, c) in enumerate(ts)], "doc_id long, pos int, word string, label string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for x in E.decode_bio(df).orderBy("doc_id", "first_pos").collect():
        got.setdefault(x.doc_id, []).append((x.first_pos, x.text, x.confidence))
    assert got == {d: [t[:3] for t in b] for d, ts in docs.items() if (b := bio(ts))}


def test_splitters():
    text = "One sentence here. Another one follows! A third? " * 30 + "\n\n" + "word " * 200
    for name in ("recursive", "sentence"):
        pieces = S.SPLITTERS[name](text, 120, 30)
        assert all(pieces) and (name == "sentence" or max(map(len, pieces)) <= 120)
    assert S.recursive_split("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    assert S.semantic_split("") == [] and S.semantic_split("Only one.") == ["Only one."]
    assert " ".join(S.semantic_split(text)).split() == text.split()


def test_grid_keeps_the_last_cell_and_leaves_gaps(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a", 0.0, 0.0, 1.0, 1.0), (1, 0, 0, "b", 0.0, 0.0, 1.0, 1.0), (1, 1, 2, "z", 2.0, 1.0, 3.0, 2.0)], "t long, row int, col int, text string, x1 double, y1 double, x2 double, y2 double").withColumn("k", F.monotonically_increasing_id())
    got = T.grid_text(cells, ["t"], ["k"]).first()
    assert got.table_text == "b |  | \n |  | z" and (got.rows, got.columns) == (2, 3)


def test_a_page_that_fails_is_a_row(spark):
    class Source(E.RegionSource):
        def read(self, page):
            if page["page_number"] == 2:
                raise ValueError("no image")
            return [{"text": "t", "confidence": 0.5, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}]

    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_number int")
    got = {x.page_number: (x.text, x.error) for x in E.recognize(pages, Source).collect()}
    assert got == {1: ("t", None), 2: (None, "ValueError: no image")}


def test_engine_registry_and_presets(spark):
    with pytest.raises(ValueError):
        E.create("nobody")
    assert E.create("precomputed").available()
    assert E.preset("forms", "quality", cloud=True)["engines"][0] == "aws_textract" and "aws_textract" not in E.preset("forms", "quality")["engines"]
    assert E.normalize_config("easyocr", confidence=0.5) == [{"confidence": 0.5, "engine": "easyocr"}] and len(E.normalize_config(["a", {"engine": "b"}])) == 2
    assert dict(E.status(spark).collect())["precomputed"]
