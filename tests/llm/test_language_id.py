import math
import random

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import language_id as L
from foliospark.llm.textops import utf8

from .helpers import awkward, docs, prose


class PlainPPM:
    """One byte at a time, with dictionaries: method C, full exclusion."""

    def __init__(self, texts, order):
        self.order, self.seen = order, {}
        for t in texts:
            raw = b"\0" * order + t.encode()
            for i in range(order, len(raw)):
                for k in range(order + 1):
                    at = self.seen.setdefault((k, raw[i - k : i]), {})
                    at[raw[i]] = at.get(raw[i], 0) + 1

    def bits(self, text):
        raw, total = b"\0" * self.order + text.encode(), 0.0
        for i in range(self.order, len(raw)):
            out, cost = set(), 0.0
            for k in range(self.order, -1, -1):
                at = self.seen.get((k, raw[i - k : i]))
                if at is None:
                    continue
                live = {b: n for b, n in at.items() if b not in out}
                if raw[i] in live:
                    cost += math.log2((sum(live.values()) + len(live)) / live[raw[i]])
                    break
                if live:
                    cost += math.log2((sum(live.values()) + len(live)) / len(live))
                out |= set(at)
            else:
                cost += math.log2(256 - len(out))
            total += cost
        return total


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_code_lengths_match_a_byte_by_byte_coder(order):
    a, b = [prose(k, 40) for k in range(5)], [prose(k, 40, "thä önd ing ße zu".split()) for k in range(5)]
    model = L.Model.fit({"a": a, "b": b}, order)
    texts = [a[0], b[1][:50], "zzz unseen 123", "", prose(99, 30), "ä", "é" * 20]
    data, offsets, _ = utf8(pa.array(texts))
    got = model.lengths(data, offsets) / L.UNIT
    for c, sample in enumerate((a, b)):
        plain = PlainPPM(sample, order)
        for r, t in enumerate(texts):
            assert got[r, c] == pytest.approx(plain.bits(t), abs=0.001 * len(t.encode()) + 1e-9)


def test_long_texts_cost_the_same_in_pieces():
    model = L.Model.fit({"a": [prose(1, 500)]}, 3)
    text = prose(2, 200_000)
    data, offsets, _ = utf8(pa.array([text, "x"]))
    assert offsets[1] > 1 << 19
    keys = L.packed(data[: offsets[1]], np.zeros(1, np.int64), 3)
    assert model.lengths(data, offsets)[0, 0] == model.cost(keys).sum(dtype=np.int64)


def test_costs_grow_and_keep_what_they_hold():
    table = L.Costs(1, bits=2)
    keys = np.random.default_rng(0).choice(10**9, 500, replace=False).astype(np.uint64)
    for part in np.array_split(keys, 20):
        table.add(part, part.astype(np.int32)[:, None])
    at, hit = table.find(keys)
    assert hit.all() and (table.values[at, 0] == keys.astype(np.int32)).all()
    assert not table.find(keys + np.uint64(10**9))[1].any()


def test_held_out_accuracy_and_awkward_rows(spark):
    kinds = {"aa": "ba do ki lu".split(), "bb": "thä önd ing".split(), "cc": "ça où née".split()}
    r = random.Random(3)
    rows = [(i, prose(i, r.randint(5, 60), kinds[k]), k, "s") for i, k in enumerate(list(kinds) * 60)]
    df = docs(spark, rows)
    model = L.fit(df, per_language=20)
    found = {x.doc_id: x for x in L.identify(df, model).collect()}
    assert sum(found[i].language == k for i, _, k, _ in rows) / len(rows) > 0.98
    assert all(x.keep for x in found.values())
    odd = awkward(spark).withColumnRenamed("n_chars", "bits").withColumnRenamed("source", "keep")
    got = L.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert all(x.language is None and x.bits is None and not x.keep for x in got if x.doc_id in (3, 4, 5, 6))
    kept = L.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert kept.where("text is null or text = ''").count() == 0
    assert L.identify(docs(spark, [(1, "Привет мир " * 5, "ru", "s")]), model).first().keep is False


def test_empty_tables(spark):
    none = docs(spark, [])
    model = L.fit(none)
    assert model.languages == [] and L.identify(none, model).count() == 0
    unlabelled = docs(spark, [(1, "text", None, "s")])
    assert L.identify(unlabelled, L.fit(unlabelled)).first().keep is False


def test_a_repeated_key_counts_once_in_the_sample(spark, monkeypatch):
    seen = {}
    real = L.Model.fit
    monkeypatch.setattr(L.Model, "fit", staticmethod(lambda samples, order: seen.update(samples) or real(samples, order)))
    hot = spark.range(5000).selectExpr("1L as doc_id", "concat('text ', id) as text", "'en' as lang")
    more = spark.range(300).selectExpr("id + 10 as doc_id", "concat('more ', id) as text", "'en' as lang")
    L.fit(hot.unionByName(more), per_language=200)
    assert 190 <= len(seen["en"]) <= 200
    L.fit(hot.selectExpr("*", "'de' as lang", "'x' as Text"), per_language=3)
    assert {k: len(v) for k, v in seen.items()} == {"en": 1}
