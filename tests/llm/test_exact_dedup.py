import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import exact_dedup as E
from foliospark.llm.exact_dedup import CuckooIndex, LiveTexts, exact_dedup

from .helpers import awkward, docs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(-50, 50)), max_size=300))
def test_index_is_a_set_that_may_say_yes_too_often(steps):
    index, live = CuckooIndex(1), set()
    for add, key in steps:
        if add:
            assert index.insert(key) == (key not in live)
            live.add(key)
        else:
            assert (index.delete(key) is not None) == (key in live)
            live.discard(key)
        assert len(index) == len(live) and all(map(index.contains, live))


def test_index_resizes_from_its_keys_and_rarely_errs():
    index, r = CuckooIndex(1), random.Random(1)
    keys = [r.getrandbits(64) for _ in range(20_000)]
    for k in keys:
        index.insert(k)
    assert index.resizes > 5 and all(map(index.contains, keys))
    for k in keys[:10_000]:
        index.delete(k)
    assert all(map(index.contains, keys[10_000:]))
    assert sum(index.contains(r.getrandbits(64)) for _ in range(20_000)) < 40


def test_equal_digests_of_different_texts_are_told_apart():
    live = LiveTexts()
    assert live.offer(7, "a", (2,), 0) is None and live.offer(7, "b", (1,), 1) is None
    assert live.offer(7, "a", (1,), 2) == 0 and live.offer(7, "b", (5,), 3) == 3
    assert live.withdraw(7, "a") and live.index.contains(7) and live.withdraw(7, "b") and not live.index.contains(7)
    assert live.offer(7, "a", (9,), 4) is None and not live.withdraw(7, "zz")


def brute(rows):
    best, out = {}, []
    for r in rows:
        if r.text is None:
            out.append(r)
        elif r.text not in best or (r.doc_id is None, r.doc_id) < (best[r.text].doc_id is None, best[r.text].doc_id):
            best[r.text] = r
    return sorted(((r.doc_id, r.text) for r in [*out, *best.values()]), key=repr)


def test_awkward_rows(spark):
    df = awkward(spark)
    got = exact_dedup(df)
    assert got.schema == df.schema
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == brute(df.collect())


def test_many_copies_over_partitions_and_clashing_columns(spark):
    r = random.Random(5)
    df = docs(spark, [(i, f"text {r.randint(0, 60)}" if i % 3 else "hot", "en", "s") for i in range(900)]).repartition(7)
    df = df.withColumn("digest", F.lit(1)).withColumn("row", F.lit("x")).withColumn("tie", F.rand(1))
    got = exact_dedup(df)
    assert got.columns == df.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == brute(df.collect())


@pytest.mark.parametrize("live, chars", [(1 << 18, 1 << 26), (5, 1 << 26), (1 << 18, 40), (1, 1)])
def test_a_partition_holds_no_more_than_its_limits(monkeypatch, live, chars):
    """Old digests leave the index; what its forgetting lets through the settling step drops, as digests that collide can't."""
    r, held = random.Random(3), []
    rows = [(k, r.choice([None, "", "hot", f"text {r.randint(0, 9)}", f"text {r.randint(0, 200)}"])) for k in range(600)]
    digest = lambda t, k: 10**6 + k if t is None else len(t) * 7 + sum(map(ord, t)) % 5
    columns = lambda part: (pa.array([t for _, t in part], pa.string()), pa.array([digest(t, k) for k, t in part], pa.int64()), pa.array([k for k, _ in part], pa.int64()), pa.array([k for k, _ in part], pa.int64()))
    real = CuckooIndex.delete
    monkeypatch.setattr(CuckooIndex, "delete", lambda self, key: held.append(len(self)) or real(self, key))
    stay = [x for part in E._combine((columns(rows[a : a + 37]) for a in range(0, 600, 37)), live, chars) for x in part]
    assert not held or max(held) <= live + 1
    order = sorted((x for x, ok in zip(rows, stay) if ok), key=lambda x: (digest(x[1], x[0]), x[0]))
    for size in (1, 2, 11):
        final = [x for part in E._drop_sorted(columns(order[a : a + size])[:2] for a in range(0, len(order), size)) for x in part]
        first = {}
        for k, t in rows:
            first.setdefault(t if t is not None else k, (k, t))
        assert sorted((x for x, ok in zip(order, final) if ok), key=repr) == sorted(first.values(), key=repr)


def test_a_name_that_occurs_twice(spark):
    df = docs(spark, [(1, "a", "en", "s"), (2, "a", "de", "t"), (3, "b", "en", "u")]).select("*", F.lit("x").alias("text"), F.lit("y").alias("Text"))
    got = exact_dedup(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "a", "en", "s", 1, "x", "y"), (3, "b", "en", "u", 1, "x", "y")]


def test_empty(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
