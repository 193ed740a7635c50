import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing as M

from .helpers import awkward, docs, prose


def brute(rows, weights, default, share, seed="mix-1"):
    """One queue per source, one document after the other."""
    draw = lambda i: hashlib.md5(f"{seed}|{'' if i is None else i}".encode()).hexdigest()
    items, total = [], 0
    for source in {s for _, _, s in rows}:
        clock = 0
        for d, i, t in sorted((draw(i), i, t) for i, t, s in rows if s == source):
            n = len((t or "").split())
            clock += n
            total += n
            items.append((clock / weights.get(source, default), d, i, n, source))
    out, spent = [], 0
    for f, d, i, n, s in sorted(items):
        if spent + n > int(total * share):
            break
        spent += n
        out.append((i, s, n, f))
    return out


def table(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, prose(i, r.choice([0, 1, 5, 30, 200])), "en", r.choice(["hot"] * 6 + ["a", "b", "c"])) for i in range(n)]
    return docs(spark, rows), [(i, t, s) for i, t, _, s in rows]


@pytest.mark.parametrize("share", [0.0, 0.001, 0.37, 0.8, 1.0])
def test_matches_queues_served_one_by_one(spark, share):
    df, rows = table(spark, 400)
    got = [tuple(x) for x in M.Mixture(df, {"hot": 3.0, "a": 0.5}, budget_share=share).schedule().collect()]
    assert got == brute(rows, {"hot": 3.0, "a": 0.5}, 1.0, share)


def test_narrowing_down_gives_the_same(spark, monkeypatch):
    df, rows = table(spark, 400)
    monkeypatch.setattr(M, "FEW", 3)
    monkeypatch.setattr(M, "BINS", 4)
    got = [tuple(x) for x in M.Mixture(df, {"hot": 3.0}, budget_share=0.5).schedule().collect()]
    assert got == brute(rows, {"hot": 3.0}, 1.0, 0.5)


def test_shares_follow_weights_while_no_source_is_dry(spark):
    df, _ = table(spark, 1500)
    got = M.Mixture(df, {"a": 2.0}, budget_share=0.2).schedule().groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    n = {x.source: x.n for x in got}
    assert n["a"] / n["b"] == pytest.approx(2, rel=0.2) and n["hot"] / n["b"] == pytest.approx(1, rel=0.2)


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("finish", F.lit("x")).withColumn("tokens", F.lit(1)).withColumn("row", F.lit(2))
    everything = M.Mixture(df, budget_share=1.0)
    assert everything.rows().columns == df.columns and everything.rows().count() == df.count()
    some = M.Mixture(df, budget_tokens=7)
    assert some.rows().count() == some.schedule().count()
    assert some.schedule().agg(F.sum("tokens")).first()[0] <= 7
    assert sorted(map(repr, some.rows().select("doc_id", "source").collect())) == sorted(map(repr, some.schedule().select("doc_id", "source").collect()))


def test_empty_and_bad_weights(spark):
    none = docs(spark, [])
    assert M.Mixture(none).schedule().count() == 0 and M.Mixture(none).rows().count() == 0
    with pytest.raises(ValueError):
        M.Mixture(none, {"a": 0.0}).schedule()
