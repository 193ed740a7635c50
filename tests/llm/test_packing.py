import random
import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import catalog
from foliospark.llm import packing as P
from foliospark.llm.runtime import word_count
from foliospark.llm.textops import utf8

from .helpers import awkward, docs, prose


def brute(sizes, sources, clusters, capacity):
    """Every bin looked at for every piece."""
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and s not in b["s"] and c not in b["c"]]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= size
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 4), st.integers(0, 6)), max_size=60))
def test_best_fit_matches_brute_force(pieces):
    pieces.sort(key=lambda p: -p[0])
    sizes, sources, clusters = (list(x) for x in zip(*pieces)) if pieces else ([], [], [])
    assert P.best_fit(sizes, sources, clusters, 20) == brute(sizes, sources, clusters, 20)


def check(rows, got, capacity, clusters):
    tokens = {i: len((t or "").split()) for i, t, _ in rows}
    at, bins = defaultdict(list), defaultdict(list)
    for x in got:
        at[x.doc_id].append(x)
        bins[x.bin_id].append(x)
    assert {i: sum(x.tokens for x in xs) for i, xs in at.items()} == {i: n for i, n in tokens.items() if n}
    for xs in at.values():
        assert sorted(x.piece for x in xs) == list(range(len(xs)))
    for xs in bins.values():
        xs.sort(key=lambda x: x.bin_offset)
        assert xs[0].bin_offset == 0 and all(a.bin_offset + a.tokens == b.bin_offset for a, b in zip(xs, xs[1:]))
        assert xs[-1].bin_offset + xs[-1].tokens <= capacity
        assert len({x.source for x in xs}) == len(xs) == len({clusters[x.doc_id] for x in xs})


def test_tokens_and_clusters_of_whole_batches(spark):
    r = random.Random(2)
    texts = ["", " ", "a", "\u00c9t\u00e9 \u00e9T\u00c9\u00a0x", " a\tb\x0b\nc\r ", "ab c", "a bc", "abc", "AB C\n", prose(1, 300_000), *("".join(r.choice("aB \n\u00e4") for _ in range(r.randint(0, 12))) for _ in range(300)), ""]
    data, offsets, _ = utf8(pa.array(texts))
    want = [x.n for x in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()]
    assert P.tokens_of(data, offsets).tolist() == want == [len(re.findall(r"[^ \t\n\x0b\f\r]+", t)) for t in texts]
    marks = P.clusters_of(*utf8(pc.utf8_lower(pa.array(texts)))[:2]).tolist()
    plain = [re.sub(r"[ \t\n\x0b\f\r]", "", t.lower()) for t in texts]
    assert len(set(marks)) == len(set(plain)) == len(set(zip(marks, plain)))


def test_constraints_over_shards(spark):
    r = random.Random(4)
    rows = [(i, prose(i % 150, r.randint(1, 90)), r.choice("aaabcdef")) for i in range(400)]
    got = P.pack(docs(spark, [(i, t, "en", s) for i, t, s in rows]), capacity=64, shard=100).collect()
    check(rows, got, 64, {i: t.lower().replace(" ", "") for i, t, _ in rows})
    assert len({x.bin_id >> P.BIN_BITS for x in got}) > 1


def test_same_result_in_any_order_and_known_clusters(spark):
    rows = [(i, prose(i, 5 + i % 20), "en", f"s{i % 7}") for i in range(120)]
    a = P.pack(docs(spark, rows), capacity=64).collect()
    b = P.pack(docs(spark, rows[::-1]).repartition(5), capacity=64).collect()
    assert sorted(a) == sorted(b)
    one = P.pack(docs(spark, rows).withColumn("group", F.lit("g")), capacity=64, cluster="group")
    assert one.select("bin_id").distinct().count() == 120


def test_near_copies_never_share_a_bin(spark, tmp_path):
    rows = []
    for g in range(12):
        w = prose(g, 40).split()
        rows += [(10 * g + k, " ".join([*w[: 3 * k], "zig", *w[3 * k :]]), "en", f"s{g}-{k}") for k in range(4)]
    docs(spark, [*rows, (None, rows[0][1], "en", "x")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op8_bestfit_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 1
    bins = defaultdict(list)
    for x in got:
        if x.doc_id is not None:
            bins[x.bin_id].append(x.doc_id // 10)
    assert all(len(set(groups)) == len(groups) for groups in bins.values())
    assert len(bins) < len(rows)


def test_leftovers_of_shards_are_packed_together(spark, monkeypatch):
    """Sources of one shard's leftovers differ from another's, so that only packing across shards fills their bins."""
    r = random.Random(6)
    rows = [(i, prose(i, r.randint(2, 12)), f"s{r.randint(0, 30)}") for i in range(600)]
    df = docs(spark, [(i, t, "en", s) for i, t, s in rows])
    clusters = {i: t.replace(" ", "") for i, t, _ in rows}
    tables, real = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df: tables.append(real(df)) or tables[-1])
    found = {n: P.pack(df, capacity=64, shard=n).collect() for n in (10, 1000)}
    for got in found.values():
        check(rows, got, 64, clusters)
    bins = {n: len({x.bin_id for x in got}) for n, got in found.items()}
    first = tables[1].select("bin").distinct().count()
    assert bins[1000] <= bins[10] < 0.9 * first


def test_one_row_repeated_without_end_is_spread(spark):
    df = spark.range(25_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"))
    got = P.pack(df, capacity=8, shard=5000)
    assert got.count() == got.select("bin_id").distinct().count() == 25_000
    assert got.selectExpr(f"bin_id >> {P.BIN_BITS} as shard").groupBy("shard").count().agg(F.max("count")).first()[0] < 8000


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("bin_id", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("tokens", F.lit("x"))
    got = P.pack(df, capacity=1000).collect()
    assert sum(x.tokens for x in got) == 2 * 60_000 + 3 * 5 + 2 + 1
    for k in {x.bin_id for x in got}:
        mine = [x for x in got if x.bin_id == k]
        assert len({x.source for x in mine}) == len(mine)


def test_empty(spark):
    assert P.pack(docs(spark, [])).count() == 0
    assert P.pack(docs(spark, [(1, None, None, None), (2, " ", "en", "s")])).count() == 0
