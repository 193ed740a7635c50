import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import near_join as N

from .helpers import awkward, docs, grams, prose


def brute(rows, n, threshold):
    sets = [(i, grams(t, n)) for i, t in rows if i is not None and t]
    out = {}
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and i != j:
                score = len(a & b) / len(a | b)
                if score >= threshold:
                    key = (min(i, j), max(i, j))
                    out[key] = max(score, out.get(key, 0))
    return out


def versions(rows, n, threshold):
    """(doc_id, class_id, links) of every document and set, all pairs of sets compared."""
    own = sorted({(i, frozenset(grams(t, n))) for i, t in rows if i is not None}, key=lambda v: v[0])
    links, root = [0] * len(own), list(range(len(own)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(own)):
        for y in range(x):
            a, b = own[x][1], own[y][1]
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[x], links[y] = links[x] + 1, links[y] + 1
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return sorted((own[k][0], own[find(k)][0], links[k]) for k in range(len(own)))


def summary(df, **params):
    return sorted(map(tuple, N.Join(df, **params).summary().collect()))


def corpus(seed, groups, size):
    r, rows = random.Random(seed), []
    passage = prose(seed + 1, 60)
    for g in range(groups):
        base = prose(1000 * seed + g, r.randint(8, 120)).split()
        for _ in range(r.choice([1, 1, 2, size])):
            w = list(base)
            for k in range(len(w)):
                if r.random() < 0.05:
                    w[k] = r.choice("zig zag zog".split())
            rows.append((len(rows), " ".join(w) + (" " + passage if r.random() < 0.3 else "")))
    return rows


def linked(rows):
    return sum(n for _, _, n in rows)


@pytest.mark.parametrize("threshold, n", [(0.6, 2), (0.8, 3), (1.0, 1)])
def test_recall_and_exact_links(spark, threshold, n):
    rows = corpus(3, 60, 9)
    df = docs(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    got, want = summary(df, n=n, threshold=threshold), versions(rows, n, threshold)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert all(a[2] <= b[2] and a[1] >= b[1] for a, b in zip(got, want))
    assert linked(got) >= 0.95 * linked(want)


def test_recall_of_pairs_at_the_threshold(spark):
    """The pairs that are hardest to meet: two of a kind, with a Jaccard from the threshold to a little over it."""
    r, rows = random.Random(8), []
    for g in range(1500):
        w = [f"{g}x{k}" for k in range(120)]
        for k in r.sample(range(120), 15):
            w[k] += "y"
        rows += [(2 * g, " ".join(f"{g}x{k}" for k in range(120))), (2 * g + 1, " ".join(w))]
    near = sum(len(grams(a, 2) & grams(b, 2)) / len(grams(a, 2) | grams(b, 2)) >= 0.6 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    got = summary(docs(spark, [(i, t, "en", "s") for i, t in rows]))
    assert near > 300 and linked(got) >= 0.95 * 2 * near


@pytest.mark.parametrize("params", [{"small": 4}, {"small": 4, "local": 8}, {"block": 5}, {"small": 4, "local": 8, "block": 3, "max_depth": 1}])
def test_splitting_large_buckets_and_components(spark, params):
    rows = corpus(4, 30, 40)
    got, want = summary(docs(spark, [(i, t, "en", "s") for i, t in rows]), **params), versions(rows, 2, 0.6)
    assert all(a[2] <= b[2] for a, b in zip(got, want))
    assert linked(got) >= 0.95 * linked(want)


def test_a_long_chain_sends_sets_only_where_they_met(spark):
    w = [f"w{k}" for k in range(1400)]
    rows = [(k, " ".join(w[4 * k : 4 * k + 40])) for k in range(300)]
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    join = N.Join(df, block=10)
    got = sorted(map(tuple, join.summary().collect()))
    assert got == versions(rows, 2, 0.6) and {x[1] for x in got} == {0}
    parts = N.connected(join.links())
    large = parts.select("node.rep", "node.set_hash", "root", F.pmod(F.xxhash64("node"), F.lit(30)).cast("int").alias("own"))
    sides = join.sides(large)
    assert sides.count() < 300 * 9  # of 300 * 30 for all pairs of blocks


def test_copies_of_one_text_cost_a_row_each(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one text of a few words").otherwise(F.concat(F.lit("text "), F.col("id"), F.lit(" alone"))).alias("text"))
    got = summary(df)
    assert len(got) == 3000 and all(x[1:] == ((1, 1999) if x[0] % 3 else (x[0], 0)) for x in got)


def test_shared_counts_of_long_sets_go_by_ranges():
    r = np.random.default_rng(4)
    pool = np.unique(r.integers(0, 2**63, 400_000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    sets = [np.sort(r.choice(pool, n, replace=False)) for n in (200_000, 250_000, 1, 0, 150_000, 300_000, 90_000, 200_000)]
    want = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = N.shared_counts(sets)
    np.fill_diagonal(got, 0)
    assert got.tolist() == want and sum(map(len, sets)) >> 19 == 2


def test_kernels_against_loops():
    r = np.random.default_rng(3)
    sketch = r.integers(0, 3, (60, 16)).astype(np.uint8)
    near = np.array([[i != j and (sketch[i] == sketch[j]).sum() >= 8 for j in range(60)] for i in range(60)])
    assert (np.concatenate([np.pad(x, ((0, 0), (0, 60 - b))) for _, b, x in N.near_rows(sketch, 8)]) == np.tril(near)).all()
    block = r.integers(0, 4, 60)
    assert sorted(N.brute_sides(np.arange(60), sketch, 8, block)) == sorted({(i, int(block[j])) for i in range(60) for j in range(60) if near[i, j]})
    up = N.spanning(near)
    reach = near | np.eye(60, dtype=bool)
    tree = np.eye(60, dtype=bool)
    for i in np.flatnonzero(up >= 0):
        assert near[i, up[i]]
        tree[i, up[i]] = tree[up[i], i] = True
    for _ in range(60):
        reach, tree = reach @ reach, tree @ tree
    assert (reach == tree).all()


def test_runs_reach_the_target_in_expectation():
    p = N.meeting(0.6, 64, 3)
    assert 0.3 < p < 0.45 and 1 - (1 - p) ** N.runs_for(0.95, 0.6, 64, 3) >= 0.95
    lost = N.screened(0.6, 64, 29)
    assert 0.004 < lost < 0.008 and (1 - (1 - p) ** N.runs_for(0.95, 0.6, 64, 3, lost)) * (1 - lost) >= 0.95
    with pytest.raises(ValueError):
        N.runs_for(0.95, 0.6, 64, 3, 0.06)
    assert N.meeting(0.6, 64, 1) == pytest.approx(1 - np.exp(-1), abs=0.02)


def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    r.shuffle(edges)
    got = {x.node: x.root for x in N.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {200 + i: 200 for i in range(9)}
    assert N.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    df = awkward(spark)
    got = summary(df.withColumns({"rep": F.lit(1), "sketch": F.lit("x")}))
    assert got == versions([(x.doc_id, x.text) for x in df.collect()], 2, 0.6)
    assert [x for x in got if x[0] in (1, 7, 8)] == [(1, 1, 2), (7, 7, 1), (8, 7, 1)]
    kept = N.near_dedup(df.withColumn("row", F.lit(1)).withColumn("kept", F.lit(2)))
    assert kept.columns == [*df.columns, "row", "kept"]
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 7, 9, 11, 12] and ids.count(None) == 2


def test_versions_of_one_document(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z q"), (3, "u v w x y z q"), (5, "u v w x y z"), (5, "k l m n o p"), (6, "k l m n o p")]
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    assert summary(df) == versions(rows, 2, 0.6)
    # A version goes with its own class, and each class keeps one.
    assert sorted((x.doc_id, x.text) for x in N.near_dedup(df).collect()) == [(1, "a b c d e f"), (1, "u v w x y z"), (5, "k l m n o p")]
    assert {x.doc_id: x.near for x in N.Join(df).groups().collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 5}


def test_names_that_clash(spark):
    df = docs(spark, [(1, "a b c d", "en", "s"), (2, "a b c d", "de", "t")])
    twice = df.select("*", F.lit("x").alias("lang"), F.lit("y").alias("Text"))
    kept = N.near_dedup(twice)
    assert kept.columns == twice.columns and [tuple(x) for x in kept.collect()] == [(1, "a b c d", "en", "s", 7, "x", "y")]
    assert summary(twice) == [(1, 1, 1), (2, 1, 1)]


def test_one_document_of_each_group_stays(spark):
    rows = corpus(6, 40, 8)
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(rows, 2, 0.6):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert sorted(x.doc_id for x in N.near_dedup(df).collect()) == sorted({root(i) for i, _ in rows})


def test_empty(spark):
    none = docs(spark, [])
    assert N.Join(none).summary().count() == 0 and N.near_dedup(none).count() == 0
    assert summary(docs(spark, [(1, None, None, None), (2, "", "en", "s")])) == [(1, 1, 0), (2, 2, 0)]
    assert N.near_dedup(docs(spark, [(1, None, None, None), (2, "", "en", "s")])).count() == 2
