import random

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import quality as Q

from .helpers import awkward, docs, prose, words


def labelled(spark, n):
    r, rows, labels = random.Random(8), [], []
    for i in range(n):
        good = r.random() < 0.7
        text = prose(i, r.randint(10, 80))
        rows.append((i, text if good else " ".join(w + r.choice(["***", "!!", " | "]) for w in text.split()), "en", "s"))
        labels.append((i, int(good), 0))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, g) for i, g, _ in labels)


def test_held_out_accuracy_and_bounded_training(spark):
    df, labels, truth = labelled(spark, 600)
    model = Q.fit(df, labels.where("doc_id < 300"), max_rows=250)
    got = {x.doc_id: x for x in Q.score(df, model).collect()}
    held = [i for i in truth if i >= 300]
    assert np.mean([(got[i].quality >= 0.5) == truth[i] for i in held]) > 0.97
    assert np.mean([got[i].keep for i in held if truth[i]]) > 0.97


def test_scores_are_sparse_dot_products(spark):
    df, labels, _ = labelled(spark, 60)
    model = Q.fit(df, labels, n=1)
    import pyarrow as pa

    from foliospark.llm.textops import U, Words, utf8

    for row in df.limit(10).collect():
        data, offsets, _ = utf8(pa.array([row.text]))
        h = Words(data, offsets, 0, 1, punctuation=True).hashes
        total = sum(model.weights[int(x >> U(64 - model.bits))] for x in h)
        want = 1 / (1 + np.exp(-(model.bias + total / np.sqrt(len(h)))))
        got = Q.score(df.where(F.col("doc_id") == row.doc_id), model).first().quality
        assert abs(got - want) < 1e-9
        assert len(h) >= len(words(row.text))


def test_follow_the_leader_step_matches_scalar_arithmetic():
    rows, y = [np.array([1, 1, 3]), np.array([3, 5])], np.array([1, 0])
    m = Q.train(rows, y, 1, 4, passes=1, alpha=0.3, beta=1.0, l1=0.0, l2=1.0)
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda z, n: -z / ((1 + n**0.5) / 0.3 + 1)
    for r, t in zip(rows, y):
        x = {p: (r == p).sum() / len(r) ** 0.5 for p in r.tolist()}
        wb = -zb / ((1 + nb**0.5) / 0.3)
        p = 1 / (1 + np.exp(-(wb + sum(weight(z.get(k, 0), n.get(k, 0)) * v for k, v in x.items()))))
        for k, v in x.items():
            g, w, old = (p - t) * v, weight(z.get(k, 0), n.get(k, 0)), n.get(k, 0)
            z[k] = z.get(k, 0) + g - ((old + g * g) ** 0.5 - old**0.5) / 0.3 * w
            n[k] = old + g * g
        zb += (p - t) - ((nb + (p - t) ** 2) ** 0.5 - nb**0.5) / 0.3 * wb
        nb += (p - t) ** 2
    for k in z:
        assert abs(m.weights[k] - weight(z[k], n[k])) < 1e-12
    assert abs(m.bias + zb / ((1 + nb**0.5) / 0.3)) < 1e-12


def test_awkward_rows_and_empty_tables(spark):
    df, labels, _ = labelled(spark, 50)
    odd = awkward(spark).withColumnRenamed("source", "quality").withColumnRenamed("lang", "keep")
    got = Q.score(odd, Q.fit(df, labels)).collect()
    assert len(got) == odd.count()
    assert all(x.quality is None and x.keep is False for x in got if x.doc_id in (3, 4, 5, 6, 9))
    assert len({x.quality for x in got if x.doc_id in (1, 2)}) == 1
    none = labels.where("false")
    assert {(x.quality, x.keep) for x in Q.score(df, Q.fit(df, none)).collect()} == {(0.5, True)}
    nulls = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.score(df.where("false"), Q.fit(df, nulls)).count() == 0


def test_a_repeated_key_counts_once_in_the_sample(spark, monkeypatch):
    seen = []
    real = Q.train
    monkeypatch.setattr(Q, "train", lambda rows, labels, *a, **k: seen.append(len(rows)) or real(rows, labels, *a, **k))
    texts = spark.range(3000).selectExpr("1L as doc_id", "concat('text ', id) as text").unionByName(spark.range(50).selectExpr("id + 10 as doc_id", "'other words' as text"))
    labels = spark.range(60).selectExpr("id as doc_id", "int(id % 2) as quality").unionByName(spark.range(2000).selectExpr("1L as doc_id", "1 as quality"))
    model = Q.fit(texts, labels, max_rows=40)
    assert seen and max(seen) <= 40
    assert Q.score(texts.limit(0), model).count() == 0
    assert Q.score(texts.selectExpr("*", "1 as quality", "'x' as TEXT").limit(2), model).count() == 2
