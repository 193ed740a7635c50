import random

from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import exact_dedup, language_id
from foliospark.llm.catalog import WEIGHTS

from .helpers import awkward, docs, grams, prose
from .test_mixing import brute as mixed
from .test_near_join import brute as similar
from .test_packing import check


def corpus(spark):
    r, rows = random.Random(11), []
    for i in range(160):
        text = prose(i % 120, 20 + i % 60)
        if i % 17 == 0:
            text = " ".join("zig" if r.random() < 0.04 else w for w in text.split())
        rows.append((i, text, "en", r.choice(["src0"] * 3 + ["a", "b"])))
    rows += [(900, "Привет как дела сегодня " * 10, None, "a"), (901, None, "en", "a"), (902, "", "en", "b")]
    return docs(spark, rows)


def test_each_stage_against_brute_force(spark, tmp_path):
    df, sizes = corpus(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(x)[:4] for x in df.select("doc_id", "text", "lang", "source").collect()]
        out = stage(spark, df, "unused")
        if name != "packing":
            assert out.schema == df.schema
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        ids = sorted(x.doc_id for x in df.select("doc_id").collect())
        sizes.append(len(ids))
        texts = {i: t for i, t, _, _ in before}
        if name == "language_id":
            assert ids == sorted(i for i, t, _, _ in before if t and i != 900)
        elif name == "exact_dedup":
            first = {}
            for i in sorted(texts):
                first.setdefault(texts[i], i)
            assert ids == sorted(first.values())
        elif name == "near_dedup":
            pairs = similar([(i, t) for i, t, _, _ in before], 2, 0.6)
            assert pairs and not any(a in ids and b in ids for a, b in pairs)
            assert all(i in ids for i in texts if not any(i in p for p in pairs))
        elif name == "mixing":
            assert ids == sorted(x[0] for x in mixed([(i, t, s) for i, t, _, s in before], WEIGHTS, 1.0, 0.8))
        else:
            check([(i, t, s) for i, t, _, s in before], df.collect(), 2048, {i: "".join(t.lower().split()) for i, t in texts.items()})
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0


def test_run_awkward_and_empty(spark, tmp_path):
    for k, df in enumerate((awkward(spark), docs(spark, []), awkward(spark).withColumn("row", F.lit(1)))):
        df.write.parquet(str(tmp_path / f"d{k}" / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / f"d{k}")).collect()
        assert bool(got) == (k != 1)


def test_the_entry_knows_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert grams("a b", 2) and exact_dedup and language_id
