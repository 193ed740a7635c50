import pytest
from pyspark.sql import functions as F

from foliospark.functions import language as N
from foliospark.functions import text as X
from foliospark.operators import engines as E
from foliospark.operators import rollup as R
from foliospark.plans.pipeline import process
from foliospark.plans.session import Session, process_documents, session
from foliospark.sources import files as S

from .test_regions_golden import LONG, page


def rows(doc_ids):
    return [(f"p{k}", f"{k} {LONG}", 0.9, (50, 40 + 60 * k, 400, 80 + 60 * k), "paragraph") for k in range(5)], doc_ids


def documents(spark, ids):
    made, out = rows(ids)[0], None
    for d in ids:
        p = page(spark, made, doc=d)
        out = p if out is None else out.unionByName(p)
    return out


def test_white_space_of_every_kind(spark):
    texts = ["a\u00a0b\u3000c\u2003d", "\u2028x\u0085y\x1c ", "", " \u00a0 ", "one two"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.word_count(F.col("t")).alias("n"), X.strip(F.col("t")).alias("s"), X.clean_region(F.col("t")).alias("c"), X.special(F.col("t")).alias("p")).collect()
    for t, r in zip(texts, got):
        assert (r.n, r.s, r.c) == (len(t.split()), t.strip(), " ".join(t.split()))
        assert r.p == sum(not c.isalnum() and not c.isspace() for c in t)


def test_broken_paragraphs(spark):
    text = "The first line of a long\nparagraph goes on\n  here.\n\n\u2022 one item\n\u2022 another\n\nshort line\nand another\n\n \n"
    got = spark.createDataFrame([(text,)], "t string").select(X.group_broken_paragraphs(F.col("t"))).first()[0]
    assert got == "The first line of a long paragraph goes on here.\n\n\u2022 one item\n\n\u2022 another\n\nshort line\n\nand another"


def test_elements_in_any_case_with_references(spark):
    html = "<H1 CLASS='a>b'>Head &amp; &lt;tail&gt; &#233;&#x20AC; &amp;lt; &nosuch; &#38;amp;</H1><P>One</p><script>if (a < b) '<p>no</p>'</script><!-- <li>no</li> --><UL><LI>x&nbsp;y</UL><table><tr><td>1<td>2</tr><tr><td>3</table><p>end"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [(x.type, x.text) for x in S.html_elements(df).orderBy("pos").collect()] == [("title", "Head & <tail> \u00e9\u20ac &lt; &nosuch; &amp;"), ("paragraph", "One"), ("list", "x y"), ("table", "1 2"), ("table", "3"), ("paragraph", "end")]


def test_small_vectors_are_kept_and_large_ones_noted(spark):
    got = spark.createDataFrame([([1.0, -2.5],), ([0.0] * 100,), ([0.0] * 101,), (None,)], "e array<float>").select(S.stored_embedding(F.col("e")).alias("s")).collect()
    assert got[0].s.values == [1.0, -2.5] and len(got[1].s.values) == 100 and tuple(got[2].s) == (None, "<101 dimensions>") and tuple(got[3].s) == (None, None)


def test_json_of_durations(spark):
    got = spark.sql("select timestamp'2024-01-02 03:04:05' t, X'0aFF' b, interval '1 02:00:01.5' day to second d").select(S.encode_json(F.col("t"), F.col("b"), S.seconds_of(F.col("d")))).first()[0]
    assert got == '{"at":"2024-01-02T03:04:05","content":"0aff","seconds":93601.5}'


def test_cache_is_written_and_the_latest_entry_counts(spark, tmp_path):
    files = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    for result in ("first", "second"):
        S.cache_results(files.where("cache_key = 'a'").withColumn("result", F.lit(result)), str(tmp_path / "cache"))
    hit, new = S.cached_or_new(files, spark.read.parquet(str(tmp_path / "cache")))
    assert [(x.cache_key, x.result) for x in hit.collect()] == [("a", "second")] and [x.cache_key for x in new.collect()] == ["b"]


def test_languages(spark):
    texts = ["The cat and the dog are in the house with me", "Der Hund und die Katze sind nicht im Haus", "Le chat et les chiens sont dans la maison", "El gato y los perros en una casa muy grande", "short", "Xyzzy plugh quux frobnicate waldo"]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(N.detect(F.col("t"))).collect()]
    assert got == ["en", "de", "fr", "es", "en", "en"]
    codes = spark.createDataFrame([("zh",), ("ZH-CN",), ("fr",)], "c string").select(N.engine_code(F.col("c"))).collect()
    assert [x[0] for x in codes] == ["ch_sim", "ch_sim", "fr"]


class Weak(E.PrecomputedSource):
    def read(self, page):
        if page["doc_id"] == 3:
            raise OSError("no such page")
        return [r | {"confidence": 0.3 if page["doc_id"] == 2 else r["confidence"]} for r in super().read(page)]


def test_engines_one_after_the_other_and_side_by_side(spark):
    region = {"text": "some words", "confidence": 0.8, "x1": 0.0, "y1": 0.0, "x2": 600.0, "y2": 600.0}
    pages = spark.createDataFrame([(d, 1, [region] if d != 4 else None) for d in (1, 2, 3, 4)], "doc_id long, page_number int, regions array<struct<text:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>")
    both = [("weak", Weak), ("plain", E.PrecomputedSource)]
    for parallel in (False, True):
        found, left = E.run_engines(pages, both, parallel=parallel)
        assert {x.doc_id: x.engine for x in found.collect()} == {1: "weak", 2: "plain", 3: "plain"} and [x.doc_id for x in left.collect()] == [4]
    found, left = E.run_engines(pages, both, enable_fallback=False)
    assert {x.engine for x in found.collect()} == {"weak"} and left.count() == 0
    with pytest.raises(RuntimeError):
        E.run_engines(pages, [])
    failed = E.errors_of(E.recognize(pages, Weak)).orderBy("doc_id").collect()
    assert [(x.doc_id, x.step, x.error_type, x.message, x.is_recoverable) for x in failed][0] == (3, "ocr_extraction", "OSError", "no such page", False) and len(failed) == 2


def test_images_are_preprocessed_before_an_engine_sees_them(spark):
    class Sees(E.RegionSource):
        def read(self, page):
            return [{"text": str(sorted(set(page["pixels"]))), "confidence": 0.9, "x1": 0.0, "y1": 0.0, "x2": 700.0, "y2": 900.0}]

    pages = spark.createDataFrame([(1, 1, 8, 4, bytearray(range(100, 132)))], "doc_id long, page_number int, width int, height int, pixels binary")
    found, _ = E.run_engines(pages, [("sees", Sees)], steps=("binarization",))
    assert found.first().text == "[0, 255]"


def test_failed_pages_make_failed_documents_and_missing_columns_warnings(spark):
    good = documents(spark, [1, 2]).withColumn("error", F.lit(None).cast("string"))
    bad = spark.createDataFrame([(2, 9, "OSError: torn"), (5, 1, "ValueError: blank")], "doc_id long, page_number int, error string")
    done = process(good.unionByName(bad, allowMissingColumns=True), durations=spark.createDataFrame([(1, 30.0), (5, 1.0)], "doc_id long, seconds double"))
    got = {x.doc_id: x for x in done.documents.collect()}
    assert {k: (x.status, x.has_errors, x.is_successful) for k, x in got.items()} == {1: ("completed", False, True), 2: ("failed", True, False), 5: ("failed", True, False)}
    assert got[1].pages_per_minute == 2.0 and got[5].pages_processed == 0 and got[2].pages_per_minute == 0.0 and not done.warnings
    broken = process(documents(spark, [1]), languages=spark.range(1).toDF("other"))
    assert len(broken.warnings) == 1 and broken.warnings[0].startswith("Quality assessment failed") and broken.documents.first().total_chunks > 0
    assert process(documents(spark, [1]), assess_quality=False).documents.first().pages_failed == 0
    assert R.pages_per_minute(F.lit(3), F.lit(0.0)) is not None


@pytest.mark.parametrize("strategy", ["hybrid_semantic_layout", "table_preserving"])
def test_the_other_strategies(spark, strategy):
    table = spark.createDataFrame([(1, 1, 0, "a | b", 0.0, 0.0, 5.0, 5.0)], "doc_id long, page_number int, table_idx int, text string, x1 double, y1 double, x2 double, y2 double")
    made = process(documents(spark, [1, 2]), strategy, **({"tables": table} if strategy == "table_preserving" else {})).chunks.collect()
    assert {x.strategy for x in made} == {strategy} and len({x.chunk_id for x in made}) == len(made)
    assert sorted(x.chunk_index for x in made if x.doc_id == 1) == list(range(sum(x.doc_id == 1 for x in made)))
    assert ("a | b" in [x.content for x in made]) == (strategy == "table_preserving")
    plain = process(documents(spark, [1, 2])).chunks.collect()
    joined = lambda cs: " ".join(x.content for x in sorted(cs, key=lambda x: (x.doc_id, x.chunk_index)) if "|" not in x.content).split()
    assert joined(made) == joined(plain)


def test_runs_under_a_name(spark, tmp_path):
    with session(spark, chunk_size=400, confidence_threshold=0.5) as s:
        assert s.config.chunker.chunk_size == 400 and s.config.confidence_threshold == 0.5
        s.process("first", documents(spark, [1, 2, 3]), str(tmp_path / "out"))
        run = s.status("first")
        assert run.status == "completed" and run.counts["documents"] == 3 and run.counts["failed"] == 0 and run.seconds > 0
        assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == run.counts["chunks"] > 0
        with pytest.raises(Exception):
            s.process("second", spark.range(3), str(tmp_path / "no"))
        assert s.status("second").status == "failed" and s.status("third") is None
        m = s.metrics()
        assert m["runs"] == {"completed": 1, "failed": 1} and m["documents"] == 3 and len(m["errors"]) == 1 and m["engines"]["precomputed"]
        s.configure(strategy="confidence_based")
        with pytest.raises(ValueError):
            s.configure(strategy="none such")
        assert "pdf" in s.supported_formats() and len(s.chunking_strategies()) == 5
    assert process_documents(documents(spark, [7]), str(tmp_path / "one")).counts["documents"] == 1
    assert Session(spark).status("x") is None
