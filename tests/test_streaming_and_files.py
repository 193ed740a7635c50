import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import images as I
from foliospark.plans.pipeline import process, text_pipeline, text_scores
from foliospark.sources import files as S
from foliospark.streaming import regions as R

from .test_regions_golden import LONG, ROW, page


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [(f"p{k}", f"{k} {LONG}", 0.9, (50, 40 + 60 * k, 400, 80 + 60 * k), "paragraph") for k in range(5)] + [("bad", "t", 2.0, (0, 0, 1, 1), "text")]
    for d in range(3):
        page(spark, rows, doc=d).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    R.run_to_end(R.chunk_stream(R.read_regions(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), str(tmp_path / "state")))
    batch = process(spark.read.parquet(str(tmp_path / "in")))
    got = spark.read.parquet(str(tmp_path / "out" / "chunks")).select("chunk_id", "content").collect()
    assert sorted(got) == sorted(batch.chunks.select("chunk_id", "content").collect()) and got
    assert spark.read.parquet(str(tmp_path / "out" / "quarantined")).count() == 3 == batch.quarantined.count()
    assert batch.documents.count() == 3


def test_windows_and_new_files_over_streams(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:30' as processed_at, 'easyocr' as engine, 0.5D as overall_confidence, '/a' as path, 3L as length, timestamp'2024-01-01 00:00:00' as mtime").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", R.confidence_windows(stream), "complete"), ("f", R.new_files(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == 1


def test_files_types_keys_and_cache(spark, tmp_path):
    for name in ("a.PDF", "b.tiff", "c.txt"):
        (tmp_path / name).write_bytes(b"123")
    got = {x.title: x for x in S.read_files(spark, str(tmp_path)).collect()}
    assert [got[k].document_type for k in "abc"] == ["pdf", "multi_page_tiff", "unknown"] and got["b"].requires_ocr and not got["a"].requires_ocr and got["a"].is_pdf
    assert len({x.cache_key for x in got.values()}) == 3
    files = S.read_files(spark, str(tmp_path))
    cache = files.limit(1).select("cache_key", F.current_timestamp().alias("cached_at"), F.lit("r").alias("result"))
    old = files.where("title = 'c'").select("cache_key", F.expr("current_timestamp() - interval 30 hours").alias("cached_at"), F.lit("r").alias("result"))
    hit, new = S.cached_or_new(files, cache)
    assert (hit.count(), new.count()) == (1, 2) and S.cached_or_new(files, old)[0].count() == 0
    assert files.select(S.safe_content(F.col("content"))).first()[0] == "<3 bytes>"
    made = spark.sql("select timestamp'2024-01-02 03:04:05' as t, X'0aFF' as b, 1.5D as s").select(S.encode_json(F.col("t"), F.col("b"), F.col("s"))).first()[0]
    assert made == '{"at":"2024-01-02T03:04:05","content":"0aff","seconds":1.5}'


def test_elements_and_text_pipeline(spark):
    html = "<html><h1>Head</h1><p>One <b>bold</b> line.<p>Two<ul><li>x</li><li></li></ul>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = [(x.type, x.text) for x in S.html_elements(pages).orderBy("pos").collect()]
    assert got == [("title", "Head"), ("paragraph", "One bold line."), ("paragraph", "Two"), ("list", "x")]
    chunks, scores = text_pipeline(S.html_elements(pages))
    assert chunks.count() == 1 and scores.first().overall_score_raw is not None


def test_scores_are_of_whole_texts(spark):
    texts = [(1, "One two three. " * 2000), (2, "One two three. " * 2000 + "Extraordinarily complicated considerations! " * 500)]
    got = {x.doc_id: x for x in text_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1].sentence_count, got[2].sentence_count) == (2000, 2500)
    assert got[2].flesch < got[1].flesch and got[2].ari > got[1].ari


def test_image_steps():
    rng = np.random.default_rng(1)
    text = np.full((120, 160), 230, np.uint8)
    text[20:100:16, 10:150] = 20
    turned = I.rotate(text, 4)
    assert abs(I.skew(turned) + 4) <= 1 and abs(I.skew(text)) <= 0.5
    assert set(np.unique(I.binarize(text))) <= {0, 255} and 20 <= I.otsu(text) < 230
    noisy = np.clip(text + rng.normal(0, 12, text.shape), 0, 255).astype(np.uint8)
    assert np.abs(I.reduce_noise(noisy).astype(int) - text).mean() < np.abs(noisy.astype(int) - text).mean()
    assert I.enhance_contrast(noisy).std() > 0 and I.sharpen(text).shape == text.shape
    assert I.scale(text).shape[0] == 1500 and I.optimal_resolution(text, 300).shape == (240, 320) and I.optimal_resolution(text, 100).shape == text.shape
    out, done = I.preprocess(text, ("noise_reduction", "no such step", "binarization"))
    assert done == ["noise_reduction", "binarization"] and out.shape == text.shape
    assert I.gray(np.zeros((2, 2, 3), np.uint8)).shape == (2, 2)


def test_schema_of_rows_is_what_the_pipeline_takes(spark):
    assert process(spark.createDataFrame([], ROW)).chunks.count() == 0
