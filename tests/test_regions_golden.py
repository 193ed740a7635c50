"""Hand-derived expectations for two small pages, and rules one by one."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import chunkers as C
from foliospark.operators import layout as L
from foliospark.operators import quality as Q
from foliospark.operators.classify import hierarchy_level
from foliospark.schema import ChunkerConfig, ProcessingConfig, TextConfig, validate_regions

ROW = "region_id string, doc_id long, page_number int, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, region_type string, reading_order int"
LONG = "A first paragraph stands for the document's body. " * 3 + "It says what recognised text may hold and how it is cut"


def page(spark, rows, doc=1):
    return spark.createDataFrame([(i, doc, 1, k, t, c, *map(float, box), kind, None) for k, (i, t, c, box, kind) in enumerate(rows)], ROW)


@pytest.fixture(scope="module")
def chunk_page(spark):
    return page(spark, [
        ("title_1", "Document Heading: Some Processing Method", 0.95, (50, 50, 400, 80), "title"),
        ("para_1", LONG, 0.88, (50, 100, 400, 140), "paragraph"),
        ("list_1", "• A first point on accuracy of results", 0.82, (70, 160, 380, 180), "list"),
        ("list_2", "• A second point on structure of documents", 0.85, (70, 190, 380, 210), "list"),
    ])


def test_layout_chunks_of_a_page(chunk_page):
    got = C.layout_chunks(chunk_page, ChunkerConfig(chunk_size=500)).orderBy("chunk_index").collect()
    assert [c.region_ids for c in got] == ["para_1", "list_1,list_2"]
    assert got[0].average_confidence == pytest.approx(0.88) and got[1].average_confidence == pytest.approx(0.835)
    assert (got[0].is_filtered, got[1].filter_reason) == (False, "Content too short")
    assert all(c.reading_order is None for c in got) and got[0].next_chunk_id == got[1].chunk_id


def test_confidence_chunks_of_a_page(chunk_page):
    got = C.confidence_chunks(chunk_page, ChunkerConfig(chunk_size=500, high=0.9, medium=0.8)).orderBy("chunk_index").collect()
    assert [(c.bucket, c.region_ids) for c in got] == [("high", "title_1"), ("medium", "para_1"), ("medium", "list_1,list_2")]
    assert [c.filter_reason for c in got] == ["Content too short", None, "Content too short"]


def test_quality_of_a_page(spark):
    rows = [("high", "Well recognised text of good confidence", 0.95, (50, 50, 400, 80), "paragraph"), ("med", "M3dium qual1ty with som3 err0rs", 0.65, (50, 100, 400, 120), "paragraph"), ("low", "L0w qu@lity w1th m@ny 3rr0rs", 0.35, (50, 140, 400, 160), "paragraph")]
    r = page(spark, rows)
    pages = r.select("doc_id", "page_number").distinct().withColumn("text_coverage_ratio", F.lit(0.18))
    q = Q.assess(r, pages).first()
    assert q.mean == pytest.approx(0.65) and q.median == 0.65 and q.std_dev == pytest.approx(0.3)
    assert (q.low_count, q.medium_count, q.high_count) == (1, 1, 1)
    assert q.consistency == 1.0 and q.columns_detected == 1 and q.overlaps == 0 and q.sentences == 0 and not q.has_structure
    assert q.overall_score == pytest.approx(0.735) and q.overall_level == "acceptable"
    assert sorted(q.issues) == ["language_detection_failed", "layout_errors"] and q.acceptable_for_rag and q.needs_reprocessing


def test_first_in_order_counts_as_missing(spark):
    rows = [(f"r{k}", f"Paragraph number {k} of the page says something.", 0.9, (50, 50 + 200 * k, 60 + 10 * k, 70 + 200 * k), "paragraph") for k in range(3)]
    r = L.reading_order(page(spark, rows))
    got = C.layout_chunks(r, ChunkerConfig(min_chunk_size=1)).orderBy("chunk_index").collect()
    assert [c.region_ids for c in got] == ["r1", "r2", "r0"] or len(got) < 3
    kept = C.layout_chunks(r, ChunkerConfig(min_chunk_size=1, zero_is_missing=False)).orderBy("chunk_index").collect()
    assert [i for c in kept for i in c.region_ids.split(",")] == ["r0", "r1", "r2"]


def test_headers_titles_captions_and_footers(spark):
    long = "x" * 120
    rows = [
        ("h1", long + " first", 0.9, (50, 10, 400, 20), "header"), ("h2", "short", 0.9, (50, 30, 400, 40), "header"), ("h3", "y" * 600, 0.9, (50, 50, 400, 60), "header"),
        ("t1", "tiny", 0.9, (50, 70, 400, 80), "title"), ("t2", long, 0.9, (50, 90, 400, 95), "title"), ("p", long, 0.9, (50, 100, 400, 120), "paragraph"),
        ("c", long + " caption", 0.9, (50, 130, 400, 140), "caption"), ("f1", long, 0.9, (50, 150, 400, 160), "footer"), ("f2", "end", 0.9, (50, 170, 400, 180), "footer"), ("o", long, 0.9, (50, 190, 400, 200), "figure"),
    ]
    got = C.layout_chunks(page(spark, rows)).orderBy("chunk_index").collect()
    assert [(c.bucket, c.region_ids) for c in got] == [("header", "h1"), ("header", "h3"), ("title", "t2"), ("paragraph", "h2,p"), ("caption", "c"), ("other", "o"), ("footer", "f1,f2")]
    assert got[3].is_header and got[3].hierarchy_level == 1 and got[5].has_figures
    plain = C.layout_chunks(page(spark, rows), ChunkerConfig(preserve_headers=False)).collect()
    assert sorted(c.region_ids for c in plain if c.bucket in ("header", "paragraph")) == ["h1", "h2", "h3", "p"]


def test_lists_one_by_one_and_tables_last(spark):
    rows = [("a", "- " + "item " * 30, 0.9, (50, 10, 400, 20), "list"), ("b", "- short", 0.9, (50, 22, 400, 32), "list")]
    got = C.layout_chunks(page(spark, rows), ChunkerConfig(preserve_lists=False)).collect()
    assert [c.region_ids for c in got] == ["a"]
    tables = spark.createDataFrame([(1, 1, 0, "cell | " * 30, 0.0, 0.0, 90.0, 18.0), (1, 1, 1, "small", 0.0, 0.0, 90.0, 18.0)], "doc_id long, page_number int, table_idx int, text string, x1 double, y1 double, x2 double, y2 double")
    both = C.layout_chunks(page(spark, rows), ChunkerConfig(), tables).orderBy("chunk_index").collect()
    assert [(c.bucket, c.has_tables) for c in both] == [("list", False), ("table", True)]


def test_pages_without_anything(spark):
    none = page(spark, [])
    assert C.layout_chunks(none).count() == 0 and C.confidence_chunks(none).count() == 0 and Q.assess(none).count() == 0 and L.statistics(none).count() == 0
    low = page(spark, [("a", "text", 0.1, (0, 0, 1, 1), "paragraph")])
    assert C.layout_chunks(low).count() == 0 and Q.assess(low).count() == 1
    one = L.analyze(low).first()
    assert one.reading_order == 0 and one.parent_region_id is None


def test_rows_against_the_model_are_set_aside(spark):
    r = page(spark, [("ok", "t", 0.5, (0, 0, 1, 1), "text"), ("conf", "t", 1.5, (0, 0, 1, 1), "text"), ("flat", "t", 0.5, (0, 0, 1, 0), "text"), (None, None, 0.5, (2, 0, 1, 1), "text")])
    good, bad = validate_regions(r)
    assert [x.region_id for x in good.collect()] == ["ok"]
    assert {x.region_id: x.violations for x in bad.collect()} == {"conf": ["confidence"], "flat": ["height"], None: ["width", "text", "region_id"]}


def test_settings_are_checked():
    for make in (lambda: ChunkerConfig(confidence_threshold=2), lambda: ProcessingConfig(engines=("nobody",)), lambda: TextConfig(chunk_size=10), lambda: TextConfig(chunk_overlap=1000)):
        with pytest.raises(ValueError):
            make()


def test_hierarchy_levels(spark):
    df = spark.createDataFrame([(["footer", "list"],), (["title", "paragraph"],), (["figure"],)], "t array<string>")
    assert [x[0] for x in df.select(hierarchy_level(F.col("t"))).collect()] == [3, 0, 2]
