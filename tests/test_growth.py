"""Steps whose cost must grow no faster than their input, by their plans and on inputs that showed the fault."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.functions import language as N
from foliospark.functions import splitters as S
from foliospark.functions import text as X
from foliospark.operators import chunkers as C
from foliospark.operators import classify as K
from foliospark.operators import engines as E
from foliospark.operators import quality as Q
from foliospark.operators import tables as T
from foliospark.plans import catalog
from foliospark.plans import pipeline as W
from foliospark.schema import ChunkerConfig

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_queries_exchange_lines_once_and_join_nothing(spark):
    for name in ("table_from_blocks", "block_words", "table_text"):
        p = plan(catalog.QUERIES[name](spark, SF))
        assert "Join" not in p and p.count("Exchange hashpartitioning") == 1 and "Window" not in p, name


def block(i, kind, ids=None, text=None, row=None, col=None):
    return {"Id": i, "BlockType": kind, "RowIndex": row, "ColumnIndex": col, "Text": text, "Confidence": 50.0, "Geometry": {"BoundingBox": {"Left": 0.0, "Top": 0.0, "Width": 1.0, "Height": 1.0}}, "Ids": ids}


def test_block_tables_with_shared_cells_dead_links_and_many_blocks(spark):
    odd = [block("t", "TABLE", ["a", "gone", "b"]), block("u", "TABLE", ["a"]), block("v", "TABLE"), block("a", "CELL", ["w2", "w1", "no", "w3"], row=1, col=1), block("b", "CELL", row=1, col=2), block("w1", "WORD", text="x"), block("w2", "WORD", text="y"), block("w3", "WORD", text="")]
    n = 3000
    big = [block("t", "TABLE", [f"c{k}" for k in range(n)]), *[block(f"c{k}", "CELL", [f"w{k}"], row=k + 1, col=1) for k in range(n)], *[block(f"w{k}", "WORD", text=str(k)) for k in range(n)]]
    docs = spark.createDataFrame([(1, json.dumps({"Blocks": odd})), (2, json.dumps({"Blocks": big})), (3, "{}"), (4, None)], "table_id long, json string")
    got = T.tables_from_blocks(T.parse_blocks(docs))
    assert sorted((x.table_block, x.row, x.col, x.text) for x in got.where("table_id = 1").collect()) == [("t", 0, 0, "y x"), ("t", 0, 1, ""), ("u", 0, 0, "y x")]
    assert sorted((x.row, x.text) for x in got.where("table_id <> 1").collect()) == [(k, str(k)) for k in range(n)]
    words = T.line_regions(T.parse_blocks(docs), kind="WORD").where(F.col("table_id") == 1).orderBy("reading_order").collect()
    assert [(x.reading_order, x.region_id) for x in words] == [(0, "w1"), (1, "w2"), (2, "w3")]


def test_texts_of_which_nothing_is_left_have_no_row(spark, tmp_path):
    texts = [None, "", " ", "\n \n", "one, two"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [x.doc_id for x in catalog.broken_paragraphs(spark, str(tmp_path)).collect()] == [4]


def test_means_do_not_depend_on_the_order_of_rows(spark):
    values = [0.1, 0.2, 0.3, 0.7, 0.6, 0.3]
    at = [(1, 1, k, c, "some words here", 0.0, 50.0 * k, 9.0, 50.0 * k + 9, "paragraph", None) for k, c in enumerate(values)]
    schema = "doc_id long, page_number int, line_no int, confidence double, text string, x1 double, y1 double, x2 double, y2 double, region_type string, reading_order int"
    got = {Q.assess(spark.createDataFrame(rows, schema).coalesce(1)).first()["mean"] for rows in (at, at[::-1], at[2:] + at[:2])}
    assert got == {sum(values[1:], values[0]) / 6}


def test_hierarchy_joins_nothing(spark):
    for name in ("hierarchy", "hierarchy_children"):
        p = plan(catalog.QUERIES[name](spark, SF))
        assert "Join" not in p and p.count("Exchange hashpartitioning") == 1, name


def test_pieces_are_given_out_by_the_megabyte(spark):
    docs = spark.createDataFrame([(k, "One sentence here. " * 60_000) for k in range(4)] + [(9, None), (10, "")], "doc_id long, text string").coalesce(1)
    got = S.split_texts(docs, "sentence", 500, 100)
    assert "MapInArrow" in plan(got) and sorted(x.doc_id for x in got.select("doc_id").distinct().collect()) == [0, 1, 2, 3]


def test_language_is_worked_out_once(spark):
    p = plan(spark.range(1).selectExpr("cast(id as string) t").select(N.engine_code(N.detect(F.col("t"))).alias("l")))
    assert p.count("split(") == 1


def test_entities_sort_tokens_once(spark):
    assert plan(catalog.bio_entities(spark, SF)).count("Sort [") == 1


def test_types_need_no_lower_case_and_no_regex_to_strip(spark):
    for name in ("chunks_layout_aware", "chunks_mixed", "chunks_confidence", "paragraph_groups", "list_groups"):
        p = plan(catalog.QUERIES[name](spark, SF))
        assert "lower(" not in p and "regexp_replace(text" not in p, name


def test_words_of_a_chunk_are_worked_out_once_to_filter_it(spark):
    p = plan(spark.range(1).selectExpr("cast(id as string) c", "0.9d a").select(C.filter_reason(F.col("c"), F.col("a"), ChunkerConfig()).alias("r")))
    assert p.count("split(") == 1


def test_white_space_and_captions_over_all_characters(spark):
    """Against Python: what is white is the same at the ends of texts, between words and next to letters; keywords are found in any case."""
    chars = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    t = F.concat("c", F.lit("x"), "c", "c", F.lit("y"), "c")
    df = spark.createDataFrame([(c, len(f"{c}x{c}{c}y{c}".split()), f"{c}x{c}{c}y{c}".strip()) for c in chars], "c string, n int, s string")
    assert df.where((X.word_count(t) != F.col("n")) | (X.strip(t) != F.col("s"))).count() == 0
    keyed = F.concat(F.lit("f"), "c", F.lit("gure"))
    assert [x.c for x in df.where(keyed.rlike(K.CAPTION)).collect()] == ["I", "i"]
    assert df.where(F.lower(keyed).rlike("figure") != keyed.rlike(K.CAPTION)).count() == 0


def test_readability_counts_are_worked_out_once(spark):
    p = catalog.readability(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("regexp_extract_all(") == 4 and p.count("regexp_replace(") == 1 and "lower(" not in p


def test_vowels_are_the_same_as_of_the_lower_case(spark):
    texts = ["İa", "İbİbİb", "AEbIoBU", "Ka", "ÅaÉe", "bAbEbIb Ab", "a E　I"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    vowels = X.VOWELS[:6]
    hard = rf"[{vowels}]++[^{vowels}{X.WHITE}]++[{vowels}]++[^{vowels}{X.WHITE}]++[{vowels}]{X.INK}*+"
    counts = X.text_counts(F.col("t"))
    assert df.where((F.regexp_count(F.lower("t"), F.lit(f"[{vowels}]+")) != counts["_syllables"]) | (F.regexp_count(F.lower("t"), F.lit(hard)) != counts["_hard"])).count() == 0


def test_pages_are_merged_once_for_chunks_and_scores(spark):
    p = plan(catalog.text_pipeline(spark, SF))
    assert "Join" not in p and p.count("Scan parquet") == 1


def test_chunks_with_scores_equal_chunks_joined_with_scores(spark):
    rows = [(1, 0, "One sentence here. " * 200), (1, 1, "Another, with İ."), (2, 0, "..."), (3, 0, ""), (4, 0, None), (None, 0, "of no page")]
    elements = spark.createDataFrame(rows, "page_id long, pos int, text string")
    chunks, scores = W.text_pipeline(elements)
    want = chunks.join(scores, "doc_id")
    got = W.scored_chunks(elements)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 3


def test_engines_are_planned_without_a_job_and_measured_once(spark):
    group = "engines planned"
    pages = spark.sql("select id doc_id, 1 page_number, array(named_struct('text', 'x', 'confidence', 0.9d, 'x1', 0d, 'y1', 0d, 'x2', 600d, 'y2', 600d)) regions from range(3)")
    spark.sparkContext.setJobGroup(group, group)
    found, left = E.run_engines(pages, [("one", E.PrecomputedSource), ("two", E.PrecomputedSource)])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert [x.engine for x in found.collect()] == ["one"] * 3 and not left.collect()


def test_records_of_pages_field_by_field():
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.string())]))
    values = [[{"a": 1, "b": "x"}, {"a": None, "b": None}], None, [], [{"a": 2, "b": "y"}], [None, {"a": 3, "b": "z"}]]
    for some in (values[:4], values, [None], []):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(some, kind)], ["doc_id", "regions"])
        assert [E._records(batch.slice(k)) for k in range(3)] == [batch.slice(k).to_pylist() for k in range(3)]
