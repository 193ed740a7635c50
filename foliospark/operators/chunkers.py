"""Layout-aware and confidence-based chunking of regions, with chunk metadata and flags.

Input regions have reading_order and region_type (operators.layout). Each chunk keeps the
array of its regions, so all of its metadata is array arithmetic and nothing is joined back.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.functions.splitters import split_texts
from foliospark.operators import packing as P
from foliospark.operators.classify import hierarchy_level
from foliospark.operators.grouping import PAGE, chunk_order, islands, near, order_key, same_confidence, same_list, same_paragraph
from foliospark.schema import ChunkerConfig

FIELDS = ["region_id", "text", "confidence", "region_type", "reading_order", "x1", "y1", "x2", "y2"]
BUCKETS = ["header", "title", "paragraph", "list", "caption", "other", "footer"]
INF = float("inf")


def optional(regions: DataFrame) -> DataFrame:
    """Regions with the optional fields that they lack as nulls."""
    for name, kind in (("language", "string"), ("font_size", "double"), ("is_bold", "boolean"), ("is_italic", "boolean")):
        if name not in regions.columns:
            regions = regions.withColumn(name, F.lit(None).cast(kind))
    return regions


ALL_FIELDS = [*FIELDS, "language", "font_size", "is_bold", "is_italic"]


def _ordered(regions: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    return regions.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int"))


def layout_chunks(regions: DataFrame, config: ChunkerConfig = ChunkerConfig(), tables: DataFrame | None = None) -> DataFrame:
    """Chunks by structure. tables: (doc_id, page_number, table_idx, text, x1, y1, x2, y2), each a chunk if long enough."""
    c = F.col
    kept = optional(regions).where(c("confidence") >= config.confidence_threshold)
    kept = kept.withColumn("bucket", F.when(c("region_type").isin(*[b for b in BUCKETS if b != "other"]), c("region_type")).otherwise("other"))
    # One pass over a page for all buckets: regions outside of them go by place alone.
    order = [F.when(c("bucket") == "other", F.lit(0.0)).otherwise(order_key(zero_is_missing=config.zero_is_missing)), c("y1"), c("x1"), c("line_no")]
    kept = _ordered(kept, [*PAGE, "bucket"], order)

    def joined(p: str, q: str) -> Column:
        lists = same_list(p, q) if config.preserve_lists else F.lit(False)
        return F.when(c("bucket") == "paragraph", same_paragraph(p, q)).when(c("bucket") == "list", lists).when(c("bucket") == "other", near(p, q)).otherwise(c("bucket") == "footer")

    runs = islands(kept, [*PAGE, "bucket"], [c("pos")], joined)
    if config.preserve_headers:
        # Only the last short header of a page is kept; it opens the page's first group of paragraphs as well.
        page = Window.partitionBy(*PAGE)
        short = (c("bucket") == "header") & (F.length(F.trim("text")) < config.max_header_chunk_size)
        opens = short & (c("pos") == F.max(F.when(short, c("pos"))).over(page)) & F.max(c("bucket") == "paragraph").over(page)
        own = F.struct(c("bucket").alias("b"), c("pos").alias("p"), c("group_no").alias("g"))
        first = F.struct(F.lit("paragraph").alias("b"), F.lit(0).alias("p"), F.lit(0).alias("g"))
        placed = runs.withColumn("opens", opens).withColumn("at", F.explode(F.when(c("opens"), F.array(own, first)).otherwise(F.array(own))))
        runs = placed.withColumn("bucket", c("at.b")).withColumn("pos", c("at.p")).withColumn("group_no", c("at.g")).drop("at", "opens")
    items = P.collect_items(runs, [*PAGE, "bucket", "group_no"], c("pos"), ALL_FIELDS).withColumn("length", P.content_length(c("items")))
    whole = c("bucket").isin("header", "title", "caption", "footer") | (F.lit(not config.preserve_lists) & (c("bucket") == "list"))
    kept_always = (c("bucket") == "header") & (~F.lit(config.preserve_headers) | (c("length") >= config.max_header_chunk_size))
    items = items.where(~whole | (c("length") >= config.min_chunk_size) | kept_always)
    raw = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["raw"]) + F.size("items") - 1
    fits = whole | (F.when(c("bucket") == "list", raw).otherwise(c("length")) <= config.chunk_size)
    chunks = P.pack(items, config.chunk_size, F.when(c("bucket") == "list", 0).otherwise(config.chunk_overlap), config.min_chunk_size, fits).drop("length")
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), c("bucket")).cast("int")
    chunks = chunks.withColumn("bucket_rank", rank).withColumn("strip", ~((c("bucket") == "list") & (c("kind") == "whole") & F.lit(config.preserve_lists)))
    if tables is not None and config.preserve_tables:
        chunks = chunks.unionByName(table_items(tables, config))
    described = describe(chunks, config, "layout_aware")
    return index_chunks(described, ["order_key", "bucket_rank", "group_no", "chunk_no"])


def table_items(tables: DataFrame, config: ChunkerConfig) -> DataFrame:
    """Tables as chunks of one pseudo-region, after all others."""
    null = lambda kind: F.lit(None).cast(kind)
    item = F.struct(
        F.lit(0).alias("pos"), F.length(F.trim("text")).cast("long").alias("n"), F.length("text").cast("long").alias("raw"), F.concat(F.lit("table_"), "table_idx").alias("region_id"), F.col("text"), F.lit(0.9).cast("double").alias("confidence"),
        F.lit("table").alias("region_type"), null("int").alias("reading_order"), "x1", "y1", "x2", "y2", null("string").alias("language"), null("double").alias("font_size"), null("boolean").alias("is_bold"), null("boolean").alias("is_italic"),
    )
    long = tables.where(F.length(X.strip(F.col("text"))) >= config.min_chunk_size)
    return long.select(*PAGE, F.lit("table").alias("bucket"), F.col("table_idx").alias("group_no"), F.array(item).alias("items"), F.lit(0).alias("chunk_no"), F.lit("whole").alias("kind"), F.lit(len(BUCKETS) + 1).alias("bucket_rank"), F.lit(False).alias("strip"))


def confidence_chunks(regions: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """Chunks of neighbouring regions of one confidence category."""
    kept = optional(regions).where(F.col("confidence") >= config.confidence_threshold)
    if not config.separate_levels:
        return mixed_chunks(regions, config)
    c = F.col("confidence")
    kept = kept.withColumn("bucket", F.when(c >= config.high, "high").when(c >= config.medium, "medium").when(c >= config.low, "low")).where("bucket is not null")
    kept = _ordered(kept, [*PAGE, "bucket"], chunk_order(config.zero_is_missing))
    runs = islands(kept, [*PAGE, "bucket"], [F.col("pos")], same_confidence)
    items = P.collect_items(runs, [*PAGE, "bucket", "group_no"], F.col("pos"), ALL_FIELDS)
    chunks = P.pack(items, config.chunk_size, config.chunk_overlap, config.min_chunk_size)
    rank = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("bucket")).cast("int")
    described = describe(chunks.withColumn("bucket_rank", rank).withColumn("strip", F.lit(True)), config, "confidence_based")
    return index_chunks(described, ["order_key", "first_y1", "first_x1", "bucket_rank", "group_no", "chunk_no"])


def mixed_chunks(regions: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """Chunks that watch the spread of confidences instead of separating categories."""
    kept = optional(regions).where(F.col("confidence") >= config.confidence_threshold)
    kept = _ordered(kept, PAGE, chunk_order(config.zero_is_missing)).withColumn("bucket", F.lit("mixed")).withColumn("group_no", F.lit(0))
    items = P.collect_items(kept, [*PAGE, "bucket", "group_no"], F.col("pos"), ALL_FIELDS)
    chunks = P.pack_mixed(items, config.chunk_size, config.chunk_overlap, config.variance_threshold).withColumn("kind", F.lit("whole"))
    described = describe(chunks.withColumn("bucket_rank", F.lit(1)).withColumn("strip", F.lit(True)), config, "confidence_based")
    return index_chunks(described, ["order_key", "first_y1", "first_x1", "chunk_no"])


def table_preserving_chunks(regions: DataFrame, config: ChunkerConfig = ChunkerConfig(), tables: DataFrame | None = None) -> DataFrame:
    """Layout chunks in which every table is a chunk of its own, whole: neither the size nor the least size applies to it."""
    made = layout_chunks(regions, config)
    if tables is not None:
        whole = describe(table_items(tables, replace(config, min_chunk_size=0, preserve_tables=True)), config, "table_preserving")
        made = made.select(*whole.columns).unionByName(whole)
    return index_chunks(made.withColumn("strategy", F.lit("table_preserving")), ["order_key", "bucket_rank", "group_no", "chunk_no"])


def hybrid_chunks(regions: DataFrame, config: ChunkerConfig = ChunkerConfig(), share: float = 0.5) -> DataFrame:
    """Layout chunks, those of more than `share` of the chunk size cut where the topic changes from one sentence to the next.

    A piece has the region ids, box and confidences of its chunk, and words, characters and filter reason of its own.
    """
    made = layout_chunks(regions, config)
    long = F.length("content") > share * config.chunk_size
    texts = made.where(long).select(F.xxhash64("chunk_id").alias("doc_id"), F.col("content").alias("text"))
    pieces = split_texts(texts, "semantic").select(F.col("doc_id").alias("_key"), F.col("chunk_index").alias("_piece"), F.col("chunk").alias("_text"))
    cut = made.where(long).withColumn("_key", F.xxhash64("chunk_id")).join(pieces, "_key")
    cut = cut.withColumns({"content": F.col("_text"), "word_count": X.word_count(F.col("_text")), "character_count": F.length("_text")})
    cut = cut.withColumn("filter_reason", filter_reason(F.col("content"), F.col("average_confidence"), config)).withColumn("is_filtered", F.col("filter_reason").isNotNull())
    both = cut.drop("_key", "_text").unionByName(made.where(~long).withColumn("_piece", F.lit(0)))
    return index_chunks(both.withColumn("strategy", F.lit("hybrid_semantic_layout")), ["order_key", "bucket_rank", "group_no", "chunk_no", "_piece"]).drop("_piece")


def describe(chunks: DataFrame, config: ChunkerConfig, strategy: str) -> DataFrame:
    """Content, statistics and flags of chunks from their items. Chunks of blank content are dropped."""
    items = F.col("items")
    get = lambda f: F.transform(items, lambda x: x[f])
    conf, types, n = get("confidence"), get("region_type"), F.size("items").cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    content = F.array_join(F.transform(items, lambda x: F.when(F.col("strip"), F.trim(x["text"])).otherwise(x["text"])), " ")
    key = lambda x: F.coalesce(F.nullif(x["reading_order"], F.lit(0)) if config.zero_is_missing else x["reading_order"], F.lit(2147483647))
    earliest = F.array_min(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x["reading_order"].alias("ro"))))["ro"]
    out = chunks.withColumn("content", content).where(F.length(F.trim("content")) > 0)
    # To nine decimals, so that the order of addition can't move a chunk over a threshold.
    out = out.withColumn("average_confidence", F.round(total(conf) / n, 9))
    out = out.withColumn("confidence_variance", total(F.transform(conf, lambda v: (v - F.col("average_confidence")) * (v - F.col("average_confidence")))) / n)
    joined = F.array_join(get("text"), " ")
    langs = F.array_distinct(F.filter(get("language"), lambda v: v.isNotNull()))
    sizes = F.filter(get("font_size"), lambda v: v.isNotNull() & (v != 0))
    out = out.select(
        *PAGE, "bucket", "bucket_rank", "group_no", "chunk_no", "kind", "content", "average_confidence", "confidence_variance", F.array_min(conf).alias("min_confidence"), F.array_max(conf).alias("max_confidence"),
        X.word_count(joined).alias("word_count"), F.length(joined).alias("character_count"), F.array_join(F.array_sort(F.array_distinct(types)), ",").alias("region_types"), F.array_join(get("region_id"), ",").alias("region_ids"),
        *[F.array_contains(types, t).alias(a) for t, a in (("table", "has_tables"), ("figure", "has_figures"), ("header", "is_header"), ("footer", "is_footer"), ("title", "is_title"))],
        hierarchy_level(types).alias("hierarchy_level"), earliest.alias("reading_order"), (F.size(langs) > 1).alias("contains_multiple_languages"),
        F.exists(items, lambda x: F.coalesce(x["is_bold"], F.lit(False))).alias("has_bold_text"), F.exists(items, lambda x: F.coalesce(x["is_italic"], F.lit(False))).alias("has_italic_text"), F.array_min(sizes).alias("min_font_size"), F.array_max(sizes).alias("max_font_size"),
        F.array_min(get("x1")).alias("x1"), F.array_min(get("y1")).alias("y1"), F.array_max(get("x2")).alias("x2"), F.array_max(get("y2")).alias("y2"),
        F.element_at(get("x1"), 1).alias("first_x1"), F.element_at(get("y1"), 1).alias("first_y1"), F.size(F.array_distinct(types)).alias("n_types"), F.lit(strategy).alias("strategy"),
    )
    ro = F.nullif("reading_order", F.lit(0)) if config.zero_is_missing else F.col("reading_order")
    reason = filter_reason(F.col("content"), F.col("average_confidence"), config)
    return out.withColumn("order_key", F.coalesce(ro.cast("double"), F.lit(INF))).withColumn("filter_reason", reason).withColumn("is_filtered", F.col("filter_reason").isNotNull()).withColumn("needs_review", (F.col("confidence_variance") > 0.3) | (F.col("n_types") > 3) | (F.col("min_confidence") < 0.3))


def filter_reason(content: Column, average: Column, config: ChunkerConfig) -> Column:
    # The words are worked out once, as the variable of the inner function.
    artifacts = F.exists(F.array(X.words(content)), lambda w: X.ratio(X.single_of(w), F.size(w)) > 0.5)
    return (
        F.when(F.length(X.strip(content)) < config.min_chunk_size, "Content too short")
        .when(average < config.confidence_threshold, F.concat(F.lit("Low confidence: "), X.two(average)))
        .when(artifacts, "Too many single-character artifacts")
        .when(X.ratio(X.alnum(content), F.length(content)) < 0.3, "Mostly non-alphanumeric content")
    )


def index_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """chunk_index over the document, in page order, and a chunk_id that names document, page, strategy and index."""
    w = Window.partitionBy("doc_id").orderBy("page_number", *order)
    out = chunks.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("int"))
    near_by = Window.partitionBy("doc_id").orderBy("chunk_index")
    out = out.withColumn("chunk_id", F.sha2(F.concat_ws("|", "doc_id", "page_number", "strategy", "chunk_index"), 256))
    return out.withColumn("previous_chunk_id", F.lag("chunk_id").over(near_by)).withColumn("next_chunk_id", F.lead("chunk_id").over(near_by))


def notes(chunks: DataFrame) -> DataFrame:
    """What the confidence chunker says about each chunk."""
    text = F.concat_ws(
        "; ", F.concat(F.lit("Confidence category: "), "bucket"), F.concat(F.lit("Confidence range: "), X.two(F.col("min_confidence")), F.lit(" - "), X.two(F.col("max_confidence"))),
        F.concat(F.lit("Average confidence: "), X.two(F.col("average_confidence"))), F.concat(F.lit("Confidence variance: "), F.format_string("%.3f", F.col("confidence_variance") + F.lit(1e-9))),
    )
    return chunks.withColumn("processing_notes", text)


def is_reliable() -> Column:
    return (F.col("average_confidence") >= 0.7) & (F.col("min_confidence") >= 0.5) & (F.col("word_count") >= 3)


def is_high_quality() -> Column:
    return (F.col("average_confidence") >= 0.8) & (F.col("min_confidence") >= 0.6)


def suitable_for_rag() -> Column:
    return ~F.col("is_filtered") & is_reliable() & (X.word_count(X.clean_chunk(F.col("content"))) >= 3)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    a = F.col("average_confidence")
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.count_if("is_filtered").alias("filtered_chunks"), F.count_if(a >= 0.8).alias("high_quality_chunks"), F.count_if("needs_review").alias("needs_review_chunks"),
        F.avg(a).alias("average_confidence"), F.min(a).alias("min_confidence"), F.max(a).alias("max_confidence"), F.avg("word_count").alias("average_word_count"), F.sum("word_count").alias("total_words"), F.min("word_count").alias("min_words"), F.max("word_count").alias("max_words"),
    )


def confidence_distribution(chunks: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    a, n = F.col("average_confidence"), F.count("*")
    high, medium = F.count_if(a >= config.high), F.count_if((a >= config.medium) & (a < config.high))
    return chunks.agg(
        n.alias("total_chunks"), high.alias("high_confidence_chunks"), medium.alias("medium_confidence_chunks"), F.count_if((a >= config.low) & (a < config.medium)).alias("low_confidence_chunks"),
        F.avg(a).alias("average_confidence"), F.min(a).alias("min_confidence"), F.max(a).alias("max_confidence"), F.var_pop(a).alias("confidence_variance"),
        X.ratio(high, n).alias("high_confidence_ratio"), X.ratio(high + medium, n).alias("reliable_chunks_ratio"),
    )


def rag_records(chunks: DataFrame) -> DataFrame:
    """Records for a vector store: clean content and flat metadata."""
    return chunks.select(
        F.col("chunk_id").alias("id"), X.clean_chunk(F.col("content")).alias("content"), "doc_id", "page_number", "chunk_index", F.col("average_confidence").alias("confidence"), "word_count", "region_types", "has_tables", "is_header", "hierarchy_level", F.col("strategy").alias("chunking_strategy"),
    )


def context_summary(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.col("page_number").alias("page"), "word_count", X.two(F.col("average_confidence")).alias("confidence"), "region_types", "has_tables", "hierarchy_level", is_reliable().alias("is_reliable"))
