"""Page quality: confidence, content and layout metrics, score, level, issues; document roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as X
from foliospark.operators.grouping import PAGE


def page_metrics(regions: DataFrame, width: float = 700, height: float = 900) -> DataFrame:
    """Mean confidence, coverage and number of low-confidence regions, as an engine reports them for a page."""
    coverage = F.least(F.sum(G.area()) / F.lit(float(width * height)), F.lit(1.0)) if width * height else F.lit(0.0)
    return regions.groupBy(*PAGE).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("overall_confidence"), coverage.alias("text_coverage_ratio"), F.count_if(F.col("confidence") < 0.5).alias("low_confidence_regions"), F.count("*").alias("n_regions"))


def is_high_quality_page() -> Column:
    return (F.col("overall_confidence") >= 0.8) & (F.col("text_coverage_ratio") >= 0.1) & (F.col("n_regions") > 0)


def page_text(regions: DataFrame, minimum: float | None = None, by_order: bool = True) -> DataFrame:
    """Texts of a page's regions in reading order (none: 999) or, with a minimum confidence, by place."""
    kept = regions.where(F.trim("text") != "")
    if minimum is not None:
        kept = kept.where(F.col("confidence") >= minimum)
    order = F.coalesce(F.col("reading_order"), F.lit(999)) if by_order else F.lit(0)
    item = F.struct(order.alias("o"), "y1", "x1", "line_no", "text")
    return kept.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["text"]), " ").alias("page_text"))


def _confidence_aggregates(regions: DataFrame) -> list[Column]:
    c = F.col("confidence")
    return [
        X.mean_in_order(c, *[k for k in ("line_no",) if k in regions.columns]).alias("mean"), F.median(c).alias("median"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std_dev"), F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.sort_array(F.collect_list(c)).alias("_all"),
        F.count_if(c < 0.5).alias("low_count"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium_count"), F.count_if(c >= 0.8).alias("high_count"),
    ]


def _with_confidence(g: DataFrame) -> DataFrame:
    at = lambda q: F.element_at("_all", F.floor(F.size("_all") * F.lit(q)).cast("int") + 1)
    total = F.col("low_count") + F.col("medium_count") + F.col("high_count")
    return g.withColumns({
        "percentile_25": at(0.25), "percentile_75": at(0.75), "percentile_90": at(0.9), "quality_level": X.level(F.col("mean")), "is_consistent": F.col("std_dev") < 0.2, "high_ratio": X.ratio(F.col("high_count"), total),
    }).drop("_all")


def confidence_metrics(regions: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, extremes, nearest-rank percentiles and bands of each page."""
    return _with_confidence(regions.groupBy(*PAGE).agg(*_confidence_aggregates(regions)))


def _content_aggregates() -> list[Column]:
    is_ = lambda *t: F.count_if(F.col("region_type").isin(*t))
    item = F.when(F.trim("text") != "", F.struct(F.coalesce(F.col("reading_order"), F.lit(999)).alias("o"), "y1", "x1", "line_no", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["text"]), " ")
    return [is_("paragraph").alias("paragraphs"), is_("header", "title").alias("headers"), is_("figure").alias("figures"), is_("list").alias("lists"), text.alias("_text")]


def _with_content(g: DataFrame, languages: DataFrame | None, tables: DataFrame | None) -> DataFrame:
    t, listed = F.col("_text"), F.col("_words")
    out = g.withColumn("_words", X.words(t))
    out = out.withColumns({"total_characters": F.length(t), "total_words": F.size(listed), "sentences": X.sentences(t), "repeated_sequences": X.repeats(t), "short_words": X.single_of(listed), "long_words": X.long_of(listed), "_ink": X.chars_of(listed)})
    chars, words = F.col("total_characters"), F.col("total_words")
    out = out.withColumns({
        "average_word_length": X.ratio(F.col("_ink"), words), "special_ratio": X.ratio(X.special(t), chars), "digit_ratio": X.ratio(X.digits(t), chars), "uppercase_ratio": X.ratio(X.upper(t), chars),
        "words_per_sentence": X.ratio(words, F.col("sentences")), "artifact_ratio": X.ratio(F.col("repeated_sequences") + F.col("short_words"), words),
    }).drop("_text", "_words", "_ink")
    shared = lambda df: [c for c in PAGE if c in df.columns]
    for side in (languages, tables):
        if side is not None and not shared(side):
            raise ValueError(f"languages and tables must name {PAGE[0]}")
    out = out.join(languages, shared(languages), "left") if languages is not None else out.withColumn("language", F.lit(None).cast("string"))
    out = out.join(tables, shared(tables), "left") if tables is not None else out.withColumn("n_tables", F.lit(0).cast("long"))
    structure = (F.col("sentences") > 0) & (F.col("words_per_sentence") > 3) & (F.col("average_word_length") > 2)
    return out.fillna(0, ["n_tables"]).withColumns({"language_confidence": F.when(F.col("language").isNotNull(), 0.8).otherwise(0.0), "has_structure": structure})


def content_metrics(regions: DataFrame, languages: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Text statistics of each page. languages: (doc_id[, page_number], language) from a detector; tables: (page, n_tables)."""
    return _with_content(regions.groupBy(*PAGE).agg(*_content_aggregates()), languages, tables)


def overlap_pairs(regions: DataFrame) -> DataFrame:
    """Pairs of a page's regions that overlap or touch, with the area they share."""
    side = lambda p: regions.select(*PAGE, *[F.col(c).alias(f"{p}{c}") for c in ("region_id", "line_no", "x1", "y1", "x2", "y2")])
    a, b = side("a_"), side("b_")
    met = a.join(b, PAGE).where((F.col("a_line_no") < F.col("b_line_no")) & G.overlaps("a_", "b_"))
    return met.select(*PAGE, F.col("a_region_id").alias("region_a"), F.col("b_region_id").alias("region_b"), G.intersection_area("a_", "b_").alias("shared_area"), G.significant_overlap("a_", "b_").alias("significant"))


def _layout_aggregates() -> list[Column]:
    x = F.col("x1")
    return [
        F.count("*").alias("total_regions"), F.max(F.col("reading_order").isNotNull()).alias("order_detected"), F.least(F.greatest(F.size(F.collect_set(F.bround(x, -1))), F.lit(1)), F.lit(5)).cast("long").alias("columns_detected"),
        F.size(F.collect_set("region_type")).cast("long").alias("hierarchy_levels"), F.max(F.col("region_type").isin("title", "header")).alias("_titled"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.coalesce(F.var_samp(x), F.lit(0.0)) / 1000)).alias("consistency"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_boxes"),
    ]


def _with_layout(g: DataFrame) -> DataFrame:
    """g has text_coverage_ratio. Overlaps are counted within the page's array: no join, no pairs on the way."""
    boxes = F.col("_boxes")
    met = lambda a, b: (a["x1"] <= b["x2"]) & (a["x2"] >= b["x1"]) & (a["y1"] <= b["y2"]) & (a["y2"] >= b["y1"])
    after = F.transform(boxes, lambda a, i: F.size(F.filter(F.slice(boxes, i + 2, F.size(boxes)), lambda b: met(a, b))))
    out = g.withColumn("overlaps", F.aggregate(after, F.lit(0).cast("long"), lambda s, n: s + n))
    good = (F.col("text_coverage_ratio") > 0.1) & (F.col("consistency") > 0.7) & (F.col("overlaps") < F.col("total_regions") * 0.1)
    flag = lambda c: F.when(F.col(c), 0.8).otherwise(0.0)
    return out.withColumns({"order_confidence": flag("order_detected"), "title_confidence": flag("_titled"), "good_layout": good}).drop("_titled", "_boxes")


def layout_metrics(regions: DataFrame, pages: DataFrame) -> DataFrame:
    g = regions.groupBy(*PAGE).agg(*_layout_aggregates())
    return _with_layout(g.join(pages.select(*PAGE, "text_coverage_ratio"), PAGE))


def assess(regions: DataFrame, pages: DataFrame | None = None, languages: DataFrame | None = None, content: bool = True, layout: bool = True, minimum: float = 0.6, width: float = 700, height: float = 900) -> DataFrame:
    """One row for each page: all metrics, score, level, issues, recommendations and verdicts.

    All measures come from one aggregate over the page. pages: (page, text_coverage_ratio) as the engine reports it; without, it is
    worked out from the boxes and the page's size.
    """
    coverage = [F.least(F.sum(G.area()) / F.lit(float(width * height)), F.lit(1.0)).alias("text_coverage_ratio")] if pages is None else []
    g = regions.groupBy(*PAGE).agg(*_confidence_aggregates(regions), *_content_aggregates(), *_layout_aggregates(), *coverage)
    if pages is not None:
        g = g.join(pages.select(*PAGE, "text_coverage_ratio"), PAGE)
    out = _with_layout(_with_content(_with_confidence(g), languages, None))
    structure, artifacts = F.col("has_structure") & F.lit(content), F.col("artifact_ratio") if content else F.lit(0.0)
    good = F.col("good_layout") & F.lit(layout)
    score = F.col("mean") * 0.5 + (0.5 + 0.3 * structure.cast("int") + 0.2 * (artifacts < 0.1).cast("int")) * 0.3 + (0.5 + 0.3 * good.cast("int") + 0.2 * (F.col("text_coverage_ratio") > 0.1).cast("int")) * 0.2
    out = out.withColumn("overall_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).withColumn("overall_level", X.level(F.col("overall_score")))
    checks = [(F.col("mean") < minimum, "low_confidence", "reprocess with another engine or other settings")]
    if content:
        checks += [(F.col("artifact_ratio") > 0.2, "garbled_text", "preprocess the image to reduce noise"), (~F.col("has_structure"), "layout_errors", "use layout-aware settings"), (F.col("language_confidence") < 0.5, "language_detection_failed", "name the language")]
    if layout:
        checks += [(F.col("text_coverage_ratio") < 0.05, "missing_text", "see whether the page is blank or an image"), (F.col("overlaps") > F.col("total_regions") * 0.2, "layout_errors", "use another segmentation mode")]
    present = lambda pairs: F.filter(F.array(*[F.when(bad, F.lit(v)) for bad, v in pairs]), lambda v: v.isNotNull())
    spread = (F.col("std_dev") > 0.3, "check the image: confidence varies")
    advice = [(checks[0][0], checks[0][2]), spread, *[(bad, a) for bad, _, a in checks[1:]]]
    out = out.withColumn("issues", present([(bad, i) for bad, i, _ in checks])).withColumn("recommendations", F.array_distinct(present(advice)))
    major = F.filter("issues", lambda i: i.isin("low_confidence", "garbled_text", "missing_text", "poor_image_quality"))
    critical = F.arrays_overlap("issues", F.array(F.lit("garbled_text"), F.lit("missing_text"), F.lit("poor_image_quality")))
    return out.withColumn("acceptable_for_rag", (F.col("overall_score") >= 0.6) & ~critical).withColumn("needs_reprocessing", (F.col("overall_score") < 0.6) | (F.size(major) > 0) | (F.col("high_ratio") < 0.5))


def issue_details(assessed: DataFrame) -> DataFrame:
    """One row for each issue of a page, with what was found."""
    text = (
        F.when(F.col("issue") == "low_confidence", F.concat(F.lit("mean confidence "), X.two(F.col("mean"))))
        .when(F.col("issue") == "garbled_text", F.concat(F.lit("artifact ratio "), X.two(F.col("artifact_ratio"))))
        .when(F.col("issue") == "missing_text", F.concat(F.lit("text coverage "), X.two(F.col("text_coverage_ratio"))))
        .when((F.col("issue") == "layout_errors") & (F.col("overlaps") > F.col("total_regions") * 0.2), F.concat(F.lit("overlapping regions "), F.col("overlaps").cast("string")))
        .otherwise(F.regexp_replace("issue", "_", " "))
    )
    return assessed.select("*", F.explode(F.array_distinct("issues")).alias("issue")).select(*PAGE, "issue", text.alias("description"))


def detailed_report(assessed: DataFrame) -> DataFrame:
    """A nested report of each page as JSON."""
    two = lambda c: F.round(F.col(c) + F.lit(1e-9), 2)
    word = lambda c, yes, no: F.when(c, yes).otherwise(no)
    report = F.struct(
        F.struct(two("overall_score").alias("score"), F.col("overall_level").alias("level"), two("mean").alias("confidence"), two("text_coverage_ratio").alias("coverage"), "total_words", F.size("issues").alias("issues")).alias("summary"),
        F.struct("high_count", "medium_count", "low_count", word(F.col("is_consistent"), "consistent", "variable").alias("consistency")).alias("confidence"),
        F.struct(word(F.col("has_structure"), "good", "poor").alias("structure"), "language", "figures", "headers", F.col("n_tables").alias("tables")).alias("content"),
        F.struct(word(F.col("good_layout"), "good", "poor").alias("quality"), "columns_detected", word(F.col("order_detected"), "detected", "not_detected").alias("reading_order")).alias("layout"),
        "issues", F.array_sort("recommendations").alias("recommendations"), F.struct("acceptable_for_rag", "needs_reprocessing").alias("verdict"),
    )
    return assessed.select(*PAGE, F.to_json(report).alias("report"))


def document_quality(assessed: DataFrame) -> DataFrame:
    g = assessed.groupBy("doc_id").agg(
        F.avg("overall_score").alias("overall_quality_score"), F.avg("mean").alias("average_confidence"), F.min("mean").alias("min_page_confidence"), F.max("mean").alias("max_page_confidence"),
        F.sum("total_characters").alias("total_characters"), F.sum("n_tables").alias("tables_detected"), F.sum("figures").alias("figures_detected"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.count_if("acceptable_for_rag").alias("acceptable_pages"), F.count("*").alias("total_pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "overall_score"))), lambda p: F.format_string("%.3f", p["overall_score"] + F.lit(1e-9))), ",").alias("page_scores"),
    )
    return g


def common_issues(assessed: DataFrame) -> DataFrame:
    """Issues that occur more often than on a quarter of a document's pages; twice on a page counts twice."""
    pages = assessed.groupBy("doc_id").agg(F.count("*").alias("pages"))
    counts = assessed.select("doc_id", F.explode("issues").alias("issue")).groupBy("doc_id", "issue").agg(F.count("*").alias("occurrences"))
    return counts.join(pages, "doc_id").where(F.col("occurrences") > F.col("pages") * 0.25).select("doc_id", "issue", "occurrences", "pages")


def recommendations(assessed: DataFrame) -> DataFrame:
    return assessed.select("doc_id", F.explode("recommendations").alias("recommendation")).distinct()
