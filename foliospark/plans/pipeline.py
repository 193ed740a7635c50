"""Whole pipelines: regions to chunks and document results; texts to pieces and scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.functions.splitters import split_texts
from foliospark.operators import chunkers, engines, layout, quality, rollup
from foliospark.schema import ChunkerConfig, TextConfig, validate_regions

CHUNKERS = {"layout_aware": chunkers.layout_chunks, "confidence_based": chunkers.confidence_chunks, "hybrid_semantic_layout": chunkers.hybrid_chunks, "table_preserving": chunkers.table_preserving_chunks}
WITH_TABLES = ("layout_aware", "table_preserving")


@dataclass
class Processed:
    """Results of a batch of documents, each a lazy DataFrame."""

    chunks: DataFrame
    page_quality: DataFrame
    documents: DataFrame
    quarantined: DataFrame
    warnings: list[str] = field(default_factory=list)


def process(regions: DataFrame, strategy: str = "layout_aware", config: ChunkerConfig = ChunkerConfig(), languages: DataFrame | None = None, tables: DataFrame | None = None, durations: DataFrame | None = None, assess_quality: bool = True) -> Processed:
    """Quality sees regions before layout analysis, chunking those after it.

    Regions that break the model's rules are set aside and stop nothing. Rows with an error, as recognize() gives them, are
    failed pages: they make their document one that failed. If quality assessment or layout analysis can't be planned over
    these regions, a warning says so and the rest goes on, without scores or with the regions as they came; recognition
    and chunking have no substitute, so their errors are raised.
    """
    if strategy not in CHUNKERS:
        raise ValueError(f"no chunking strategy {strategy!r}")
    errors = engines.errors_of(regions) if "error" in regions.columns else None
    read = regions.where("error is null").drop("error") if errors is not None else regions
    valid, bad = validate_regions(read)
    warnings: list[str] = []
    plain = valid
    for name, kind in (("region_type", "string"), ("reading_order", "int")):
        if name not in plain.columns:
            plain = plain.withColumn(name, F.lit("unknown" if name == "region_type" else None).cast(kind))
    try:
        assessed = quality.assess(plain, languages=languages) if assess_quality else unassessed(plain)
    except (AnalysisException, ValueError) as e:
        warnings.append(f"Quality assessment failed: {e}")
        assessed = unassessed(plain)
    try:
        analyzed = layout.refine_types(layout.reading_order(valid))
    except AnalysisException as e:
        warnings.append(f"Layout analysis failed: {e}")
        analyzed = plain
    made = CHUNKERS[strategy](analyzed, config, tables) if strategy in WITH_TABLES else CHUNKERS[strategy](analyzed, config)
    return Processed(made, assessed, rollup.document_result(assessed, made, errors, durations), bad, warnings)


def unassessed(regions: DataFrame) -> DataFrame:
    """Pages as document_result() takes them where quality wasn't assessed: none fails."""
    pages = regions.groupBy("doc_id", "page_number").agg(F.avg("confidence").alias("mean"), F.sum(F.length("text")).alias("total_characters"))
    return pages.withColumns({"overall_score": F.lit(0.0), "acceptable_for_rag": F.lit(True)})


SCORES = ("flesch", "fog", "ari", "coleman_liau", "difficult_ratio", "sentence_count", "overall_score_raw", "overall_score_bounded")


def text_scores(docs: DataFrame, *more: str) -> DataFrame:
    """Readability of each whole text, its measures' plain mean, and one from 0 to 1. more: columns to keep."""
    counted, m = X.readability(docs)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    scores = counted.select(
        "doc_id", *more, (m["flesch"] / 100).alias("flesch"), F.least(m["fog"] / 20, F.lit(1.0)).alias("fog"), F.least(m["ari"] / 20, F.lit(1.0)).alias("ari"), F.least(m["coleman_liau"] / 20, F.lit(1.0)).alias("coleman_liau"),
        m["difficult_ratio"].alias("difficult_ratio"), F.col("_sentences").cast("double").alias("sentence_count"),
    )
    values = F.filter(F.array("flesch", "fog", "ari", "coleman_liau", "difficult_ratio", "sentence_count"), lambda v: v.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    # Counts among the measures take the plain mean out of [0, 1]; the bounded one leaves them out.
    bounded = F.coalesce((clamp(F.col("flesch")) + clamp(F.col("fog")) + clamp(F.col("ari")) + clamp(F.col("coleman_liau")) + clamp(F.col("difficult_ratio"))) / 5, F.lit(0.5))
    return scores.withColumn("overall_score_raw", mean).withColumn("overall_score_bounded", bounded)


def merged_texts(elements: DataFrame) -> DataFrame:
    item = F.struct("pos", "text")
    return elements.where("text <> ''").groupBy(F.col("page_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["text"]), "\n\n").alias("text"))


def text_pipeline(elements: DataFrame, config: TextConfig = TextConfig(), strategy: str = "recursive") -> tuple[DataFrame, DataFrame]:
    """Elements (page_id, pos, type, text) to (chunks, scores) of each page's merged text."""
    merged = merged_texts(elements)
    return split_texts(merged, strategy, config.chunk_size, config.chunk_overlap), text_scores(merged)


def scored_chunks(elements: DataFrame, config: TextConfig = TextConfig(), strategy: str = "recursive") -> DataFrame:
    """Chunks, each with the scores of its page's text: those two joined, but pages are read and merged once. Elements without a page are left out, as a join leaves them."""
    scored = text_scores(merged_texts(elements.where("page_id is not null")), "text")
    return split_texts(scored, strategy, config.chunk_size, config.chunk_overlap, SCORES)


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    return docs.select("doc_id", F.posexplode(X.fixed_windows(F.col("text"), size, overlap)).alias("chunk_index", "chunk"))
