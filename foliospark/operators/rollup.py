"""Document results: metrics, rates and the final score from page assessments and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators.chunkers import suitable_for_rag


def success_rate(processed: Column, failed: Column) -> Column:
    return X.ratio(processed, processed + failed)


def pages_per_minute(pages: Column, seconds: Column) -> Column:
    return X.ratio(pages * 60, seconds)


def document_result(assessed: DataFrame, chunks: DataFrame, errors: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """One row for each document. Pages that aren't acceptable count as failed besides being processed.

    errors: records of failed steps; a document with one that can't be recovered has failed, and is there even if nothing
    of it was processed. durations: (doc_id, seconds); they add seconds and pages_per_minute.
    """
    pages = assessed.groupBy("doc_id").agg(F.count("*").alias("pages_processed"), F.count_if(~F.col("acceptable_for_rag")).alias("pages_failed"), X.mean_in_order(F.col("overall_score"), "page_number").alias("page_score"), F.sum("total_characters").alias("assessed_characters"), X.mean_in_order(F.col("mean"), "page_number").alias("page_confidence"))
    ready = chunks.withColumn("_ready", suitable_for_rag())
    parts = ready.groupBy("doc_id").agg(
        F.count("*").alias("total_chunks"), F.count_if(F.col("average_confidence") >= 0.8).alias("high_quality_chunks"), F.count_if("is_filtered").alias("filtered_chunks"), F.count_if("_ready").alias("rag_ready_chunks"),
        X.mean_in_order(F.col("average_confidence"), "page_number", "chunk_index").alias("chunk_confidence"), F.sum(F.length("content")).alias("chunk_characters"),
    )
    out = pages.join(parts, "doc_id", "left").fillna(0, ["total_chunks", "high_quality_chunks", "filtered_chunks", "rag_ready_chunks", "chunk_characters"])
    failed = errors and errors.groupBy("doc_id").agg(F.count("*").alias("n_errors"), F.max(~F.col("is_recoverable")).alias("fatal"))
    counts = ["pages_processed", "pages_failed", "total_chunks", "high_quality_chunks", "filtered_chunks", "rag_ready_chunks", "chunk_characters", "assessed_characters", "page_score", "page_confidence"]
    out = out.join(failed, "doc_id", "full").fillna(0, counts) if errors is not None else out.withColumn("n_errors", F.lit(0).cast("long")).withColumn("fatal", F.lit(False))
    out = out.withColumn("success_rate", success_rate(F.col("pages_processed"), F.col("pages_failed"))).withColumn("quality_rate", X.ratio(F.col("high_quality_chunks"), F.col("total_chunks")))
    out = out.withColumn("average_confidence", F.coalesce("chunk_confidence", "page_confidence"))
    out = out.withColumn("overall_score", F.when(F.col("total_chunks") > 0, (F.col("average_confidence") + F.col("success_rate") + F.col("quality_rate")) / 3).otherwise(F.col("page_score")))
    out = out.withColumn("total_text", F.greatest("assessed_characters", "chunk_characters")).withColumn("is_high_quality", (F.col("average_confidence") >= 0.8) & (F.col("success_rate") >= 0.9) & (F.col("quality_rate") >= 0.7))
    status = F.when(F.coalesce("fatal", F.lit(False)), "failed").otherwise("completed")
    out = out.withColumn("status", status).withColumn("is_successful", (F.col("status") == "completed") & (F.col("total_chunks") > 0)).withColumn("has_errors", F.coalesce("n_errors", F.lit(0)) > 0)
    if durations is not None:
        out = out.join(durations.select("doc_id", "seconds"), "doc_id", "left").withColumn("pages_per_minute", pages_per_minute(F.col("pages_processed"), F.coalesce("seconds", F.lit(0.0))))
    return out.drop("page_score", "page_confidence", "chunk_confidence", "assessed_characters", "chunk_characters", "n_errors", "fatal")


def summary(results: DataFrame) -> DataFrame:
    return results.select("doc_id", "status", "pages_processed", "total_chunks", "rag_ready_chunks", X.two(F.col("average_confidence")).alias("average_confidence"), X.two(F.col("overall_score")).alias("overall_quality"), X.two(F.col("success_rate")).alias("success_rate"))


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("documents"), F.count_if("is_successful").alias("successful"), F.count_if(~F.col("is_successful")).alias("failed"))


def text_by_confidence(chunks: DataFrame, minimum: float = 0.8) -> DataFrame:
    kept = chunks.where(F.col("average_confidence") >= minimum).select("doc_id", "chunk_index", X.clean_chunk(F.col("content")).alias("c"))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "c"))), lambda x: x["c"]), " ").alias("document_text"))
