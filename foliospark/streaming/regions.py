"""The region pipeline over streams: pages come whole, so page state isn't needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliospark.functions import text as X
from foliospark.plans.pipeline import process
from foliospark.schema import ChunkerConfig


def read_regions(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_stream(regions: DataFrame, out: str, checkpoint: str, strategy: str = "layout_aware", config: ChunkerConfig = ChunkerConfig()) -> StreamingQuery:
    """Each micro-batch's chunks, page scores and quarantined regions under `out`, a folder for each batch, so that one that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        done = process(batch, strategy, config)
        for name, df in (("chunks", done.chunks), ("page_quality", done.page_quality), ("quarantined", done.quarantined)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
        batch.unpersist()

    return regions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_files(files: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Files (path, length, mtime) whose content key wasn't seen within the delay."""
    keyed = files.withColumn("cache_key", X.cache_key(F.col("path"), F.col("length").cast("string"), F.col("mtime").cast("string")))
    return keyed.withWatermark("mtime", delay).dropDuplicatesWithinWatermark(["cache_key"])


def confidence_windows(pages: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean confidence and count of pages (processed_at, engine, overall_confidence) by event-time window and engine."""
    return pages.withWatermark("processed_at", late).groupBy(F.window("processed_at", window), "engine").agg(F.count("*").alias("pages"), F.avg("overall_confidence").alias("mean_confidence"))


def run_to_end(query: StreamingQuery, check: Callable[[], None] | None = None) -> None:
    query.awaitTermination()
    if check:
        check()
