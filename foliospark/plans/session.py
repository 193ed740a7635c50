"""Runs of the pipeline under a name: settings, status, counters."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import engines
from foliospark.plans.pipeline import CHUNKERS, Processed, process
from foliospark.schema import STATUSES, STRATEGIES, ProcessingConfig
from foliospark.sources.files import SUPPORTED


@dataclass
class Run:
    name: str
    status: str = "pending"
    seconds: float | None = None
    counts: dict[str, int] = field(default_factory=dict)
    error: str | None = None


class Session:
    """Keeps runs by name. Each is a job group, so Spark's own tools show and cancel it under that name."""

    def __init__(self, spark: SparkSession, config: ProcessingConfig = ProcessingConfig(), strategy: str = "layout_aware"):
        self.spark, self.config, self.strategy, self.runs = spark, config, strategy, {}

    def configure(self, **changes) -> None:
        """Change settings of the processing or, by their names, of the chunker; runs that began keep theirs."""
        if "strategy" in changes:
            strategy = changes.pop("strategy")
            if strategy not in STRATEGIES:
                raise ValueError(f"no chunking strategy {strategy!r}")
            self.strategy = strategy
        own = {k: v for k, v in changes.items() if k in ProcessingConfig.__dataclass_fields__}
        chunker = replace(self.config.chunker, **{k: v for k, v in changes.items() if k not in own})
        self.config = replace(self.config, **({"chunker": chunker} | own))

    def process(self, name: str, regions: DataFrame, path: str, **options) -> Processed:
        """Process the regions and write chunks, page_quality and documents below the path. What each table held is counted as it is written."""
        if self.runs.get(name, Run(name)).status not in ("pending", "completed", "failed", "cancelled"):
            raise ValueError(f"{name!r} is running")
        run = self.runs[name] = Run(name)
        began = time.monotonic()
        self.spark.sparkContext.setJobGroup(name, f"documents of {name}")
        try:
            made = process(regions, self.strategy, self.config.chunker, **options)
            for status, table in (("chunking", "chunks"), ("quality_assessment", "page_quality"), ("completed", "documents")):
                seen = Observation(f"{name}-{table}")
                frame = getattr(made, table)
                failed = [F.count_if(F.col("status") == "failed").alias("failed")] if table == "documents" else []
                frame.observe(seen, F.count(F.lit(1)).alias("rows"), *failed).write.mode("overwrite").parquet(f"{path}/{table}")
                run.counts[table] = seen.get["rows"]
                run.counts |= {"failed": seen.get["failed"]} if table == "documents" else {}
                run.status = status
            return made
        except Exception as e:
            run.status, run.error = "failed", f"{type(e).__name__}: {e}"
            raise
        finally:
            run.seconds = time.monotonic() - began
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def status(self, name: str) -> Run | None:
        return self.runs.get(name)

    def cancel(self, name: str) -> None:
        self.spark.sparkContext.cancelJobGroup(name)
        if name in self.runs:
            self.runs[name].status = "cancelled"

    def metrics(self) -> dict:
        """Counters over all runs, and the settings."""
        done = list(self.runs.values())
        return {
            "runs": {s: sum(r.status == s for r in done) for s in STATUSES if any(r.status == s for r in done)}, "seconds": sum(r.seconds or 0.0 for r in done), "chunks": sum(r.counts.get("chunks", 0) for r in done),
            "documents": sum(r.counts.get("documents", 0) for r in done), "failed_documents": sum(r.counts.get("failed", 0) for r in done), "errors": sorted({r.error.split(":")[0] for r in done if r.error}),
            "engines": {r.engine: r.available for r in engines.status(self.spark).collect()}, "chunking_strategy": self.strategy, "confidence_threshold": self.config.confidence_threshold,
        }

    def chunking_strategies(self) -> list[str]:
        return [s for s in STRATEGIES if s in CHUNKERS or s == "fixed_size"]

    def supported_formats(self) -> list[str]:
        return list(SUPPORTED)

    def close(self) -> None:
        for r in self.runs.values():
            if r.status not in ("completed", "failed", "cancelled"):
                self.cancel(r.name)


@contextmanager
def session(spark: SparkSession, **settings) -> Iterator[Session]:
    """A session that is closed at the end."""
    made = Session(spark)
    made.configure(**settings)
    try:
        yield made
    finally:
        made.close()


def process_documents(regions: DataFrame, path: str, name: str = "documents", **settings) -> Run:
    """One run with the usual settings: what it wrote, and how long it took."""
    with session(regions.sparkSession, **settings) as s:
        s.process(name, regions, path)
        return s.status(name)
