"""Runs of neighbouring rows: a row joins its predecessor's group or opens the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G

PAGE = ["doc_id", "page_number"]
BOX = ["x1", "y1", "x2", "y2"]


def order_key(name: str = "reading_order", zero_is_missing: bool = True) -> Column:
    """Reading order for sorting: missing last; 0 counts as missing unless told otherwise."""
    ro = F.col(name).cast("double")
    return F.coalesce(F.nullif(ro, F.lit(0.0)) if zero_is_missing else ro, F.lit(float("inf")))


def chunk_order(zero_is_missing: bool = True) -> list[Column]:
    return [order_key(zero_is_missing=zero_is_missing), F.col("y1"), F.col("x1"), F.col("line_no")]


def place_order() -> list[Column]:
    return [F.col("y1"), F.col("x1"), F.col("line_no")]


def islands(df: DataFrame, keys: list[str], order: list[Column], joined: Callable[[str, str], Column], fields: list[str] | None = None, name: str = "group_no") -> DataFrame:
    """Number the groups of each partition from 0. joined(p, q) says whether a row (columns of prefix q, empty) belongs with the one before (prefix p)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fields = fields or [*BOX, "confidence"]
    seen = df
    for f in fields:
        seen = seen.withColumn(f"prev_{f}", F.lag(f).over(w))
    # least() and greatest() pass over nulls, so the first row has to be told apart by itself.
    seen = seen.withColumn("_break", F.when(F.lag(F.lit(1)).over(w).isNotNull() & F.coalesce(joined("prev_", ""), F.lit(False)), 0).otherwise(1))
    return seen.withColumn(name, (F.sum("_break").over(w) - 1).cast("int")).drop("_break", *[f"prev_{f}" for f in fields])


def same_paragraph(p: str, q: str) -> Column:
    gap = F.col(q + "y1") - F.col(p + "y2")
    shared = F.least(F.col(p + "x2"), F.col(q + "x2")) - F.greatest(F.col(p + "x1"), F.col(q + "x1"))
    return (gap < (G.height(p) + G.height(q)) / 2 * 0.5) | (shared > F.least(G.width(p), G.width(q)) * 0.7)


def same_list(p: str, q: str) -> Column:
    return (F.col(q + "y1") - F.col(p + "y2")) < (G.height(p) + G.height(q)) / 2


def near(p: str, q: str) -> Column:
    return G.proximate(p, q)


def same_confidence(p: str, q: str) -> Column:
    return G.spatially_close(p, q) & (F.abs(F.col(p + "confidence") - F.col(q + "confidence")) <= F.lit(0.2))


def same_row(p: str, q: str, tolerance: float = 20) -> Column:
    return F.abs(F.col(q + "y1") - F.col(p + "y1")) <= tolerance


def merged(regions: DataFrame) -> DataFrame:
    """Runs of regions that overlap their predecessor by more than 0.3 of the smaller, as one region each."""
    runs = islands(regions, PAGE, place_order(), lambda p, q: G.significant_overlap(p, q))
    at = F.struct("y1", "x1", "line_no")
    types = F.array_sort(F.collect_list("region_type"))
    g = runs.groupBy(*PAGE, "group_no").agg(
        F.count("*").cast("int").alias("n_regions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "text"))), lambda r: r["text"]), " ").alias("text"),
        F.avg("confidence").alias("confidence"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        types.alias("types"), F.min("reading_order").alias("reading_order"),
    )
    # The type that occurs most; of several, the first by name.
    count = lambda t: F.size(F.filter("types", lambda v: v == t))
    best = F.array_sort(F.transform(F.array_distinct("types"), lambda t: F.struct((-count(t)).alias("n"), t.alias("t"))))
    return g.withColumn("region_type", F.element_at(best, 1)["t"]).drop("types")
