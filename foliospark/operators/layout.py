"""Reading order, columns, types and hierarchy of a page's regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.operators.classify import layout_type
from foliospark.operators.grouping import PAGE, place_order


def reading_order(regions: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy(*place_order())
    return regions.withColumn("reading_order", (F.row_number().over(w) - 1).cast("int"))


def refine_types(regions: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE)
    current = F.col("region_type") if "region_type" in regions.columns else F.lit("unknown")
    sized = regions.withColumn("_w", F.max("x2").over(w)).withColumn("_h", F.max("y2").over(w))
    return sized.withColumn("region_type", layout_type(F.col("_w"), F.col("_h"), current)).drop("_w", "_h")


def _page_columns(items: Column, min_width: float, gap: float) -> Column:
    """(left, right) of a page's columns from its regions, by left: pairs of a cluster of left edges with the next cluster of right ones.

    A cluster stands for its least member: an edge that is more than `gap` from the one before. A column is valid with two regions
    and 50 characters; a page without a valid one has its full width.
    """
    sides = lambda c: F.array_sort(F.array_distinct(F.transform(items, lambda r: r[c])))
    opening = lambda edges: F.filter(edges, lambda v, k: (k == 0) | (v - F.get(edges, k - 1) > gap))
    rights = opening(sides("x2"))
    pairs = F.transform(opening(sides("x1")), lambda v: F.struct(v.alias("left"), F.array_min(F.filter(rights, lambda r: r > v)).alias("right")))
    inside = lambda c: F.filter(items, lambda r: ((r["x1"] + r["x2"]) / 2).between(c["left"], c["right"]))
    valid = F.filter(pairs, lambda c: (c["right"] - c["left"] >= min_width) & (F.size(inside(c)) >= 2) & (F.aggregate(inside(c), F.lit(0), lambda n, r: n + r["len"]) >= 50))
    whole = F.array(F.struct(F.array_min(sides("x1")).alias("left"), F.array_max(sides("x2")).alias("right")))
    return F.when(F.size(valid) > 0, valid).otherwise(whole)


def _items(*more: str) -> Column:
    return F.collect_list(F.struct("x1", "x2", F.length("text").alias("len"), *more))


def columns(regions: DataFrame, min_width: float = 100.0, gap: float = 30.0) -> DataFrame:
    """(page, column_index, left, right) of the columns: one aggregate over the page."""
    pages = regions.groupBy(*PAGE).agg(_items().alias("_items"))
    found = pages.select(*PAGE, F.posexplode(_page_columns(F.col("_items"), min_width, gap)).alias("column_index", "c"))
    return found.select(*PAGE, "column_index", "c.left", "c.right")


def column_gaps(cols: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("left")
    return cols.withColumn("gap", F.lead("left").over(w) - F.col("right")).where("gap is not null").select(*PAGE, "column_index", "gap")


def assign_columns(regions: DataFrame, min_width: float = 100.0, gap: float = 30.0) -> DataFrame:
    """column_index of each region: the first column that holds its center, 0 if none does. One window over the page, without a join."""
    page = Window.partitionBy(*PAGE)
    found = regions.withColumn("_columns", _page_columns(_items().over(page), min_width, gap))
    holds = F.transform(F.col("_columns"), lambda c: G.center_x().between(c["left"], c["right"]))
    return found.withColumn("column_index", F.greatest(F.array_position(holds, True) - 1, F.lit(0)).cast("int")).drop("_columns")


def column_reading_order(regions: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """Order for pages of several columns: column after column, each from top to bottom.

    Regions take, in input order, the first column whose founder's center is near; columns of one region are
    dropped. Pages with fewer than two columns go by place. A fold, as each region depends on those before.
    """
    item = F.struct("line_no", G.center_x().alias("cx"), "y1", "x1", "region_id")
    pages = regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def found(keys, x):
        return F.filter(keys, lambda k: F.abs(x["cx"] - k) <= tolerance)

    keys = F.aggregate("items", F.array().cast("array<double>"), lambda a, x: F.when(F.size(found(a, x)) > 0, a).otherwise(F.concat(a, F.array(x["cx"]))))
    placed = F.transform("items", lambda x: F.struct(F.element_at(found(F.col("keys"), x), 1).alias("key"), x["y1"].alias("y1"), x["x1"].alias("x1"), x["line_no"].alias("line_no"), x["region_id"].alias("region_id")))
    each = pages.withColumn("keys", keys).select(*PAGE, F.explode(placed).alias("r")).select(*PAGE, "r.*")
    column = Window.partitionBy(*PAGE, "key")
    page = Window.partitionBy(*PAGE)
    sized = each.withColumn("members", F.count("*").over(column)).withColumn("many", F.size(F.collect_set(F.when(F.col("members") >= 2, F.col("key"))).over(page)) > 1)
    kept = sized.where(~F.col("many") | (F.col("members") >= 2))
    # Single column: by place. Several: by column, then y1; equal ones keep their input order.
    order = page.orderBy(F.when(F.col("many"), F.col("key")), "y1", F.when(~F.col("many"), F.col("x1")), "line_no")
    return kept.withColumn("column_order", (F.row_number().over(order) - 1).cast("int")).select(*PAGE, "region_id", F.col("key").alias("column_key"), "column_order")


def _owned(regions: DataFrame) -> DataFrame:
    """Each page's _heads (headers and titles, by place) and _rest with the line of headers that owns each, from one aggregate: no join."""
    is_head = F.col("region_type").isin("header", "title")
    pages = regions.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.when(is_head, F.struct("y1", "line_no", "region_id")))).alias("_heads"), F.collect_list(F.when(~is_head, F.struct("y1", "region_id"))).alias("_rest"))
    lines = F.col("_lines")
    # A region belongs to the line of headers above it, unless it lies on the next one.
    owner = lambda r: F.when(~F.array_contains(lines, r["y1"]), F.array_max(F.filter(lines, lambda h: h < r["y1"])))
    owned = F.filter(F.transform("_rest", lambda r: F.struct(r["region_id"].alias("region_id"), owner(r).alias("head_y"))), lambda r: r["head_y"].isNotNull())
    headed = pages.where(F.size("_heads") > 0).withColumn("_lines", F.array_distinct(F.transform("_heads", lambda h: h["y1"])))
    return headed.withColumn("_rest", owned).drop("_lines")


def hierarchy(regions: DataFrame) -> DataFrame:
    """parent_region_id of each region that isn't a header or title: the header above it, until the next one.

    Of headers on one line the last by place in the page owns the rest.
    """
    parent = lambda r: F.element_at(F.filter("_heads", lambda h: h["y1"] == r["head_y"]), -1)["region_id"]
    return _owned(regions).select(*PAGE, F.inline(F.transform("_rest", lambda r: F.struct(r["region_id"].alias("region_id"), parent(r).alias("parent_region_id")))))


def children(regions: DataFrame) -> DataFrame:
    """(header_id, n_children): every header of a line has all regions below it, until the next line of headers."""
    counted = F.transform("_heads", lambda h: F.struct(h["region_id"].alias("header_id"), F.size(F.filter("_rest", lambda r: r["head_y"] == h["y1"])).cast("long").alias("n_children")))
    return _owned(regions).select(*PAGE, F.inline(F.filter(counted, lambda h: h["n_children"] > 0)))


def analyze(regions: DataFrame) -> DataFrame:
    """Reading order, refined types and parents, in one exchange for order and types."""
    typed = refine_types(reading_order(regions))
    return typed.join(hierarchy(typed), [*PAGE, "region_id"], "left")


def statistics(regions: DataFrame) -> DataFrame:
    """Of each page: regions, columns, order coverage, links and the histogram of types, from one aggregate over the page."""
    typed = refine_types(reading_order(regions))
    g = typed.groupBy(*PAGE).agg(_items("y1", "region_type").alias("_items"), F.count("*").alias("total_regions"), F.count("reading_order").alias("ordered"))
    g = g.withColumns({"_heads": F.filter("_items", lambda r: r["region_type"].isin("header", "title")), "_rest": F.transform(F.filter("_items", lambda r: ~r["region_type"].isin("header", "title")), lambda r: r["y1"])})
    g = g.withColumn("_lines", F.array_sort(F.array_distinct(F.transform("_heads", lambda r: r["y1"]))))
    lines, rest = F.col("_lines"), F.col("_rest")
    # A region belongs to the line of headers above it, unless it lies on the next one.
    owned = F.filter(rest, lambda y: (y > F.array_min(lines)) & ~F.array_contains(lines, y))
    owner = F.transform("_owned", lambda y: F.array_max(F.filter(lines, lambda h: h < y)))
    kinds = F.array_sort(F.array_distinct(F.transform("_items", lambda r: r["region_type"])))
    counted = F.transform(kinds, lambda k: F.concat_ws(":", k, F.size(F.filter("_items", lambda r: r["region_type"] == k)).cast("string")))
    out = g.withColumn("_owned", owned).withColumn("_owners", F.array_distinct(owner))
    return out.select(
        *PAGE, "total_regions", F.array_join(F.array_sort(counted), ",").alias("type_distribution"), F.size(_page_columns(F.col("_items"), 100.0, 30.0)).cast("long").alias("columns_detected"),
        F.size(F.filter("_heads", lambda h: F.array_contains("_owners", h["y1"]))).cast("long").alias("with_children"), F.size("_owned").cast("long").alias("with_parents"), (F.col("ordered") / F.col("total_regions")).alias("order_coverage"),
    )
