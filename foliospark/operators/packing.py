"""Greedy packing of a group's rows into chunks, as array folds: no loop outside of the JVM.

A group is one array of structs in order, each with n (stripped length), raw (length) and
before (sum of raw before it). What the packer holds is always a suffix of what it has
seen, so the fold's state is its first place, its length and the list of closed ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_items(df: DataFrame, keys: list[str], pos: Column, fields: list[str]) -> DataFrame:
    """One row for each group with its rows in order, as `items`."""
    item = F.struct(pos.alias("pos"), F.length(F.trim("text")).cast("long").alias("n"), F.length("text").cast("long").alias("raw"), *fields)
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped


def content_length(items: Column) -> Column:
    """Of the stripped texts, joined by a space."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["n"]) + F.size(items) - 1


def ranges(items: Column, size: int, overlap: Column) -> Column:
    """Array of (s, e, k): the chunks' places, from s up to e, e left out; k is 1 for the last.

    A chunk closes when the next row would take it over the size; the next begins with as many
    rows of its end as fit the overlap. A row over the size is a chunk by itself, never cut.
    """
    n = F.size(items)
    indexed = F.transform(items, lambda x, i: F.struct(i.alias("i"), x["n"].alias("n"), x["raw"].alias("raw")))
    start = F.struct(F.array().cast("array<struct<s:int,e:int,k:int>>").alias("done"), F.lit(0).alias("s"), F.lit(0).cast("long").alias("len"))

    def suffix(acc: Column, x: Column) -> Column:
        """How many of the held rows, from the end, fit the overlap, and their length."""
        held = F.reverse(F.slice(items, acc["s"] + 1, x["i"] - acc["s"]))
        zero = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("chars"), (overlap <= 0).alias("stop"))
        fit = lambda a, r: ~a["stop"] & (a["chars"] + r["raw"] <= overlap)
        return F.aggregate(held, zero, lambda a, r: F.when(fit(a, r), F.struct((a["k"] + 1).alias("k"), (a["chars"] + r["raw"]).alias("chars"), F.lit(False).alias("stop"))).otherwise(F.struct(a["k"].alias("k"), a["chars"].alias("chars"), F.lit(True).alias("stop"))))

    def step(acc: Column, x: Column) -> Column:
        flush = (acc["len"] + x["n"] > size) & (x["i"] > acc["s"])
        closed = F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), x["i"].alias("e"), F.lit(0).alias("k"))))
        # The suffix is worked out once, for the step's new state, and only where a chunk closes.
        opened = F.transform(F.array(suffix(acc, x)), lambda k: F.struct(closed.alias("done"), (x["i"] - k["k"]).alias("s"), (k["chars"] + F.when(overlap > 0, x["raw"]).otherwise(x["n"])).alias("len")))[0]
        return F.when(flush, opened).otherwise(F.struct(acc["done"].alias("done"), acc["s"].alias("s"), (acc["len"] + x["n"]).alias("len")))

    return F.aggregate(indexed, start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), n.alias("e"), F.lit(1).alias("k")))))


def pack(groups: DataFrame, size: int, overlap: Column | int, min_size: int, fits: Column | None = None) -> DataFrame:
    """Chunks of each group: chunk_no, kind (whole, split or final) and the chunk's items.

    A group that fits is one chunk, however small; of one that was split, a last chunk under
    min_size is dropped.
    """
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap
    fits = fits if fits is not None else content_length(F.col("items")) <= size
    one = F.array(F.struct(F.lit(0).alias("s"), F.size("items").alias("e"), F.lit(2).alias("k")))
    cut = groups.withColumn("range", F.when(fits, one).otherwise(ranges(F.col("items"), size, overlap)))
    each = cut.select("*", F.posexplode("range").alias("chunk_no", "r")).drop("range")
    out = each.withColumn("items", F.slice("items", F.col("r.s") + 1, F.col("r.e") - F.col("r.s"))).withColumn("kind", F.element_at(F.array(F.lit("split"), F.lit("final"), F.lit("whole")), F.col("r.k") + 1)).drop("r")
    return out.where((F.col("kind") != "final") | (content_length(F.col("items")) >= min_size))


def pack_mixed(groups: DataFrame, size: int, overlap: int, variance: float, gap: float = 0.3) -> DataFrame:
    """Chunks that also close when the confidence's population variance or its distance from the mean grows too large."""
    items = F.col("items")
    indexed = F.transform(items, lambda x, i: F.struct(i.alias("i"), x["raw"].alias("raw"), x["confidence"].alias("c")))
    start = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), F.lit(0).alias("s"))

    def held(acc: Column, x: Column) -> Column:
        return F.slice(indexed, acc["s"] + 1, x["i"] - acc["s"])

    def total(rows: Column, f) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda a, r: a + f(r).cast("double"))

    def step(acc: Column, x: Column) -> Column:
        now = held(acc, x)
        k = F.size(now).cast("double")
        mean = (total(now, lambda r: r["c"]) + x["c"]) / (k + 1)
        spread = (total(now, lambda r: (r["c"] - mean) * (r["c"] - mean)) + (x["c"] - mean) * (x["c"] - mean)) / (k + 1)
        far = F.abs(x["c"] - total(now, lambda r: r["c"]) / F.greatest(k, F.lit(1.0))) > gap
        flush = (k > 0) & ((spread > variance) | (total(now, lambda r: r["raw"]) + x["raw"] > size) | far)
        zero = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("stop"))
        fit = lambda a, r: ~a["stop"] & (a["chars"] + r["raw"] <= overlap)
        keep = F.aggregate(F.reverse(now), zero, lambda a, r: F.struct((a["k"] + fit(a, r).cast("int")).alias("k"), (a["chars"] + F.when(fit(a, r), r["raw"]).otherwise(F.lit(0).cast("long"))).alias("chars"), (~fit(a, r)).alias("stop")))["k"]
        kept = keep if overlap > 0 else F.lit(0)
        return F.struct(F.when(flush, F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), x["i"].alias("e"))))).otherwise(acc["done"]).alias("done"), F.when(flush, x["i"] - kept).otherwise(acc["s"]).alias("s"))

    end = F.aggregate(indexed, start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), F.size(items).alias("e")))))
    each = groups.select("*", F.posexplode(end).alias("chunk_no", "r"))
    return each.withColumn("items", F.slice("items", F.col("r.s") + 1, F.col("r.e") - F.col("r.s"))).drop("r")
