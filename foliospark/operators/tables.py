"""Tables: simple detection, grids, text, containment, and nested block JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.operators.grouping import PAGE, islands, same_row

BLOCK = "array<struct<Id:string,BlockType:string,RowIndex:int,ColumnIndex:int,Text:string,Confidence:double,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>,Ids:array<string>>>"


def aligned_rows(regions: DataFrame, tolerance: float = 20) -> DataFrame:
    """Regions of rows with two or more, on pages with four regions and two such rows at least: row_no, row_size, cell_no."""
    runs = islands(regions, PAGE, [F.col("y1"), F.col("line_no")], lambda p, q: same_row(p, q, tolerance), fields=["y1"], name="run")
    page, row = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE, "run")
    runs = runs.withColumn("row_size", F.count("*").over(row)).withColumn("_n", F.count("*").over(page)).withColumn("cell_no", (F.row_number().over(row.orderBy("y1", "line_no")) - 1).cast("int"))
    wide = runs.where("row_size >= 2 and _n >= 4").withColumn("row_no", (F.dense_rank().over(page.orderBy("run")) - 1).cast("int"))
    return wide.withColumn("_rows", F.max("row_no").over(page) + 1).where("_rows >= 2").drop("_rows", "_n", "run")


def simple_tables(regions: DataFrame) -> DataFrame:
    """Cells of each aligned row of four or more regions at two or more places: a table of two columns."""
    rows = aligned_rows(regions)
    row = Window.partitionBy(*PAGE, "row_no")
    tables = rows.where("row_size >= 4").withColumn("_x", F.size(F.collect_set(F.bround("x1", -1)).over(row))).where("_x >= 2").drop("_x")
    indexed = tables.withColumn("table_idx", (F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("row_no")) - 1).cast("int"))
    return indexed.select(*PAGE, "table_idx", F.floor(F.col("cell_no") / 2).cast("int").alias("row"), (F.col("cell_no") % 2).alias("col"), "text", "confidence", "x1", "y1", "x2", "y2")


def grid_text(cells: DataFrame, keys: list[str], pos: list[str]) -> DataFrame:
    """Text of each table: cells by ' | ', rows by line; empty where no cell is, the last of several."""
    item = F.when((F.col("row") >= 0) & (F.col("col") >= 0), F.struct("row", "col", F.struct(*pos).alias("at"), "text"))
    size = [F.max("row").alias("_row"), F.max("col").alias("_col"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    found = cells.groupBy(*keys).agg(*size, F.collect_list(item).alias("_items")).withColumns({"rows": F.col("_row") + 1, "columns": F.col("_col") + 1})
    # A blank for every place, before what else is there: the last of each place makes a whole grid, of which rows are slices.
    blank = lambda r, c: F.struct(r.cast(_kind(cells, "row")).alias("row"), c.cast(_kind(cells, "col")).alias("col"), F.lit(0).alias("real"), F.lit(None).cast(_kind(found, "_items")[len("array<") : -1])["at"].alias("at"), F.lit("").alias("text"))
    blanks = F.flatten(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: blank(r, c))))
    real = F.transform("_items", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"), F.lit(1).alias("real"), x["at"].alias("at"), F.coalesce(x["text"], F.lit("")).alias("text")))
    full = found.withColumn("_all", F.sort_array(F.concat(blanks, real)))
    last = lambda x, i: F.coalesce((F.get("_all", i + 1)["row"] != x["row"]) | (F.get("_all", i + 1)["col"] != x["col"]), F.lit(True))
    texts = full.withColumn("_texts", F.transform(F.filter("_all", last), lambda x: x["text"]))
    return texts.select(*keys, "rows", "columns", _lines("_texts").alias("table_text"), "x1", "y1", "x2", "y2")


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _lines(texts: str) -> Column:
    """The rows of a whole grid's texts."""
    width = F.col("columns")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.array_join(F.slice(texts, (r * width + 1).cast("int"), width.cast("int")), " | ")), "\n")


def whole_grid_text(grids: DataFrame, keys: list[str]) -> DataFrame:
    """The same of tables that come as one row, with all of their cells, by row and column, in an array: nothing is exchanged."""
    end = lambda c: F.element_at("cells", -1)[c] + 1
    edge = lambda f, c: f(F.transform("cells", lambda x: x[c])).alias(c)
    sized = grids.select(*keys, end("row").alias("rows"), end("col").alias("columns"), F.transform("cells", lambda x: F.coalesce(x["text"], F.lit(""))).alias("_texts"), edge(F.array_min, "x1"), edge(F.array_min, "y1"), edge(F.array_max, "x2"), edge(F.array_max, "y2"))
    return sized.select(*keys, "rows", "columns", _lines("_texts").alias("table_text"), "x1", "y1", "x2", "y2")


def cell_at(cells: DataFrame, row: int, col: int) -> DataFrame:
    return cells.where((F.col("row") == row) & (F.col("col") == col))


def contained(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Regions inside of table boxes (doc_id, page_number, table_idx, t_x1..t_y2), as cells of three columns."""
    inside = regions.join(boxes, PAGE).where(G.contains("t_", ""))
    k = F.row_number().over(Window.partitionBy(*PAGE, "table_idx").orderBy("line_no")) - 1
    return inside.withColumn("_k", k).select(*PAGE, "table_idx", "region_id", F.floor(F.col("_k") / 3).cast("int").alias("row"), (F.col("_k") % 3).cast("int").alias("col"))


def parse_blocks(documents: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, blocks): each document stays one row, as blocks refer to others of their document only."""
    return documents.select(key, F.from_json("json", f"Blocks {BLOCK}")["Blocks"].alias("blocks"))


def _box(b: Column) -> list[Column]:
    at = b["Geometry"]["BoundingBox"]
    return [at["Left"].alias("x1"), at["Top"].alias("y1"), (at["Left"] + at["Width"]).alias("x2"), (at["Top"] + at["Height"]).alias("y2")]


def line_regions(blocks: DataFrame, key: str = "table_id", kind: str = "LINE") -> DataFrame:
    """Regions of the blocks of lines: relative boxes, confidences from 0 to 1, in order of place."""

    def region(b: Column) -> Column:
        x1, y1, x2, y2 = _box(b)
        return F.struct(y1, x1, b["Id"].alias("region_id"), b["Text"].alias("text"), (b["Confidence"] / 100).alias("confidence"), x2, y2)

    of = F.sort_array(F.transform(F.filter("blocks", lambda b: b["BlockType"] == kind), region))
    return blocks.select(key, F.posexplode(of).alias("reading_order", "r")).select(key, *[f"r.{c}" for c in ("region_id", "text", "confidence", "x1", "y1", "x2", "y2")], "reading_order")


def _lookup(blocks: str, kind: str) -> Column:
    """Blocks of a kind for _found(): in parts by the hash of their ids, so that large documents cost the power 1.5 of their size."""
    of = F.transform(F.filter(blocks, lambda b: b["BlockType"] == kind), lambda b: F.struct(b["Id"].alias("id"), F.hash(b["Id"]).alias("h"), b.alias("b")))
    parts = lambda n: F.greatest(F.floor(F.sqrt(F.size(n)) / 8), F.lit(1)).cast("int")
    part = lambda rows: F.struct(F.transform(rows, lambda x: x["id"]).alias("ids"), F.transform(rows, lambda x: x["b"]).alias("rows"))
    split = lambda a: F.when(parts(a) == 1, F.array(part(a))).otherwise(F.transform(F.sequence(F.lit(0), parts(a) - 1), lambda k: part(F.filter(a, lambda x: F.pmod(x["h"], parts(a)) == k))))
    return F.transform(F.array(of), split)[0]


def _found(lookup: Column, i: Column) -> Column:
    """The block of an id, the first if several have it; null if none has."""
    within = lambda p: F.get(p["rows"], (F.array_position(p["ids"], i) - 1).cast("int"))
    return F.transform(F.array(F.get(lookup, F.pmod(F.hash(i), F.size(lookup)))), within)[0]


def tables_from_blocks(blocks: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells of block tables: TABLE -> CELL -> WORD by their ids, looked up within the document's row; places from 0."""
    none = F.array().cast("array<string>")
    known = blocks.select(key, F.filter("blocks", lambda b: b["BlockType"] == "TABLE").alias("_tables"), _lookup("blocks", "CELL").alias("_cells"), _lookup("blocks", "WORD").alias("_words"))

    def cell(table: Column, c: Column) -> Column:
        words = F.transform(F.coalesce(c["Ids"], none), lambda i: _found(F.col("_words"), i)["Text"])
        text = F.array_join(F.filter(words, lambda w: w != ""), " ")
        x1, y1, x2, y2 = _box(c)
        return F.struct(table.alias("table_block"), (F.coalesce(c["RowIndex"], F.lit(1)) - 1).alias("row"), (F.coalesce(c["ColumnIndex"], F.lit(1)) - 1).alias("col"), (c["Confidence"] / 100).alias("confidence"), x1, y1, x2, y2, text.alias("text"))

    of = lambda t: F.transform(F.filter(F.transform(F.coalesce(t["Ids"], none), lambda i: _found(F.col("_cells"), i)), lambda c: c.isNotNull()), lambda c: cell(t["Id"], c))
    return known.select(key, F.inline(F.flatten(F.transform("_tables", of))))
