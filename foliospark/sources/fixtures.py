"""Deterministic inputs made from the plain tables: regions, table cells, tokens, engine runs, block JSON.

Geometry and confidences are whole-number arithmetic, so any engine gives equal rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.pages import write_bmp, write_png, write_tiff

PAGE_WIDTH, PAGE_HEIGHT, LINES = 700, 900, 12
ENGINE_ROWS = [("easyocr", 0), ("tesseract", 1), ("paddleocr", 2)]
BIO = ["O", *(f"{edge}-{kind}" for kind in ("HEADER", "QUESTION", "ANSWER", "TABLE", "LIST", "CAPTION") for edge in "BI")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a table comes in fewer pieces than there are: a file of one row group is one task otherwise. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def regions(documents: DataFrame) -> DataFrame:
    """One region for each whole line that isn't blank, twelve to a page, in one or two columns. Marks are added, so that the rules for types have something to find."""
    return _placed(documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")))


def regions_by_page(documents: DataFrame) -> DataFrame:
    """The same regions, spread by document and page before pages are cut into lines: a long document is as many groups as it has pages."""
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES).cast("int")), lambda p: F.slice(lines, p * LINES + 1, LINES))
    each = documents.where("text is not null").select("doc_id", F.posexplode(pages).alias("p", "lines")).select("doc_id", (F.col("p") + 1).alias("page_number"), "lines").repartition("doc_id", "page_number")
    return _placed(each.select("doc_id", "page_number", F.posexplode("lines").alias("k", "raw")).select("doc_id", "page_number", ((F.col("page_number") - 1) * LINES + F.col("k")).alias("line_no"), "raw"))


def _placed(each: DataFrame) -> DataFrame:
    lines = each.where(F.trim("raw") != "")
    r = F.col("line_no") % LINES
    text = F.when(r.isin(0, 8), F.concat("raw", F.lit(" \u2014"))).when(r.isin(3, 4), F.concat(F.lit("- "), "raw")).when(r == 5, F.concat(F.lit("2. "), "raw")).when(r == 7, F.concat(F.lit("Figure 1: "), "raw")).otherwise(F.col("raw"))
    page = F.col("page_number") if "page_number" in each.columns else (1 + (F.col("line_no") - r) / LINES).cast("int")
    named = lines.select("doc_id", page.alias("page_number"), "line_no", text.alias("text"), r.alias("r")).withColumn("n", F.length("text"))
    mixed = named.withColumn("h", F.col("doc_id") * 7919 + F.col("line_no") * 104729 + F.col("n") * 31).withColumn("nc", 1 + F.col("doc_id") % 2)
    milli = (300 + F.col("h") % 700).cast("int")
    x1 = F.when((F.col("r") == 8) & (F.col("nc") == 1), 140).when(F.col("r") == 8, 285).otherwise(50 + 300 * (F.col("r") % F.col("nc")) + 7 * (F.col("line_no") % 3)).cast("double")
    y1 = (40 + 45 * ((F.col("r") - F.col("r") % F.col("nc")) / F.col("nc"))).cast("double")
    placed = mixed.select(
        F.concat_ws("_", "doc_id", "line_no").alias("region_id"), "doc_id", "page_number", "line_no", "n", milli.alias("conf_milli"),
        (milli.cast("double") / F.lit(1000.0)).alias("confidence"), x1.alias("x1"), y1.alias("y1"), (x1 + F.least(F.lit(250), 20 + F.col("n"))).alias("x2"), (y1 + 20 + 9 * (F.col("h") % 6)).alias("y2"), "text",
    )
    return placed.where(F.length(F.trim("text")) > 0)


def table_grids(lineitem: DataFrame) -> DataFrame:
    """Each order as a table of four columns and a row for each line: one row with its cells in order, made by one exchange of the lines."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    tables = lineitem.select(F.col("l_orderkey").alias("table_id"), line.alias("l")).repartition("table_id").groupBy("table_id").agg(F.sort_array(F.collect_list("l")).alias("lines"))

    def cell(text: Column, row: Column, col: int) -> Column:
        x, y = float(col * 100), (row * 20).cast("double")
        return F.struct(row.alias("row"), F.lit(col).alias("col"), text.alias("text"), F.lit(x).alias("x1"), y.alias("y1"), F.lit(x + 90).alias("x2"), (y + 18).alias("y2"))

    cells = lambda l, k: F.array(*[cell(t, k, c) for c, t in enumerate((l["l_partkey"].cast("string"), l["l_suppkey"].cast("string"), l["l_quantity"].cast("int").cast("string"), l["l_returnflag"]))])  # noqa: E731, E741
    return tables.select("table_id", F.flatten(F.transform("lines", cells)).alias("cells"))


def table_cells(lineitem: DataFrame) -> DataFrame:
    """The cells of those tables, a row each."""
    return table_grids(lineitem).select("table_id", F.inline("cells"))


def bio_tokens(documents: DataFrame) -> DataFrame:
    """Words with labels by their place, confidences in thousandths, and boxes."""
    words = documents.select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \n]"), lambda w: w != "")).alias("pos", "word"))
    label = F.element_at(F.array(*map(F.lit, BIO)), ((F.col("pos") - F.col("pos") % 2 + F.col("doc_id")) % 13 + 1).cast("int"))
    label = F.when((F.col("pos") % 2 == 1) & label.startswith("B-"), F.concat(F.lit("I-"), F.substring(label, 3, 20))).otherwise(label)
    x = (F.col("pos") % 10 * 60).cast("double")
    y = ((F.col("pos") - F.col("pos") % 10) * 2).cast("double")
    return words.select("doc_id", "pos", "word", label.alias("label"), (500 + (F.col("pos") * 37 + F.col("doc_id") * 11) % 500).cast("int").alias("conf_milli"), x.alias("x1"), y.alias("y1"), (x + 50).alias("x2"), (y + 15).alias("y2"))


def engine_pages(pages: DataFrame) -> DataFrame:
    """Pages as three engines saw them: the confidence moved by up to 0.12 either way."""
    engines = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(p).alias("priority")) for e, p in ENGINE_ROWS])).alias("e")
    each = pages.select("*", engines).select("doc_id", "page_number", "overall_confidence", "text_coverage_ratio", "e.engine", "e.priority")
    shift = ((F.col("doc_id") * 31 + F.col("priority") * 17) % 5 - 2) * F.lit(0.06).cast("double")
    return each.withColumn("overall_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("overall_confidence") + shift)))


def ocr_blocks(grids: DataFrame) -> DataFrame:
    """One JSON document of nested blocks for each table: TABLE -> CELL -> WORD."""
    no, nothing, none = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    box = lambda c: F.struct(F.struct(c["x1"].alias("Left"), c["y1"].alias("Top"), (c["x2"] - c["x1"]).alias("Width"), (c["y2"] - c["y1"]).alias("Height")).alias("BoundingBox"))
    named = lambda edge, c: F.concat_ws("-", F.lit(edge), c["row"], c["col"])
    block = lambda i, kind, row, col, text, of, ids, conf=98.5: F.struct(i.alias("Id"), F.lit(kind).alias("BlockType"), row.alias("RowIndex"), col.alias("ColumnIndex"), text.alias("Text"), F.lit(conf).cast("double").alias("Confidence"), of.alias("Geometry"), ids.alias("Ids"))
    each = F.flatten(F.transform("cells", lambda c: F.array(block(named("c", c), "CELL", c["row"] + 1, c["col"] + 1, nothing, box(c), F.array(named("w", c))), block(named("w", c), "WORD", no, no, c["text"], box(c), none))))
    head = block(F.lit("t-0"), "TABLE", no, no, nothing, box(F.element_at("cells", 1)), F.transform("cells", lambda c: named("c", c)), 99.0)
    return grids.select("table_id", F.to_json(F.struct(F.concat(F.array(head), each).alias("Blocks"))).alias("json"))


def image_files(embeddings: DataFrame) -> DataFrame:
    """(path, content): each vector as an image of 8 x 8 pixels, by turns a PNG, a BMP and a TIFF of two pages; some files are cut short, some are of no known type."""

    def run(batches):
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = (np.floor(np.abs(v.values.to_numpy().astype(float)) * 1000).astype(np.int64) % 256).astype(np.uint8).reshape(8, 8, 1)
                data = [write_png(x, k // 3 % 3), write_bmp(x), write_tiff([x, 255 - x], (1, 8, 32773)[k // 3 % 3])][k % 3]
                out.append(data[:60] if k % 10 == 7 else b"text" + data if k % 10 == 9 else data)
            yield pa.RecordBatch.from_arrays([pa.array([f"/scans/{k}" for k in batch.column(0).to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "path string, content binary")


def scanned(regions: DataFrame) -> DataFrame:
    """Pages with their recognised regions in a column, for the engine that reads them from there; every seventh page's are missing."""
    item = F.struct("line_no", "text", "confidence", "x1", "y1", "x2", "y2")
    pages = regions.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(item)), lambda r: r.dropFields("line_no")).alias("regions"))
    return pages.withColumn("regions", F.when((F.col("doc_id") + F.col("page_number")) % 7 != 0, F.col("regions")))
