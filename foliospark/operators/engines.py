"""Choice among recognition engines, their registry, and what they share after recognition."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators.images import preprocess_pages
from foliospark.operators.quality import page_metrics

REGION_SCHEMA = "doc_id long, page_number int, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, error string"
REGION_ARROW = pa.schema([("doc_id", pa.int64()), ("page_number", pa.int32()), ("line_no", pa.int32()), ("text", pa.string()), *[(c, pa.float64()) for c in ("confidence", "x1", "y1", "x2", "y2")], ("error", pa.string())])
DEFAULTS = {
    "tesseract": {"language": "eng", "page_segmentation_mode": 6, "engine_mode": 3},
    "easyocr": {"languages": ["en"]},
    "paddleocr": {"languages": ["en"]},
    "aws_textract": {"region": "us-east-1"},
    "trocr": {"batch_size": 8, "confidence": 0.95},
    "layoutlmv3": {"max_length": 512},
}
NEEDS = {"tesseract": "pytesseract", "easyocr": "easyocr", "paddleocr": "easyocr", "aws_textract": "boto3", "trocr": "transformers", "layoutlmv3": "transformers"}


class RegionSource(ABC):
    """Pages in, regions out. A subclass wraps an engine; it is built once in each Python worker."""

    name = "source"

    @abstractmethod
    def read(self, page: dict) -> list[dict]:
        """Regions of a page: text, confidence, x1, y1, x2, y2."""

    def available(self) -> bool:
        return True


def run_engines(pages: DataFrame, engines: list[tuple[str, Callable[[], RegionSource]]], parallel: bool = False, enable_fallback: bool = True, steps: tuple[str, ...] = (), metrics: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(regions of the engine chosen for each document, with engine and priority; documents that none read well enough).

    One after the other, an engine gets only the documents that those before it left unresolved; in parallel each gets all and
    the best one counts. Without fallback the first engine's result stands, good or not. With steps, pages are gray images
    and are preprocessed first. metrics: regions to page measures, from operators.quality unless given. Pages that fail
    are rows with their error, of confidence 0 for the measures. The engines are run once: their regions are kept.
    """
    if not engines:
        raise RuntimeError("no engines are available")
    measure = metrics or page_metrics
    todo = preprocess_pages(pages, steps).drop("applied") if steps else pages
    docs = pages.select("doc_id").distinct()
    each = measured = passed = None
    for k, (name, make) in enumerate(engines):
        mine = todo if parallel or k == 0 else todo.join(passed, "doc_id", "left_anti")
        read = recognize(mine, make).withColumns({"engine": F.lit(name), "priority": F.lit(k)}).persist()
        if not parallel and not enable_fallback:
            return read, docs.join(read, "doc_id", "left_anti")
        each = read if each is None else each.unionByName(read)
        # A row for each document and engine, kept as well: later engines and the choice ask for it again.
        own = gate(_measured(read, measure, name, k)).persist()
        measured = own if measured is None else measured.unionByName(own)
        good = own.where("passes").select("doc_id")
        passed = good if passed is None else passed.unionByName(good)
    chosen = first_of(measured, X.r6(F.col("average_all")).desc(), "priority") if parallel else first_of(measured, "priority")
    return each.join(chosen.select("doc_id", "engine"), ["doc_id", "engine"]), docs.join(passed, "doc_id", "left_anti")


def _measured(read: DataFrame, measure: Callable[[DataFrame], DataFrame], engine: str, priority: int) -> DataFrame:
    """Measures of each page that an engine read; a failed page has confidence and coverage 0."""
    good = measure(read.where("error is null")).select("doc_id", "page_number", "overall_confidence", "text_coverage_ratio")
    failed = read.where("error is not null").select("doc_id", "page_number", F.lit(0.0).alias("overall_confidence"), F.lit(0.0).alias("text_coverage_ratio"))
    return good.unionByName(failed).withColumns({"engine": F.lit(engine), "priority": F.lit(priority)})


def errors_of(recognized: DataFrame, step: str = "ocr_extraction", recoverable: bool = False) -> DataFrame:
    """Error records of the pages that failed: (doc_id, page_number, step, error_type, message, is_recoverable)."""
    split = F.split("error", ": ", 2)
    return recognized.where("error is not null").select("doc_id", "page_number", F.lit(step).alias("step"), F.get(split, 0).alias("error_type"), F.coalesce(F.get(split, 1), F.lit("")).alias("message"), F.lit(recoverable).alias("is_recoverable"))


def table_regions(regions: DataFrame) -> DataFrame:
    """Of decoded entities those that are tables."""
    return regions.where(F.col("region_type") == "table")


def model_confidence(texts: DataFrame) -> DataFrame:
    """(doc_id, models, mean_confidence) over the models that gave a text: (doc_id, model, text, confidence)."""
    return texts.where("text is not null").groupBy("doc_id").agg(F.count("*").alias("models"), F.avg("confidence").alias("mean_confidence"))


def _listed(column: pa.Array) -> list:
    """A column's values. Lists of records are converted a field at a time, not a record at a time."""
    kind = column.type
    if not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type) or not kind.value_type.num_fields or column.values.null_count:
        return column.to_pylist()
    at, records = column.offsets.to_pylist(), column.values
    names = [f.name for f in kind.value_type]
    made = [dict(zip(names, r)) for r in zip(*[records.field(k).to_pylist() for k in range(len(names))])]
    return [made[a:b] if there else None for a, b, there in zip(at, at[1:], column.is_valid().to_pylist())]


def _records(batch: pa.RecordBatch) -> list[dict]:
    return [dict(zip(batch.schema.names, r)) for r in zip(*map(_listed, batch.columns))]


def recognize(pages: DataFrame, make: Callable[[], RegionSource]) -> DataFrame:
    """Regions of all pages. A page that fails gives one row with the error and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = make()
        for batch in batches:
            rows = []
            for page in _records(batch):
                base = {"doc_id": page["doc_id"], "page_number": page["page_number"]}
                try:
                    rows += [base | {"line_no": k} | r for k, r in enumerate(source.read(page))]
                except Exception as e:  # a page that can't be read is a result, not the end of the job
                    rows.append(base | {"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in REGION_ARROW], schema=REGION_ARROW)

    return pages.mapInArrow(run, REGION_SCHEMA)


class PrecomputedSource(RegionSource):
    """Regions that come with the page, as a list of records in its column `regions`."""

    name = "precomputed"

    def read(self, page: dict) -> list[dict]:
        return [dict(r) for r in page["regions"]]


_factories: dict[str, Callable[..., RegionSource]] = {"precomputed": PrecomputedSource}


def register(name: str, factory: Callable[..., RegionSource]) -> None:
    _factories[name] = factory


def create(name: str, **options) -> RegionSource:
    if name not in _factories:
        raise ValueError(f"no engine {name!r}")
    made = _factories[name](**(DEFAULTS.get(name, {}) | options))
    if not made.available():
        raise RuntimeError(f"engine {name!r} isn't available")
    return made


def status(spark: SparkSession) -> DataFrame:
    """(engine, available): known engines whose library is here, and those registered."""
    rows = [(n, n in _factories or find_spec(NEEDS[n]) is not None) for n in NEEDS] + [(n, True) for n in _factories if n not in NEEDS]
    return spark.createDataFrame(sorted(rows), "engine string, available boolean")


#: Libraries that add to what is built in: geometry, element partitioning, layout models.
OPTIONAL = ("layoutparser", "shapely", "unstructured")


def optional_libraries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, find_spec(n) is not None) for n in OPTIONAL], "library string, available boolean")


def normalize_config(engines: str | list, **defaults) -> list[dict]:
    """Names or records of engines as a list of records."""
    listed = [engines] if isinstance(engines, (str, dict)) else list(engines)
    return [defaults | ({"engine": e} if isinstance(e, str) else dict(e)) for e in listed]


def preset(document_type: str = "general", priority: str = "balanced", cloud: bool = False) -> dict:
    """Engines for a kind of document and a priority: the cloud engine only if allowed, in parallel only for quality."""
    plans = {"speed": ["easyocr", "tesseract"], "balanced": ["easyocr", "tesseract", "aws_textract"], "quality": ["aws_textract", "easyocr", "tesseract"]}
    if priority not in plans:
        raise ValueError(f"no priority {priority!r}")
    order = list(plans[priority])
    if document_type in ("forms", "tables") and priority != "speed":
        order.sort(key=lambda e: e != "aws_textract")
    if document_type == "handwritten":
        order.sort(key=lambda e: e == "tesseract")
    return {"engines": [e for e in order if cloud or e != "aws_textract"], "parallel": priority == "quality", "fallback": True}


def gate(engine_pages: DataFrame) -> DataFrame:
    """One row for each document and engine: averages and whether they pass. Pages of confidence 0 count only in average_all."""
    c = F.col("overall_confidence")
    g = engine_pages.groupBy("doc_id", "engine", "priority").agg(F.avg(F.when(c > 0, c)).alias("average"), F.avg(F.when(c > 0, F.col("text_coverage_ratio"))).alias("coverage"), F.avg(c).alias("average_all"))
    return g.withColumn("passes", F.coalesce((F.col("average") >= F.lit(0.6)) & (F.col("coverage") >= F.lit(0.05)), F.lit(False)))


def fallback(engine_pages: DataFrame, enabled: bool = True) -> DataFrame:
    """The first engine by priority that passes; with fallback off the first one, passed or not."""
    g = gate(engine_pages)
    first = Window.partitionBy("doc_id").orderBy("priority")
    kept = g.where("passes") if enabled else g
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def unresolved(engine_pages: DataFrame) -> DataFrame:
    """Documents that no engine read well enough: for the next engine, or for the list of errors."""
    return engine_pages.select("doc_id").distinct().join(gate(engine_pages).where("passes"), "doc_id", "left_anti")


def best_of(engine_pages: DataFrame) -> DataFrame:
    """Of the engines that pass the one of the best average over all pages; of equal ones the earlier."""
    return first_of(gate(engine_pages), X.r6(F.col("average_all")).desc(), "priority")


def first_of(gated: DataFrame, *order: Column | str) -> DataFrame:
    """Of each document's engines that pass the first in an order."""
    first = Window.partitionBy("doc_id").orderBy(*order)
    return gated.where("passes").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def longest_text(texts: DataFrame) -> DataFrame:
    """Of several models' texts (doc_id, model, model_order, text) the longest; of equal ones the first."""
    first = Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "model_order")
    return texts.where("text is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def word_boxes(words: DataFrame) -> DataFrame:
    """Regions of word boxes (left, top, width, height, conf of 100): no blanks, no negative confidence, no empty box."""
    kept = words.where((F.trim("text") != "") & (F.col("conf") >= 0) & (F.col("width") > 0) & (F.col("height") > 0))
    out = kept.select("doc_id", "page_number", "line_no", F.trim("text").alias("text"), (F.col("conf") / 100).alias("confidence"), F.col("left").alias("x1"), F.col("top").alias("y1"), (F.col("left") + F.col("width")).alias("x2"), (F.col("top") + F.col("height")).alias("y2"))
    return out.withColumn("reading_order", (F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("y1", "x1", "line_no")) - 1).cast("int"))


def polygons(results: DataFrame) -> DataFrame:
    """Regions of polygons (points: array of x, y): their bounding boxes; no blanks."""
    edge = lambda f, side: f(F.transform("points", lambda p: p[side]))
    return results.where(F.trim("text") != "").select("doc_id", "page_number", "line_no", F.trim("text").alias("text"), "confidence", edge(F.array_min, "x").alias("x1"), edge(F.array_min, "y").alias("y1"), edge(F.array_max, "x").alias("x2"), edge(F.array_max, "y").alias("y2"))


def decode_bio(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities of B-/I-/O labelled tokens.

    B opens an entity, I of the same label goes on with it (the least confidence counts), all else closes it;
    an O token is a text region of its own, an I that doesn't fit is dropped. Special tokens are skipped.
    """
    w = Window.partitionBy(key).orderBy("pos")
    kept = tokens.where(~F.col("word").isin("[CLS]", "[SEP]", "[PAD]"))
    label = F.col("label")
    kind = F.substring(label, F.lit(3), F.length(label))
    run = kept.withColumn("_kind", F.when(label.startswith("B-") | label.startswith("I-"), kind)).withColumn("_prev", F.lag("_kind").over(w))
    run = run.withColumn("_open", F.when(label.startswith("B-") | (label == "O") | ~F.col("_kind").eqNullSafe(F.col("_prev")), 1).otherwise(0))
    run = run.withColumn("entity_no", F.sum("_open").over(w))
    # The label of the last row that opened an entity: the same order as above, so nothing is sorted again.
    opened = F.last(F.when(F.col("_open") == 1, F.struct("label")), True).over(w)["label"]
    begins = F.when(F.col("entity_no") > 0, opened).otherwise(F.first("label").over(w))
    live = run.withColumn("_begin", begins).where("_begin not like 'I-%'").where(F.trim("word") != "")
    text = F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda t: t["word"]), " "), " ##", "")
    g = live.groupBy(key, "entity_no", F.col("_begin").alias("first_label")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_tokens"), text.alias("text"), F.min("confidence").alias("confidence"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    name = F.substring(F.col("first_label"), F.lit(3), F.length("first_label"))
    mapped = F.when(name.isin("HEADER", "TABLE", "LIST", "CAPTION"), F.lower(name)).otherwise("text")
    return g.withColumn("region_type", mapped).drop("entity_no", "first_label")
