"""Files and pages: types, metadata, elements; records for storage."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as X

SUPPORTED = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp")


def supported_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in SUPPORTED], "format string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder with their metadata; content stays unread unless it is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return document_metadata(files.select("path", "length", F.col("modificationTime").alias("mtime"), "content"))


def document_metadata(files: DataFrame) -> DataFrame:
    """Type, title (the stem unless there is one), source and cache key of (path, length, mtime)."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    title = F.coalesce("title", stem) if "title" in files.columns else stem
    kind = X.document_type(F.col("path"))
    return files.select(
        *[c for c in files.columns if c != "title"], title.alias("title"), F.col("path").alias("source"), kind.alias("document_type"),
        *predicates(kind), X.cache_key(F.col("path"), F.col("length").cast("string"), F.col("mtime").cast("string")).alias("cache_key"),
    )


def predicates(kind: Column) -> list[Column]:
    return [kind.isin("image", "multi_page_tiff").alias("is_image"), kind.isin("pdf", "scanned_pdf").alias("is_pdf"), kind.isin("image", "scanned_pdf", "multi_page_tiff").alias("requires_ocr")]


def safe_content(content: Column) -> Column:
    """What a dump says in place of bytes."""
    return F.when(content.isNotNull(), F.concat(F.lit("<"), F.octet_length(content).cast("string"), F.lit(" bytes>")))


def stored_embedding(embedding: Column, limit: int = 100) -> Column:
    """What storage keeps of a vector, as (values, note): its values, or of one of more than `limit` dimensions a note of how many."""
    large = F.size(embedding) > limit
    return F.struct(F.when(~large, embedding).alias("values"), F.when(large, F.concat(F.lit("<"), F.size(embedding).cast("string"), F.lit(" dimensions>"))).alias("note"))


def encode_json(ts: Column, raw: Column, seconds: Column) -> Column:
    """Timestamps by ISO 8601, bytes by lower-case hex, durations by seconds."""
    return F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lower(F.hex(raw)).alias("content"), seconds.cast("double").alias("seconds")))


def seconds_of(interval: Column) -> Column:
    """Seconds of a day-time interval."""
    part = lambda name: F.extract(F.lit(name), interval).cast("double")
    return part("DAY") * 86_400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


#: Tags that begin an element, by its type.
ELEMENTS = {"title": ("h1", "h2", "h3", "h4", "h5", "h6"), "paragraph": ("p", "blockquote", "pre"), "list": ("li", "dt", "dd"), "table": ("tr",), "caption": ("caption", "figcaption")}
_TAGS = "|".join(t for tags in ELEMENTS.values() for t in tags)


def unescape(text: Column) -> Column:
    """Character references, by number or HTML 4 name, as their characters; what isn't one stays."""
    code = lambda n: F.when(n.startswith("x") | n.startswith("X"), F.conv(F.substring(n, 2, 12), 16, 10)).otherwise(n).cast("long")
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32")
    fine = lambda n: (code(n) < 0x110000) & ~code(n).between(0xD800, 0xDFFF) & ~code(n).isin(0, 38)
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(1)))
    out = F.aggregate(F.filter(numbers, fine), text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), char(n)))
    named = F.create_map(*[F.lit(v) for name, n in sorted(name2codepoint.items()) if name != "amp" for v in (name, chr(n))])
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("&([a-zA-Z][a-zA-Z0-9]*);"), F.lit(1)))
    known = F.filter(names, lambda n: F.map_contains_key(named, n))
    out = F.aggregate(known, out, lambda t, n: F.replace(t, F.concat(F.lit("&"), n, F.lit(";")), F.element_at(named, n)))
    # Last, so that what it makes isn't read again.
    return F.when(F.instr(text, "&") > 0, F.regexp_replace(out, "&amp;|&#0*38;|&#[xX]0*26;", "&")).otherwise(text)


def html_elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, type, text) of headings, paragraphs, list items, table rows and captions, as columns alone: no parser in Python.

    An element ends where the next one begins or where a tag of any of them is closed. Tags may be in either case.
    """
    shown = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|$)|<(script|style|template|noscript|textarea)\b.*?(?:</\1\s*>|$)", " ")
    pieces = F.filter(F.split(shown, rf"(?i)(?=</?(?:{_TAGS}|table)[\s/>])"), lambda x: x.rlike(rf"(?i)^<(?:{_TAGS})[\s>]"))
    each = pages.select("page_id", F.posexplode(pieces).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([a-zA-Z0-9]+)", 1))
    bare = F.regexp_replace("raw", r"""<(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+(?:>|$)""", " ")
    kind = F.lit(None).cast("string")
    for name, tags in ELEMENTS.items():
        kind = F.when(tag.isin(*tags), name).otherwise(kind)
    return each.select("page_id", "pos", kind.alias("type"), X.clean_region(unescape(bare)).alias("text")).where("text <> ''")


def cached_or_new(files: DataFrame, cache: DataFrame, max_age_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(files with their latest cached result of this age, files to process) by cache key. cache: (cache_key, cached_at, result)."""
    fresh = cache.where(F.col("cached_at") >= F.current_timestamp() - F.expr(f"INTERVAL {max_age_hours} HOURS"))
    latest = fresh.groupBy("cache_key").agg(F.max_by("result", "cached_at").alias("result"), F.max("cached_at").alias("cached_at"))
    return files.join(latest, "cache_key"), files.join(latest.select("cache_key"), "cache_key", "left_anti")


def cache_results(results: DataFrame, path: str) -> None:
    """Add results (cache_key, result) to the cache at a path, dated now. Older ones of a key stay until they age; cached_or_new() takes the latest."""
    results.select("cache_key", F.current_timestamp().alias("cached_at"), "result").write.mode("append").parquet(path)
