"""Region types by rules: the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as X

HIERARCHY = {"title": 0, "header": 1, "paragraph": 2, "list": 3, "caption": 4, "footer": 5}
KEYWORDS = "figure|table|chart|graph|image"
#: KEYWORDS, fig. and tab. in any case, told apart by their first letter: texts needn't be made lower case. No letter beyond ASCII has one of theirs as its lower case, but the dotted I, whose dot stays.
CAPTION = r"(?=[fFtTcCgGiI])(?:[fF][iI][gG](?:[uU][rR][eE]|\.)|[tT][aA][bB](?:[lL][eE]|\.)|[cC][hH][aA][rR][tT]|[gG][rR][aA][pP][hH]|[iI][mM][aA][gG][eE])"


def _numbered(text: Column) -> Column:
    return (F.length(text) > 2) & text.rlike(r"^\p{Nd}[.):]")


def _bullet(text: Column, marks: str) -> Column:
    return text.rlike(f"^[{marks}]")


def layout_type(width: Column, height: Column, current: Column) -> Column:
    """Refined by the place on the page (width and height: of the page's regions), text and current type."""
    text = X.strip(F.col("text"))
    n, open_ = F.length(text), ~text.endswith(".")
    return (
        F.when((F.col("y1") < height * 0.2) & (n < 100) & open_, "header")
        .when(F.col("y1") > height * 0.9, "footer")
        .when((n < 80) & open_ & (F.abs(G.center_x() - width / 2) < width * 0.1), "title")
        .when(_bullet(text, "•·\\-*○■") | _numbered(text), "list")
        .when(text.rlike(CAPTION), "caption")
        .otherwise(F.when(current == "unknown", "paragraph").otherwise(current))
    )


def word_box_type(height: Column) -> Column:
    """For engines of word boxes; height: of the image."""
    text, low = F.col("text"), X.strip(F.lower("text"))
    return (
        F.when((F.col("y1") < height * 0.15) & (F.length(text) < 100), "header")
        .when(F.col("y1") > height * 0.85, "footer")
        .when((F.length(text) < 80) & (G.height() > 20), "title")
        .when(_bullet(low, "•·\\-*") | _numbered(text), "list")
        .when(low.rlike(f"^({KEYWORDS}|fig\\.|tab\\.)"), "caption")
        .otherwise("paragraph")
    )


def polygon_type(extent: Column) -> Column:
    """For engines of polygons; extent: the image dimension that heights are compared with."""
    text, low = F.col("text"), X.strip(F.lower("text"))
    y, h = F.col("y1") / extent, G.height() / extent
    votes = (F.length(text) < 80).cast("int") + (~text.endswith(".")).cast("int") + (X.is_upper(text) | X.is_title(text)).cast("int") + (h > 0.02).cast("int")
    footer = r"page\s+\d+|copyright\s+©|©\s+\d{4}|confidential|proprietary|all rights reserved"
    items = r"^([•·\-*○■□]\s+|\d+[.)]\s+|[a-z][.)]\s+|[ivxlcdm]+[.)]\s+)"
    caption = rf"^((fig\.?|tab\.?|diagram|{KEYWORDS})|(source|note):\s*|\([^)]*\)$)"
    return (
        F.when((y < 0.15) & (F.length(text) < 100) & ~text.endswith("."), "header")
        .when((y > 0.85) | low.rlike(footer), "footer")
        .when(votes >= 2, "title")
        .when(low.rlike(items), "list")
        .when(low.rlike(caption), "caption")
        .otherwise("paragraph")
    )


def fixed_px_type() -> Column:
    """By absolute pixel limits."""
    text, low = F.col("text"), X.strip(F.lower("text"))
    return (
        F.when((F.col("y1") < 100) & (F.length(text) < 100), "header")
        .when(F.col("y1") > 800, "footer")
        .when((F.length(text) < 60) & ~text.endswith("."), "title")
        .when(_bullet(low, "•·\\-*○■□") | _numbered(text), "list")
        .when(low.rlike(f"{KEYWORDS}|fig\\.|tab\\.|caption"), "caption")
        .otherwise("paragraph")
    )


def relative_type() -> Column:
    """By coordinates relative to the page, from 0 to 1."""
    text, low = F.col("text"), X.strip(F.lower("text"))
    return (
        F.when((F.col("y1") < 0.15) & (F.length(text) < 100), "header")
        .when(F.col("y1") > 0.85, "footer")
        .when((F.length(text) < 80) & ~text.endswith("."), "title")
        .when(_bullet(low, "•·\\-*") | _numbered(text), "list")
        .when(low.rlike(KEYWORDS), "caption")
        .otherwise("paragraph")
    )


def element_type(name: Column) -> Column:
    """Region type of an element class of a parsing library."""
    known = {"Title": "title", "Header": "header", "NarrativeText": "paragraph", "ListItem": "list", "Table": "table", "Footer": "footer"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), name), F.lit("paragraph"))


def simple_type(text: Column) -> Column:
    return F.when(F.lower(text).rlike("^[•\\-*]"), "list").when(F.length(text) < 50, "title").otherwise("paragraph")


def hierarchy_level(types: Column) -> Column:
    """Least level of an array of types."""
    def one(t: Column) -> Column:
        out = F.lit(2)
        for name, rank in HIERARCHY.items():
            out = F.when(t == name, rank).otherwise(out)
        return out

    return F.array_min(F.transform(types, one))
