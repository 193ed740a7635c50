"""Text measures as column expressions; characters are Unicode code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.split() has it.
BLANKS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same for the inside of a character class. Single characters of Latin-1 are one bit set, and the rest is asked for only in its range: ranges side by side are tried one after the other for each letter.
WHITE = r"\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
SPACE, INK = f"[{WHITE}]", f"[^{WHITE}]"


def r6(x: Column) -> Column:
    """Six decimals, with slack so that ties fall alike in any engine."""
    return F.round(x + F.lit(1e-9), 6)


def two(x: Column) -> Column:
    """As %.2f, with the same slack."""
    return F.format_string("%.2f", x + F.lit(1e-9))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_region(text: Column) -> Column:
    return F.regexp_replace(strip(text), f"{SPACE}+", " ")


def clean_chunk(text: Column) -> Column:
    """White space collapsed; then only letters, digits, _ and common punctuation stay."""
    return F.regexp_replace(clean_region(text), r"""[^\p{L}\p{M}\p{N}_\s.,;:!?\-()\[\]"'/\\]+""", "")


def group_broken_paragraphs(text: Column) -> Column:
    """Lines of each paragraph joined by a space; those of lists, and of paragraphs of short lines alone, are paragraphs of their own."""
    paragraphs = F.split(text, r"\s*\n\s*\n\s*")
    lines = lambda p: F.split(p, r"\s*\n\s*")
    apart = lambda p: p.rlike(r"^\s*[•·▪●○■□*\-–]") | F.forall(lines(p), lambda x: word_count(x) < 5)
    each = F.transform(paragraphs, lambda p: F.when(apart(p), F.array_join(F.filter(lines(p), lambda x: strip(x) != ""), "\n\n")).otherwise(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.array_join(F.filter(each, lambda p: strip(p) != ""), "\n\n")


def count_of(text: Column, kind: str) -> Column:
    """Characters of a class: what is lost when its runs are taken out."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def alnum(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def special(text: Column) -> Column:
    return count_of(text, rf"[^\p{{L}}\p{{N}}{WHITE}]")


def digits(text: Column) -> Column:
    return count_of(text, r"\p{Nd}")


def upper(text: Column) -> Column:
    return count_of(text, r"\p{Lu}")


def sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[.!?]+"))


def repeats(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(.)\1{2,}"))


def single_char_words(text: Column) -> Column:
    return single_of(words(text))


def long_words(text: Column) -> Column:
    return long_of(words(text))


def single_of(listed: Column) -> Column:
    return F.size(F.filter(listed, lambda w: F.length(w) == 1))


def long_of(listed: Column) -> Column:
    return F.size(F.filter(listed, lambda w: F.length(w) > 20))


def chars_of(listed: Column) -> Column:
    return F.aggregate(listed, F.lit(0), lambda n, w: n + F.length(w))


def ratio(a: Column, b: Column) -> Column:
    """0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def mean_in_order(value: Column, *order: str) -> Column:
    """Aggregate: the mean with values added in one order, whatever order rows come in, so that its last digit can't move a row over a threshold."""
    kept = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.cast("double").alias("_v")))))
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["_v"]) / F.nullif(F.count(value), F.lit(0))


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_title(text: Column) -> Column:
    return (F.initcap(text) == text) & (F.lower(text) != F.upper(text))


def level(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.7, "acceptable").when(score >= 0.5, "poor").otherwise("unusable")


def document_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".jpg", ".jpeg", ".png", ".bmp"), "image").when(ext.isin(".tiff", ".tif"), "multi_page_tiff").otherwise("unknown")


def cache_key(path: Column, size: Column, mtime: Column) -> Column:
    return F.md5(F.coalesce(F.when(size.isNotNull() & mtime.isNotNull(), F.concat_ws("_", path, size, mtime)), path).cast("binary"))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters, each `size - overlap` after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be under the size")
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _undotted(text: Column) -> Column:
    """The one letter beyond ASCII whose lower case has a vowel, as that lower case: vowels can then be looked for in both cases, and texts needn't be made lower case."""
    return F.replace(text, F.lit("\u0130"), F.lit("i\u0307"))


def syllables(text: Column) -> Column:
    return F.regexp_count(_undotted(text), F.lit(f"[{VOWELS}]+"))


VOWELS = "aeiouyAEIOUY"
#: A word from its first vowel on, if it has three groups of vowels.
HARD = rf"[{VOWELS}]++[^{VOWELS}{WHITE}]++[{VOWELS}]++[^{VOWELS}{WHITE}]++[{VOWELS}]{INK}*+"


def text_counts(text: Column) -> dict[str, Column]:
    """What readability is made of: words, sentences, letters and digits, vowel groups and hard words. One pass over the text for each."""
    return {
        "_words": F.regexp_count(text, F.lit(f"{INK}+")), "_sentences": sentences(text), "_chars": alnum(text),
        "_syllables": syllables(text), "_hard": F.regexp_count(_undotted(text), F.lit(HARD)),
    }


def readability(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Published formulas over characters, words, sentences and vowel groups of `text`; nulls for texts without words.

    The counts are columns of the rows returned, so that formulas name them instead of working them out once more.
    """
    w = F.when(F.col("_words") != 0, F.col("_words").cast("double"))
    s = F.greatest(F.col("_sentences"), F.lit(1)).cast("double")
    chars, syl, hard = (F.col(c).cast("double") for c in ("_chars", "_syllables", "_hard"))
    return docs.withColumns(text_counts(F.col("text"))), {
        "ari": 4.71 * chars / w + 0.5 * w / s - 21.43,
        "coleman_liau": 0.0588 * (100 * chars / w) - 0.296 * (100 * s / w) - 15.8,
        "flesch": 206.835 - 1.015 * w / s - 84.6 * syl / w,
        "fog": 0.4 * (w / s + 100 * hard / w),
        "difficult_ratio": hard / w,
    }
