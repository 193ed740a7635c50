"""Language of a text by its stop words, where no detector is at hand; names of languages as engines have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as X

STOP_WORDS = {
    "en": "the and of to in is that it was for on with as are be this have from or by not but they you which".split(),
    "de": "der die das und ist nicht ein eine von mit den dem zu im auf sich des für auch als an es werden aus".split(),
    "fr": "le la les et des est une un que dans pour pas sur au par plus du qui ce il avec sont aux ne".split(),
    "es": "el los las y que una un por con para del se al como es su más pero sus lo está entre cuando muy".split(),
}
ENGINE_CODES = {"zh": "ch_sim", "zh-cn": "ch_sim", "zh-tw": "ch_tra"}


def _hits(listed: Column, known: list[str]) -> Column:
    return F.size(F.filter(listed, lambda w: w.isin(*known)))


def detect(text: Column, default: str = "en", least: int = 20) -> Column:
    """The language with the most stop words in the text, the first by name of equal ones; the default for texts of `least` characters or fewer, or without any."""
    listed = X.words(F.regexp_replace(F.lower(text), r"[.,;:!?()\"]+", " "))
    known = sorted(STOP_WORDS)

    def chosen(hits: Column) -> Column:
        found = F.lit(default)
        for i, k in reversed(list(enumerate(known))):
            found = F.when((hits[i] == F.array_max(hits)) & (hits[i] > 0), k).otherwise(found)
        return found

    # Words and counts are bound as arguments of functions: named twice, an expression is worked out twice.
    hits = F.transform(F.array(listed), lambda w: F.array(*[_hits(w, STOP_WORDS[k]) for k in known]))
    return F.when(F.length(X.strip(text)) > least, F.transform(hits, chosen)[0]).otherwise(F.lit(default))


def engine_code(language: Column) -> Column:
    """A language as recognition engines name it."""

    def named(found: Column) -> Column:
        out = found
        for code, name in ENGINE_CODES.items():
            out = F.when(F.lower(found) == code, name).otherwise(out)
        return out

    return F.transform(F.array(language), named)[0]
