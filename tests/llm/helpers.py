"""Tables with every kind of awkward row, and words made up from few syllables."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


def prose(seed, n, syllables="ba do ki lu me no pa ri su ta vo we xi yo zu".split()):
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def words(text):
    lower = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text.encode())
    return re.findall(rb"[a-z0-9\x80-\xff]+", lower)


def grams(text, n):
    w = words(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(1, 60_000)
    return docs(
        spark,
        [
            (1, "same text here", "en", "a"), (2, "same text here", "en", None), (2, "same text here", "en", None), (None, "same text here", None, "a"),
            (3, "", "en", "a"), (4, "", None, "b"), (5, None, "en", "a"), (6, None, None, None), (None, None, None, None),
            (7, long, "en", "a"), (8, long, "en", "b"), (9, "  \n\t ", "en", "a"), (10, "Same text here", "en", "a"), (11, "!!! ...", "xx", "a"), (12, "one", "en", "a"),
        ],
    )
