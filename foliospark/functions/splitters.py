"""Text splitters that depend on what came before, as Arrow-batched functions."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")
PIECES = "doc_id long, chunk_index int, chunk string"


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the first separator that occurs, pieces too long by the next ones; then merge neighbours up to the size, with overlap."""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    parts = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    held: list[str] = []
    for p in parts:
        if len(p) <= size:
            held.append(p)
            continue
        out += merge(held, sep, size, overlap)
        held = []
        out += recursive_split(p, size, overlap, finer) if finer else [p]
    return out + merge(held, sep, size, overlap)


def merge(parts: list[str], sep: str, size: int, overlap: int) -> list[str]:
    out, held, total = [], [], 0
    for p in parts:
        n = len(p)
        if held and total + n + len(sep) > size:
            out.append(sep.join(held))
            while held and (total > overlap or total + n + len(sep) > size):
                total -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held.pop(0)
        total += n + (len(sep) if held else 0)
        held.append(p)
    return out + ([sep.join(held)] if held else [])


def sentences_of(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]


def sentence_split(text: str, size: int, overlap: int) -> list[str]:
    """Whole sentences packed up to the size."""
    return merge(sentences_of(text), " ", size, overlap)


def hashed_vector(text: str, dims: int = 64) -> list[float]:
    v = [0.0] * dims
    for w in text.lower().split():
        v[zlib.crc32(w.encode()) % dims] += 1.0
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def semantic_split(text: str, percentile: float = 90, embed=hashed_vector) -> list[str]:
    """Sentences, broken where the distance to the next window of sentences is over the percentile of all such distances."""
    s = sentences_of(text)
    if len(s) < 2:
        return s
    near = [embed(" ".join(s[max(0, i - 1) : i + 2])) for i in range(len(s))]
    gaps = [1 - sum(a * b for a, b in zip(x, y)) for x, y in zip(near, near[1:])]
    ranked = sorted(gaps)
    at = (len(ranked) - 1) * percentile / 100
    low = int(at)
    limit = ranked[low] + (ranked[min(low + 1, len(ranked) - 1)] - ranked[low]) * (at - low)
    out, held = [], [s[0]]
    for gap, sentence in zip(gaps, s[1:]):
        if gap > limit:
            out.append(" ".join(held))
            held = []
        held.append(sentence)
    return [*out, " ".join(held)]


SPLITTERS = {
    "recursive": lambda t, size, overlap: recursive_split(t, size, overlap),
    "sentence": lambda t, size, overlap: sentence_split(t, size, overlap),
    "semantic": lambda t, size, overlap: semantic_split(t),
}


def split_texts(docs: DataFrame, strategy: str = "recursive", size: int = 1000, overlap: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_index, chunk) of texts (doc_id, text). carry: columns of the text that each piece has as well."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be under the size")
    split = SPLITTERS[strategy]
    names = ["doc_id", "chunk_index", "chunk", *carry]
    schema = ", ".join([PIECES, *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts are taken up one by one and pieces given out by the megabyte: a worker holds a batch as it comes and little besides.
        for b in batches:
            made: list[tuple[int, int, str, int]] = []
            held = 0
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                if text:
                    made += [(b.column(0)[i].as_py(), k, c, i) for k, c in enumerate(split(text, size, overlap))]
                    held += len(text)
                if made and (held > 1 << 20 or i == b.num_rows - 1):
                    d, k, c, rows = zip(*made)
                    at = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(c, pa.string()), *[b.column(j).take(at) for j in range(2, b.num_columns)]], names)
                    made, held = [], 0

    return docs.select(F.col("doc_id").cast("long"), "text", *carry).mapInArrow(run, schema)
