"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Features of a text are its 1- to `n`-grams of words and runs of punctuation, hashed to
2^bits places, each with its count over the root of the number of n-grams. The model
is fitted on a bounded sample of labelled rows (at most max_rows: one row, the least text, of each of the
keys with the least hash) in a fixed order; scoring is a sparse dot product over the whole text, however long.

A key with both labels counts as good. Null labels, labels other than 0 and 1, null keys and null
texts are not learned from. Scores that tie with the threshold are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.runtime import map_arrow, only
from foliospark.llm.textops import U, Words, blocks, int64_list, utf8

SCHEMA = "doc_id long, quality double, keep boolean"


def features(words: Words, n: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: places, and bounds by row."""
    return [((grams >> U(64 - bits)).astype(np.int32), bounds) for grams, bounds in (words.ngrams(k) for k in range(1, n + 1))]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    n: int
    bits: int
    threshold: float = 0.5

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of good quality; NaN for a text without words."""
        out = np.full(len(offsets) - 1, np.nan)
        for i, j in blocks(offsets):
            total, count = np.zeros(j - i), np.zeros(j - i, np.int64)
            for places, bounds in features(Words(data, offsets, i, j, punctuation=True), self.n, self.bits):
                run = np.zeros(len(places) + 1)
                np.cumsum(self.weights[places], out=run[1:])
                total += run[bounds[1:]] - run[bounds[:-1]]
                count += np.diff(bounds)
            some = count > 0
            out[i:j][some] = 1 / (1 + np.exp(-np.clip(self.bias + total[some] / np.sqrt(count[some]), -35, 35)))
        return out


def train(rows: list[np.ndarray], labels: np.ndarray, n: int, bits: int, passes: int = 2, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> Model:
    """FTRL-proximal, one example at a time. rows: places of each example's n-grams, repeated as often as they occur."""
    z, g2 = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = gb = 0.0
    examples = [(np.unique(r, return_counts=True), len(r)) for r in rows]
    weight = lambda z, g2: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))
    for _ in range(passes):
        for ((places, counts), size), y in zip(examples, labels):
            x = counts / np.sqrt(max(size, 1))
            w = weight(z[places], g2[places])
            wb = -zb / ((beta + np.sqrt(gb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ x + wb, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(g2[places] + g * g) - np.sqrt(g2[places])) / alpha
            z[places] += g - s * w
            g2[places] += g * g
            zb += (p - y) - (np.sqrt(gb + (p - y) ** 2) - np.sqrt(gb)) / alpha * wb
            gb += (p - y) ** 2
    return Model(weight(z, g2), float(-zb / ((beta + np.sqrt(gb)) / alpha)), n, bits)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", n: int = 2, bits: int = 18, max_rows: int = 4000, keep_recall: float = 0.995) -> Model:
    """Train on at most max_rows labelled rows; every fifth is held out to set the threshold.

    The threshold is at most 0.5 and low enough to keep the share keep_recall of the held-out
    good rows. Without labelled rows every score is 0.5 and everything with words is kept.
    """
    spark = docs.sparkSession
    marked = only(labels, key="doc_id", y=label).select("key", F.col("y").cast("int").alias("y")).where("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    # A sample bounded by max_rows, so it may be broadcast at any size of the tables.
    sample = spark.createDataFrame(marked.orderBy(F.xxhash64("key"), "key").limit(max_rows).toArrow())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = utf8(batch.column(2))
            for i, j in blocks(offsets):
                parts = features(Words(data, offsets, i, j, punctuation=True), n, bits)
                for r in range(j - i):
                    row = np.concatenate([p[b[r] : b[r + 1]] for p, b in parts])
                    at = i + r
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 1], batch.column(1)[at : at + 1], int64_list(row, np.array([0, len(row)]))], ["key", "y", "places"])

    found = only(docs, key="doc_id", t="text").where("t is not null").join(F.broadcast(sample), "key").groupBy("key").agg(F.first("y").alias("y"), F.min("t").alias("t"))
    got = map_arrow(found, places, "key long, y int, places array<long>").toArrow().sort_by("key")
    if not got.num_rows:
        return Model(np.zeros(1 << bits), 0.0, n, bits, 0.5)
    keys, y = got.column("key").to_numpy(), got.column("y").to_numpy()
    flat = got.column("places").combine_chunks()
    edges = flat.offsets.to_numpy()
    values = flat.values.to_numpy()
    rows = [values[a:b] for a, b in zip(edges[:-1], edges[1:])]
    order = np.random.default_rng(7).permutation(len(keys))
    held, used = order[::5], np.array([k for i, k in enumerate(order) if i % 5])
    model = train([rows[k] for k in used], y[used], n, bits) if len(used) else Model(np.zeros(1 << bits), 0.0, n, bits)
    good = [1 / (1 + np.exp(-np.clip(model.bias + model.weights[rows[k]].sum() / np.sqrt(len(rows[k])), -35, 35))) for k in held if y[k] and len(rows[k])]
    model.threshold = min(0.5, float(np.quantile(good, 1 - keep_recall))) if good else 0.0
    return model


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row: quality (null for null text or text without words) and keep (false there).

    Repeated rows score alike; other columns make no difference, and their names may clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = utf8(batch.column(1))
            found = model.scores(data, offsets)
            none = np.isnan(found)
            with np.errstate(invalid="ignore"):
                keep = ~none & (found >= model.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, mask=none), pa.array(keep)], ["doc_id", "quality", "keep"])

    return map_arrow(only(df, key=key, text=text).select(F.col("key").cast("long"), "text"), run, SCHEMA)
