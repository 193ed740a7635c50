"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of 0 to `max_order` bytes, counted once
over a bounded sample of labelled rows and then frozen. A byte costs what a PPM
coder with method C and full exclusion would spend on it: the bits of each escape
from a context that has not seen the byte, without the bytes already excluded, and
then of the byte itself; below order 0 all 256 bytes left are alike. Code lengths
are whole numbers of 2^-16 bits, so their sum depends neither on batches nor on
order. The language with the fewest bits wins; equal ones: the first by name.

Texts count whole, however long. Repeated rows and null keys are judged like others; extra columns make no
difference, and their names may clash. An empty table, or one without labelled rows, gives a model
without languages, by which nothing is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.runtime import BATCH_ROWS, Numbered, map_arrow, only, releasing
from foliospark.llm.textops import U, blocks, utf8

UNIT = 1 << 16
SCHEMA = "doc_id long, language string, bits double, bits_per_byte double, keep boolean"


def packed(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte a key of `order` bytes before it and the byte itself, in the lowest place. Before a text there are NULs."""
    key = data.astype(U)
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.uint8)
        before[k:] = data[:-k] if k else data
        for t in range(k):
            at = starts + t
            before[at[at < len(data)]] = 0
        key |= before.astype(U) << U(8 * k)
    return key


def _clear(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return starts[lengths > 0]


@dataclass
class Tree:
    """Frozen counts of one language. By order: sorted grams (context and byte) with counts; sorted contexts with totals, distinct bytes, and what their parent has left without their bytes."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]
    left: list[np.ndarray]

    @staticmethod
    def fit(data: np.ndarray, starts: np.ndarray, max_order: int) -> Tree:
        t = Tree([], [], [], [], [], [])
        full = packed(data, starts, max_order)
        for k in range(max_order + 1):
            grams, counts = np.unique(full & U((1 << (8 * (k + 1))) - 1) if k < 7 else full, return_counts=True)
            contexts, first = np.unique(grams >> U(8), return_index=True)
            t.grams.append(grams)
            t.counts.append(counts)
            t.contexts.append(contexts)
            t.totals.append(np.add.reduceat(counts, first) if len(first) else counts)
            t.distinct.append(np.diff(np.append(first, len(grams))))
            if k == 0:
                t.left.append(np.zeros(len(contexts), np.int64))
                continue
            parents = grams & U((1 << (8 * k)) - 1)
            taken = np.add.reduceat(t.counts[k - 1][np.searchsorted(t.grams[k - 1], parents)], first) if len(first) else counts
            up = np.searchsorted(t.contexts[k - 1], contexts & U((1 << (8 * (k - 1))) - 1))
            t.left.append(t.totals[k - 1][up] - taken)
        return t

    def bits(self, keys: np.ndarray, max_order: int) -> np.ndarray:
        """Exact cost of each key's byte after its context, in units of 2^-16 bit."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        below = np.full(len(keys), -1)  # the context, one order higher, that was escaped from
        for k in range(max_order, -1, -1):
            if not len(todo) or not len(self.contexts[k]):
                continue
            key = keys[todo] & U((1 << (8 * (k + 1))) - 1) if k < 7 else keys[todo]
            ctx = key >> U(8)
            at = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == ctx
            g = np.minimum(np.searchsorted(self.grams[k], key), len(self.grams[k]) - 1)
            seen = known & (self.grams[k][g] == key)
            after = known & (below[todo] >= 0)
            came = np.maximum(below[todo], 0)
            escapes = np.where(after, self.distinct[k][at] - (self.distinct[k + 1][came] if k < max_order else 0), self.distinct[k][at])
            total = np.where(after, (self.left[k + 1][came] if k < max_order else 0), self.totals[k][at]) + escapes
            cost = np.log2(np.maximum(total, 1))
            out[todo[seen]] += cost[seen] - np.log2(self.counts[k][g[seen]])
            missed = known & ~seen
            out[todo[missed]] += cost[missed] - np.log2(np.maximum(escapes[missed], 1))
            below[todo] = np.where(known, at, -1)
            todo = todo[~seen]
        if len(todo):
            out[todo] += np.log2(256 - (self.distinct[0][0] if len(self.distinct[0]) else 0))
        return np.rint(out * UNIT).astype(np.int32)


class Costs:
    """Open-addressed table from a key to its cost in every language; what isn't there is worked out once and added."""

    MOST = 1 << 19

    def __init__(self, languages: int, bits: int = 16):
        self.bits, self.used, self.languages = bits, 0, languages
        self.keys = np.zeros(1 << bits, U)
        self.values = np.zeros((1 << bits, languages), np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether the key is there."""
        at = ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        hit = held == keys + U(1)
        open_ = np.flatnonzero(~hit & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            same = held == keys[open_] + U(1)
            hit[open_[same]] = True
            open_ = open_[~same & (held != 0)]
        return at, hit

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys."""
        while (self.used + len(keys)) * 2 > 1 << self.bits:
            old, kept = self.keys[self.keys != 0] - U(1), self.values[self.keys != 0]
            self.__init__(self.languages, self.bits + 1)
            self._put(old, kept)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.used += len(keys)
        while len(keys):
            at, _ = self.find(keys)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.values[at[first]] = keys[first] + U(1), values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]


@dataclass
class Model:
    """Trees of all languages, by name."""

    languages: list[str]
    trees: list[Tree]
    max_order: int
    _costs: Costs | None = None

    def __getstate__(self):
        return self.__dict__ | {"_costs": None}

    @staticmethod
    def fit(samples: dict[str, list[str]], max_order: int) -> Model:
        if not 0 <= max_order <= 6:
            raise ValueError("max_order must be 0 to 6")
        names = sorted(k for k, texts in samples.items() if any(texts))
        trees = []
        for name in names:
            raw = [t.encode() for t in samples[name] if t]
            starts = np.cumsum([0, *map(len, raw)])[:-1]
            trees.append(Tree.fit(np.frombuffer(b"".join(raw), np.uint8), starts, max_order))
        return Model(names, trees, max_order)

    def exact(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(keys, self.max_order) for t in self.trees], axis=1)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        if self._costs is None:
            self._costs = Costs(len(self.languages))
            seen = np.unique(np.concatenate([t.grams[self.max_order] for t in self.trees]))
            self._costs.add(seen, self.exact(seen))
        at, hit = self._costs.find(keys)
        if hit.all():
            return self._costs.values[at]
        out = self._costs.values[at]
        new, back = np.unique(keys[~hit], return_inverse=True)
        values = self.exact(new)
        out[~hit] = values[back]
        if self._costs.used + len(new) <= Costs.MOST:
            self._costs.add(new, values)
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in units of 2^-16 bit. A long text goes piece by piece, with its context."""
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        for i, j in blocks(offsets, 1 << 19):
            if j == i + 1:
                for a in range(int(offsets[i]), int(offsets[j]), 1 << 19):
                    lead = min(self.max_order, a - int(offsets[i]))
                    piece = data[a - lead : min(a + (1 << 19), int(offsets[j]))]
                    starts = np.zeros(0 if lead else 1, np.int64)
                    out[i] += self.cost(packed(piece, starts, self.max_order)[lead:]).sum(axis=0, dtype=np.int64)
                continue
            lengths = np.diff(offsets[i : j + 1])
            starts = _clear(offsets[i:j] - offsets[i], lengths)
            if len(starts):
                costs = self.cost(packed(data[offsets[i] : offsets[j]], starts, self.max_order))
                out[i:j][lengths > 0] = np.add.reduceat(costs, starts, axis=0, dtype=np.int64)
        return out


def fit(df: DataFrame, per_language: int = 200, max_order: int = 3, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    """Count the trees over at most `per_language` rows of each language, whole texts: one row (the least text) of each of the keys with the least hash."""
    rows = only(df, key=key, label=label, text=text).where("label is not null and key is not null")
    least = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key")
    # Each partition passes on its least keys alone; a repeated key has one rank, and gives one text before anything is collected.
    chosen = rows.select("key", "label").withColumn("nth", F.dense_rank().over(least)).where(F.col("nth") <= per_language).select("key", "label").distinct()
    found = rows.where("text is not null").join(F.broadcast(chosen), ["key", "label"], "left_semi").groupBy("key", "label").agg(F.min("text").alias("text")).toArrow().to_pylist()
    samples: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["label"], r["key"])):
        samples.setdefault(r["label"], []).append(r["text"])
    return Model.fit(samples, max_order)


def _best(model: Model, column: pa.Array, max_bits_per_byte: float):
    data, offsets, valid = utf8(column)
    size = np.diff(offsets)
    if not model.languages:
        none = np.full(len(valid), -1)
        return none, np.full(len(valid), np.nan), np.full(len(valid), np.nan), np.zeros(len(valid), bool)
    lengths = model.lengths(data, offsets)
    best = lengths.argmin(axis=1)
    bits = lengths[np.arange(len(best)), best] / UNIT
    rate = np.divide(bits, size, out=np.full(len(size), np.nan), where=size > 0)
    with np.errstate(invalid="ignore"):
        keep = (size > 0) & (rate <= max_bits_per_byte)
    return np.where(size > 0, best, -1), np.where(size > 0, bits, np.nan), rate, keep


def identify(df: DataFrame, model: Model, max_bits_per_byte: float = 6.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row: language, bits, bits_per_byte and keep.

    keep is false where no language's tree fits (more than max_bits_per_byte) and for
    null or empty text, whose other results are null. Null keys, repeated rows and
    extra columns make no difference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, bits, rate, keep = _best(model, batch.column(1), max_bits_per_byte)
            null = best < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([None if b < 0 else model.languages[b] for b in best], pa.string()), pa.array(bits, mask=null), pa.array(rate, mask=null), pa.array(keep)],
                ["doc_id", "language", "bits", "bits_per_byte", "keep"],
            )

    return map_arrow(only(df, key=key, text=text).select(F.col("key").cast("long"), "text"), run, SCHEMA)


def keep_identified(df: DataFrame, model: Model, max_bits_per_byte: float = 6.0, text: str = "text") -> DataFrame:
    """The rows that identify() keeps, with all of their columns. Only texts go to the Python workers, and only flags come back."""
    rows = Numbered(df)

    def flags(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [_best(model, column.slice(at, BATCH_ROWS), max_bits_per_byte)[3] for at in range(0, len(column), BATCH_ROWS)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    kept = rows.df.where(F.arrow_udf(releasing(flags), "boolean", F.ArrowUDFType.SCALAR_ITER)(rows[text]))
    return kept.toDF(*rows.names)
