"""Exact deduplication with a cuckoo-filter index of live digests.

A CuckooIndex is a filter beside the bucketed contents of what is live, from whose digests it is
filled again when it overflows. It is used twice, each time with deletions that bound its size:

Before the exchange each partition drops copies of its own, so a text repeated millions of
times sends a few rows per partition and not all of them. The index holds the last MOST_LIVE digests and
MOST_CHARS characters of contents; beyond that the oldest are deleted, which only lets more rows through. Contents are
stored for digests met twice, so a partition without copies holds none.

After the exchange rows come sorted by digest, and best rank first. A digest that was passed is deleted
from the index with its bucket, so a task holds the different texts of one digest and no more.

A hit of the filter counts only if the text is equal to one in the digest's bucket, so
neither fingerprints nor digests that collide can drop a row. Of equal texts the row
with the least doc_id stays (null last), then the one with the least hash of all
columns; fully repeated rows leave one. A row with null text is a copy of nothing and
stays. Empty texts are equal to each other. Texts are compared whole, byte by byte, however long. Extra
columns stay as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.runtime import Numbered, releasing

_MASK = 2**64 - 1
SLOTS = 4


def _mix(x: int) -> int:
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _MASK
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _MASK
    return x ^ (x >> 32)


class CuckooIndex:
    """Partial-key cuckoo filter with 16-bit fingerprints in buckets of 4, beside the contents of the live keys.

    contains() may say yes to a key that was never inserted (about 1 in 8,000) and never says no
    to a live one; `contents` has the truth, and is looked at only after a yes. When an insertion
    finds no place after MOST_KICKS moves, the table doubles and is filled again from the stored keys.
    """

    MOST_KICKS = 200

    def __init__(self, buckets: int = 64):
        self.buckets = 1 << max(0, (buckets - 1).bit_length())
        self.table: list[list[int]] = [[] for _ in range(self.buckets)]
        self.contents: dict[int, list | tuple] = {}
        self.resizes = 0

    def _places(self, key: int) -> tuple[int, int, int]:
        h = _mix(key & _MASK)
        mark = (h >> 48) or 1
        first = h & (self.buckets - 1)
        return mark, first, first ^ (_mix(mark) & (self.buckets - 1))

    def contains(self, key: int) -> bool:
        mark, a, b = self._places(key)
        return mark in self.table[a] or mark in self.table[b]

    def __len__(self) -> int:
        return len(self.contents)

    def get(self, key: int) -> list | tuple | None:
        """The contents of a live key."""
        return self.contents.get(key) if self.contains(key) else None

    def insert(self, key: int, contents: list | tuple = ()) -> bool:
        """Make a key live; False, and nothing else, if it is."""
        if self.get(key) is not None:
            return False
        self.contents[key] = contents
        if not self._place(key):
            self._resize()
        return True

    def _place(self, key: int) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        at = a if key & 1 else b
        for kick in range(self.MOST_KICKS):
            bucket = self.table[at]
            slot = (kick * 7 + mark) % SLOTS
            mark, bucket[slot] = bucket[slot], mark
            at ^= _mix(mark) & (self.buckets - 1)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        return False

    def _resize(self) -> None:
        while True:
            self.buckets *= 2
            self.resizes += 1
            self.table = [[] for _ in range(self.buckets)]
            if all(map(self._place, self.contents)):
                return

    def delete(self, key: int) -> list | tuple | None:
        """Take a key out, and give its contents; None, and nothing else, if it isn't live."""
        if self.get(key) is None:
            return None
        mark, a, b = self._places(key)
        self.table[a if mark in self.table[a] else b].remove(mark)
        return self.contents.pop(key)

    def oldest(self) -> int:
        return next(iter(self.contents))


class LiveTexts:
    """Live texts by digest; contents: lists of [text, rank, row]."""

    def __init__(self):
        self.index = CuckooIndex()

    def offer(self, digest: int, text: str, rank: tuple, row: int) -> int | None:
        """Make a row live. Gives the row that its arrival drops: itself, or the live copy that ranks behind it."""
        held = self.index.get(digest)
        for live in held or ():
            if live[0] == text:
                if rank >= live[1]:
                    return row
                dropped, live[1], live[2] = live[2], rank, row
                return dropped
        if held is None:
            self.index.insert(digest, [[text, rank, row]])
        else:
            self.index.contents[digest] = [*held, [text, rank, row]]
        return None

    def withdraw(self, digest: int, text: str) -> bool:
        """Take a live text out; its digest leaves the index with the bucket's last text."""
        held = self.index.get(digest) or []
        kept = [x for x in held if x[0] != text]
        if len(kept) == len(held):
            return False
        self.index.contents[digest] = kept
        if not kept:
            self.index.delete(digest)
        return True


MOST_LIVE, MOST_CHARS = 1 << 18, 1 << 26


Columns = tuple[pa.Array, ...]


def _combine(parts: Iterator[Columns], most_live: int = MOST_LIVE, most_chars: int = MOST_CHARS) -> Iterator[np.ndarray]:
    """Of a partition's rows (text, digest, tie, key), batch by batch, which stay: not those that an earlier row of the partition stands for.

    The second row of a text goes on, as does any that ranks before those seen, and the shard settles it.
    """
    live, row, held = LiveTexts(), 0, 0
    index = live.index
    for texts, digests, ties, keys in parts:
        stay = np.ones(len(texts), bool)
        for i, (d, tie, key) in enumerate(zip(digests.to_pylist(), ties.to_pylist(), keys.to_pylist())):
            if not texts[i].is_valid:
                continue
            if not index.insert(d):
                row += 1
                value = texts[i].as_py()
                before = len(index.contents[d])
                stay[i] = live.offer(d, value, (key is None, key if key is not None else 0, tie), row) != row
                held += len(value) * (len(index.contents[d]) - before)
            while len(index) > most_live or held > most_chars:
                held -= sum(len(x[0]) for x in index.delete(index.oldest()))
        yield stay


def _drop_sorted(parts: Iterator[Columns]) -> Iterator[np.ndarray]:
    """Which rows (text, digest) stay: they come by digest, and best rank first, so the first of equal texts does."""
    live, last = LiveTexts(), None
    for texts, column in parts:
        stay = np.ones(len(texts), bool)
        digests = column.to_numpy()
        # Alone is what differs from both neighbours; what comes before and after the batch isn't known.
        many = np.ones(len(stay), bool)
        many[1:-1] = (digests[1:-1] == digests[:-2]) | (digests[1:-1] == digests[2:])
        for i in np.flatnonzero(many):
            d = int(digests[i])
            if d != last and last is not None:
                live.index.delete(last)
            last = d
            if texts[i].is_valid:
                stay[i] = live.offer(d, texts[i].as_py(), (), int(i)) is None
        yield stay


def _flags(run) -> Callable[..., Column]:
    """A column of what run says of the rows of a partition in turn. Only its columns go to the Python workers, and only flags come back."""
    return F.arrow_udf(releasing(lambda parts: (pa.array(x) for x in run(parts))), "boolean", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()


def exact_dedup(df: DataFrame, text: str = "text", key: str | None = "doc_id") -> DataFrame:
    """The rows of df without copies, all columns as they are. See above for ties and nulls."""
    # The row is one struct, so that no column of its can clash with ours. Null texts spread by their other columns.
    rows = Numbered(df)
    tie = F.xxhash64(*rows.df.columns)
    digest = F.when(rows[text].isNotNull(), F.xxhash64(rows[text])).otherwise(tie)
    by = rows[key].cast("long") if key else F.lit(None).cast("long")
    packed = rows.df.select(rows.row().alias("row"), rows[text].alias("text"), digest.alias("digest"), tie.alias("tie"), by.alias("key"))
    passed = packed.withColumn("stays", _flags(_combine)("text", "digest", "tie", "key")).where("stays").select("row", "digest", "tie", "key")
    spread = passed.repartition("digest").sortWithinPartitions("digest", F.col("key").asc_nulls_last(), "tie")
    return rows.restored(spread.withColumn("stays", _flags(_drop_sorted)(f"row._c{rows.place(text)}", "digest")).where("stays"))
