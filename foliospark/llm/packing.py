"""Best-fit packing of documents into sequences under conflict constraints.

A document of more tokens than a bin holds is cut into full pieces, each a bin of its
own, and a rest. Pieces are packed in order of falling size (equal sizes: by doc_id,
then piece). Bins stay ordered by residual; from the first one in which the piece fits,
the search goes on to its successors until a bin is found whose bitmaps of sources and of
duplicate clusters hold neither the piece's source nor its cluster: the tightest
compatible bin. If there is none, a bin is opened.

Clusters are of texts equal up to case and white space, or those of a column given instead.
Besides, documents can be of groups of near copies (`near`), of which a bin takes one too.

Documents are spread by a hash over shards of about `shard` documents, packed each by
itself, so work per document stays the same at any size. What a shard leaves in bins less than half
full is packed again, over fewer shards of its own, as long as that frees one bin in 50 and the commonest
source's pieces leave so many to be freed: pieces that had no partner in their shard find it in another.

Documents without tokens (null or empty text) are in no bin. Null source and null doc_id
are values like others: two documents of unknown source don't share a bin. Repeated rows
are of one cluster and so never meet; they are counted before they are spread, by their number, so one
row repeated without end is no shard of its own. Texts count whole, however long: one of more tokens than a bin
is cut into bins of its own and a rest. Extra columns make no difference, and their names may clash.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.runtime import map_arrow, materialize, only
from foliospark.llm.textops import U, blocks, mix, powers, utf8

SCHEMA = "doc_id long, piece int, tokens long, bin_id long, bin_offset long, source string"
BIN_BITS = 32


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, near: list | None = None) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given. near: groups of near copies, None for pieces of none."""
    bit: dict = {}
    bins: list[list[int]] = []  # residual, bitmap
    open_: list[tuple[int, int]] = []  # (residual, bin), sorted
    out = []
    least = min(sizes, default=0)
    for size, source, cluster, group in zip(sizes, sources, clusters, near or [None] * len(sizes)):
        marks = 1 << bit.setdefault(("s", source), len(bit)) | 1 << bit.setdefault(("c", cluster), len(bit))
        if group is not None:
            marks |= 1 << bit.setdefault(("n", group), len(bit))
        at = bisect_left(open_, (size, -1))
        while at < len(open_) and bins[open_[at][1]][1] & marks:
            at += 1
        if at < len(open_):
            _, b = open_.pop(at)
        else:
            b = len(bins)
            bins.append([capacity, 0])
        offset = capacity - bins[b][0]
        bins[b][0] -= size
        bins[b][1] |= marks
        if bins[b][0] >= least:
            insort(open_, (bins[b][0], b))
        out.append((b, offset))
    return out


_byte = np.arange(256)
BLANK = np.isin(_byte, [9, 10, 11, 12, 13, 32])
_VALUE = mix(_byte.astype(U) + U(1)) | U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row its tokens: runs of bytes that aren't white space, as word_count() has them."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in blocks(offsets):
        own, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        blank = BLANK[own]
        before = np.ones(len(own), bool)
        before[1:] = blank[:-1]
        before[edges[:-1][edges[:-1] < len(own)]] = True
        begun = np.zeros(len(own) + 1, np.int64)
        np.cumsum(before & ~blank, out=begun[1:])
        out[i:j] = np.diff(begun[edges])
    return out


def clusters_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row a 64-bit hash of its bytes that aren't white space, and of how many they are."""
    out = np.zeros(len(offsets) - 1, U)
    for i, j in blocks(offsets):
        own, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        ink = ~BLANK[own]
        places = np.zeros(len(own) + 1, np.int64)
        np.cumsum(ink, out=places[1:])
        edges, kept = places[edges], own[ink]
        total = np.zeros(len(kept) + 1, U)
        np.cumsum(_VALUE[kept] * powers(len(kept), _BASE), out=total[1:])
        back = powers(len(kept) + 1, _INVERSE)
        out[i:j] = mix((total[edges[1:]] - total[edges[:-1]]) * back[edges[:-1]] ^ mix(np.diff(edges).astype(U)))
    return out


#: Copies of a row that one row of a table of counts becomes at a time.
RUN = 10_000
PIECES = "doc_id long, piece int, tokens long, cluster string, near long, source string, bin long, bin_offset long, half boolean"
NAMES = ["doc_id", "piece", "tokens", "cluster", "near", "source", "bin", "bin_offset", "half"]


def _pack_shard(capacity: int):
    """Packs a shard's pieces, and documents that are still to be cut (piece -1)."""

    def run(rows: pa.Table) -> pa.Table:
        columns = [rows.column(n).to_pylist() for n in ("doc_id", "piece", "tokens", "cluster", "near", "source")]
        rank = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[5] or "")
        done, rests, bins = [], [], 0
        first = rows.column("shard")[0].as_py() << BIN_BITS if rows.num_rows else 0
        for r in sorted(zip(*columns), key=rank):
            doc, piece, tokens, *rest = r
            if piece >= 0:
                rests.append(r)
                continue
            for k in range(tokens // capacity):
                done.append((doc, k, capacity, *rest, first + bins, 0, False))
                bins += 1
            if tokens % capacity:
                rests.append((doc, tokens // capacity, tokens % capacity, *rest))
        rests.sort(key=lambda r: (-r[2], *rank(r)))
        placed = best_fit([r[2] for r in rests], [r[5] for r in rests], [r[3] for r in rests], capacity, [r[4] for r in rests])
        filled: dict[int, int] = {}
        for r, (b, _) in zip(rests, placed):
            filled[b] = filled.get(b, 0) + r[2]
        done += [(*r, first + bins + b, offset, 2 * filled[b] < capacity) for r, (b, offset) in zip(rests, placed)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 9, kinds)], NAMES)

    return run


def pack(df: DataFrame, capacity: int = 2048, shard: int = 4096, text: str = "text", source: str = "source", key: str = "doc_id", cluster: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, tokens, bin_id, bin_offset, source. cluster: a column of known duplicate clusters; near: (doc_id, near) of documents with near copies, a row each."""
    if capacity < 1 or shard < 1:
        raise ValueError("capacity and shard must be positive")
    names = {"doc_id": key, "source": source, "text": text} | ({"cluster": cluster} if cluster else {})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = utf8(batch.column(2))
            tokens = tokens_of(data, offsets)
            if cluster:
                marks = pc.fill_null(batch.column(3), "")
            else:
                marks = pa.array(clusters_of(*utf8(pc.utf8_lower(batch.column(2)))[:2]).view(np.int64)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), marks], ["doc_id", "source", "tokens", "cluster"]).filter(pa.array(tokens > 0))

    read = only(df, **names).withColumns({"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string")} | ({"cluster": F.col("cluster").cast("string")} if cluster else {}))
    light = map_arrow(read, measured, "doc_id long, source string, tokens long, cluster string")
    light = light.groupBy("doc_id", "source", "tokens", "cluster").agg(F.count("*").alias("copies"))
    light = light.withColumn("near", F.lit(None).cast("long")) if near is None else light.join(near.select("doc_id", "near"), "doc_id", "left")
    light = materialize(light)
    left, most = light.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    rows = light.withColumn("copy", F.lit(0).cast("long"))
    if most > 1:
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN)))
        nth = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN) - 1))
        rows = light.withColumn("run", runs).withColumn("nth", nth).withColumn("copy", F.col("run") * RUN + F.col("nth"))
    rows = rows.withColumn("piece", F.lit(-1))
    done, begun, turn = None, 0, 0
    while True:
        shards = max(1, -(-left // shard))
        place = F.pmod(F.xxhash64("doc_id", "cluster", "copy", F.lit(turn)), F.lit(shards)) + begun
        packed = materialize(rows.withColumn("shard", place).groupBy("shard").applyInArrow(_pack_shard(capacity), PIECES))
        bins, half, few = packed.agg(F.count_distinct("bin"), F.count_distinct(F.when(F.col("half"), F.col("bin"))), F.count_if("half")).first()
        over = packed.where("half").groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
        # Each piece of the commonest source needs a bin, and all tokens need so many: what is over that can be freed, at most.
        least = max(over[0], -(-over[1] // capacity))
        if shards == 1 or 50 * (half - least) < half or (turn and 50 * (before - bins) < before):
            last = packed if done is None else done.unionByName(packed)
            break
        kept = packed.where("not half")
        done = kept if done is None else done.unionByName(kept)
        rows = packed.where("half").select("doc_id", "piece", "tokens", "cluster", "near", "source", F.col("bin").alias("copy"))
        begun, before, left, turn = begun + shards, half, few, turn + 1
    return last.select("doc_id", "piece", "tokens", F.col("bin").alias("bin_id"), "bin_offset", "source")
