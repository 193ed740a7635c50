"""Jaccard join of word n-gram sets by chosen paths (CPSJoin).

A set is the distinct n-grams of a text's words (textops), embedded as t minhash
tokens. In each run a bucket of sets is split on sampled tokens: token j of a bucket is
drawn with probability 1/(threshold * t), by a hash of the bucket's path and j, and the
sets that share a drawn token go to the same child. Buckets of at most `small` sets, and
those at the last depth, are compared by brute force; one of more than `local` sets at the
last depth is cut into blocks, and each pair of blocks is a task. A pair at the threshold
meets at depth k of one run with a probability that follows from the branching process alone.
What meets is screened by sketches (a byte of each token), which loses a pair at the threshold with a
probability that follows from the binomial law. Runs are repeated until the recall that both leave
is the target. Equal sets count as one throughout, with a weight, so copies cost nothing.

Sets whose sketches agree are linked into components. In a component of at most `block` sets
all pairs are compared on their exact sets. The sets of a larger one are spread over blocks, and a
set is sent to a pair of blocks only if one that it met lies on the other side: so a long chain costs what
its candidates do and not the square of its length. No number of partners or candidates is capped. A
comparison gives, for each set, the weight of the sets at or over the threshold and one of them
that connects it; pairs are never written out.

A row with null doc_id is left out. Null, empty and wordless texts have no set and are linked to
nothing. Rows of one doc_id and one set count once, however often they are repeated; rows of one
doc_id with different sets are versions, each with links of its own. Sets are told apart by
64-bit hashes of all their n-grams and their size. Texts are read whole, however long. Ties: of equal
candidates the least doc_id stands for the class. Other columns make no difference, and their
names may clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.runtime import Numbered, discard, map_arrow, materialize, only, releasing
from foliospark.llm.textops import U, Words, blocks, int64_list, mix, utf8

SKETCHES = "doc_id long, set_hash long, sketch binary, paths array<long>"
NAMES = ["doc_id", "set_hash", "sketch", "paths"]
_GOLD = 0x9E3779B97F4A7C15


def meeting(threshold: float, tokens: int, depth: int) -> float:
    """Probability that two sets at the threshold share a bucket at the depth, in one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - p / (threshold * tokens)) ** round(threshold * tokens)
    return p


def screened(threshold: float, tokens: int, least: int) -> float:
    """Probability that fewer than `least` of the tokens of two sets at the threshold agree: what the sketches lose at most."""
    return sum(comb(tokens, k) * threshold**k * (1 - threshold) ** (tokens - k) for k in range(least))


def runs_for(recall: float, threshold: float, tokens: int, depth: int, lost: float = 0.0) -> int:
    """Runs for the recall, if the screen loses the share `lost` of what meets, whatever the run."""
    if recall >= 1 - lost:
        raise ValueError(f"the screen alone loses {lost:.3g}: give it more slack or a lower recall")
    return max(1, ceil(log(1 - recall / (1 - lost)) / log(1 - meeting(threshold, tokens, depth))))


def _seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(_GOLD) + U(seed)) | U(1)


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By block of rows i..j: sorted distinct n-gram hashes and their bounds."""
    for i, j in blocks(offsets):
        grams, bounds = Words(data, offsets, i, j).ngrams(n)
        sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        yield i, j, np.concatenate(sets) if sets else grams, np.cumsum([0, *map(len, sets)])


def set_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of non-empty sets: a sum that doesn't depend on order, with the size mixed in."""
    return mix(np.add.reduceat(mix(values), bounds[:-1]) ^ (np.diff(bounds).astype(U) * U(_GOLD)))


def sketches(df: DataFrame, n: int, threshold: float, tokens: int, runs: int, seed: int, text: str, key: str) -> DataFrame:
    """Of each row with a key: hash of its set, sketch, and the paths of its first split in all runs; all null without a word."""
    limit = U(int(2**64 / (threshold * tokens)) if threshold * tokens > 1 else 2**64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, starts = _seeds(tokens, seed), _seeds(runs, seed + 1)
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            data, offsets, _ = utf8(batch.column(1))
            for i, j, values, bounds in gram_sets(data, offsets, n):
                filled = np.flatnonzero(np.diff(bounds) > 0)
                bare = np.flatnonzero(np.diff(bounds) == 0)
                if len(bare):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(bare + i)), *(pa.nulls(len(bare), t) for t in (pa.int64(), pa.binary(), pa.list_(pa.int64())))], NAMES)
                if not len(filled):
                    continue
                at = bounds[filled]
                least = np.stack([np.minimum.reduceat(values * f, at) for f in factors], axis=1)
                hashes = set_hashes(values, np.append(at, bounds[-1]))
                least = mix(least + factors)
                sketch = (least >> U(56)).astype(np.uint8)  # a byte of each token: 1 in 256 agree by chance, which only lets more through
                chosen = np.concatenate([mix(least ^ s) for s in starts], axis=1)
                hit = mix(chosen + U(_GOLD)) < limit
                ends = np.concatenate([[0], np.cumsum(hit.sum(axis=1))])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(filled + i)), pa.array(hashes.view(np.int64)), pa.array([s.tobytes() for s in sketch], pa.binary()), int64_list(chosen[hit].view(np.int64), ends)], NAMES)

    return map_arrow(only(df, doc_id=key, text=text).select(F.col("doc_id").cast("long"), "text").where("doc_id is not null"), run, SKETCHES)


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by their first columns, cut anew so that no group is divided; with the groups' bounds."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(c)[-1].equals(batch.column(c)[-1]) for c in range(columns)):
            held.append(batch)
            continue
        new = _changes(batch, columns)
        cut = int(new[-1]) if len(new) else 0
        table = pa.Table.from_batches([*held, batch.slice(0, cut)])
        if table.num_rows:
            yield table, _bounds(table, columns)
        held = [batch.slice(cut)]
    if held:
        table = pa.Table.from_batches(held)
        yield table, _bounds(table, columns)


def _changes(rows, columns: int) -> np.ndarray:
    if rows.num_rows < 2:
        return np.zeros(0, np.int64)
    keys = [rows.column(c).to_numpy() if isinstance(rows, pa.Table) else rows.column(c).to_numpy(zero_copy_only=False) for c in range(columns)]
    return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1


def _bounds(table: pa.Table, columns: int) -> np.ndarray:
    return np.concatenate([[0], _changes(table, columns), [table.num_rows]]).astype(np.int64)


def drop_lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (path, doc) sorted by path: those whose path has two documents at least."""
    for table, bounds in whole_groups(batches, 1):
        keep = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        yield from table.filter(pa.array(keep)).combine_chunks().to_batches()


def near_rows(sketch: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, which of all before b agree in `least` tokens with each of a..b): all pairs compared, a few rows at a time."""
    m = len(sketch)
    columns = np.ascontiguousarray(sketch.T)
    step = max(1, min(m, (1 << 22) // m))
    for a in range(0, m, step):
        b = min(m, a + step)
        same = np.zeros((b - a, b), np.uint8)
        for col in columns:
            same += col[a:b, None] == col[None, :b]
        yield a, b, np.tril(same >= least, a - 1)


def brute_links(rows: np.ndarray, sketch: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spanning links of the rows whose sketches are near."""
    label = np.arange(len(rows))
    for a, b, near in near_rows(sketch[rows], least):
        for i in np.flatnonzero(near.any(axis=1)) + a:
            roots = np.unique(label[:i][near[i - a, :i]])
            label[i] = roots[0]
            for other in roots[1:]:
                label[label == other] = roots[0]
    apart = np.flatnonzero(label != np.arange(len(rows)))
    return list(zip(rows[label[apart]].tolist(), rows[apart].tolist()))


def brute_sides(rows: np.ndarray, sketch: np.ndarray, least: int, block: np.ndarray) -> list[tuple[int, int]]:
    """(row, block) for each block in which a row has a near one."""
    blocks_, own = np.unique(block[rows], return_inverse=True)
    there = np.zeros((len(rows), len(blocks_)), np.float32)
    there[np.arange(len(rows)), own] = 1
    met = np.zeros(there.shape, bool)
    for a, b, near in near_rows(sketch[rows], least):
        near = near.astype(np.float32)
        met[a:b] |= near @ there[:b] > 0
        met[:b] |= near.T @ there[a:b] > 0
    r, c = np.nonzero(met)
    return list(zip(rows[r].tolist(), blocks_[c].tolist()))


def leaves(path: int, rows: np.ndarray, sketch: np.ndarray, threshold: float, small: int, depth: int, max_depth: int) -> Iterator[np.ndarray]:
    """The rows of a bucket if it is small or at the last depth, otherwise those of its children that brute force is for."""
    if len(rows) <= small or depth >= max_depth:
        yield rows
        return
    children, at = split(np.full(len(rows), path, np.int64), sketch[rows], threshold)
    order = np.argsort(children, kind="stable")
    children, at = children[order], at[order]
    edges = np.concatenate([[0], np.flatnonzero(children[1:] != children[:-1]) + 1, [len(children)]])
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:
            yield from leaves(int(children[a]), rows[at[a:b]], sketch, threshold, small, depth + 1, max_depth)


def split(paths: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One split on sampled tokens: children's paths, and for each its row."""
    t = sketch.shape[1]
    limit = U(int(2**64 / (threshold * t)) if threshold * t > 1 else 2**64 - 1)
    rows, out = [], []
    for a in range(0, len(paths), 4096):
        tokens = mix(sketch[a : a + 4096].astype(U) + (np.arange(1, t + 1, dtype=U) << U(40)))
        child = mix(tokens ^ mix(paths[a : a + 4096].view(U))[:, None])
        r, c = np.nonzero(mix(child + U(_GOLD)) < limit)
        rows.append(r + a)
        out.append(child[r, c].view(np.int64))
    return np.concatenate(out), np.concatenate(rows)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): alternating large and small stars, on disk between rounds.

    Roots are their component's least node.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        before = e
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        e = materialize(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        discard(before)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share."""
    k = len(sets)
    if k <= 4:
        shared = np.zeros((k, k), np.int64)
        for x in range(k):
            for y in range(x):
                shared[x, y] = shared[y, x] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return shared
    shared = np.zeros((k, k), np.int64)
    # Sets are sorted: a range of hashes at a time, so that what is held at once has a bound, however long the texts.
    ranges = max(1, sum(map(len, sets)) >> 19)
    marks = np.array([i * 2**64 // ranges for i in range(1, ranges)], U)
    cuts = [np.concatenate([[0], np.searchsorted(s, marks), [len(s)]]) for s in sets]
    for r in range(ranges):
        shared += _shared([s[c[r] : c[r + 1]] for s, c in zip(sets, cuts)])
    return shared


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    k = len(sets)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.full(len(values), -1)
    rank[counts > 1] = np.arange((counts > 1).sum())
    column, row = rank[inverse], np.repeat(np.arange(k), [len(s) for s in sets])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((k, k), np.int64)
    width = max(256, (1 << 22) // k)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        part = np.zeros((k, width), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        shared += np.rint(part @ part.T).astype(np.int64)  # under 2^22 each, so exact
    return shared


def near_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two different sets have at least the threshold as their Jaccard."""
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = shared_counts(sets)
    near = shared / (sizes[:, None] + sizes[None, :] - shared) >= threshold
    np.fill_diagonal(near, False)
    return near


def spanning(near: np.ndarray) -> np.ndarray:
    """For each node another one that it is near, so that all of them connect what near does; -1 for the first of each component and lone ones."""
    up = np.full(len(near), -1)
    left = near.any(axis=1)
    while left.any():
        front = np.array([np.flatnonzero(left)[0]])
        left[front] = False
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & left)
            up[reached] = front[near[np.ix_(front, reached)].argmax(axis=0)]
            left[reached] = False
            front = reached
    return up


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Bounds and values of a list column in one piece."""
    flat = column.chunk(0)
    return flat.offsets.to_numpy(), flat.values


AT_ONCE = 1 << 16
FILTER_BITS = 1 << 25


def only_ids(df: DataFrame, ids: DataFrame, key: str = "rep") -> DataFrame:
    """The rows of df (key, text) whose key may be in ids, so that a join need not move all the others.

    A bitmap of FILTER_BITS at most (4 MB), whatever the number of ids: with very many it lets more
    through, never less, and the join that follows is what decides.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    parts = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        piece = np.frombuffer(bytes(r.bits), np.uint8)
        start = (r.part - 1) * len(piece)
        bitmap[start : start + len(piece)] = piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False) - 1
            keep = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            yield batch.select([0, 1]).filter(pa.array(keep.astype(bool)))

    return map_arrow(df.where(F.col(key).isNotNull()).select(key, "text", at.alias("at")), run, f"{key} long, text string")


NODE = "struct<rep:long,set_hash:long>"


def node(rep: pa.Array, set_hash: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([rep, set_hash], ["rep", "set_hash"])


def bytes_of(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1)


class Join:
    """Chosen-path join of a table's texts; see above. Results of the stages are tables in the shared folder.

    A node is (rep, set_hash): a set with the least doc_id that has it.
    """

    def __init__(self, df: DataFrame, n: int = 2, threshold: float = 0.6, recall: float = 0.95, tokens: int = 64, small: int = 200, max_depth: int = 3, local: int = 20_000, slack: float = 0.15, block: int = 256, seed: int = 11, text: str = "text", key: str = "doc_id"):
        if not 0 < threshold <= 1 or n < 1:
            raise ValueError("threshold must be in (0, 1] and n at least 1")
        self.df, self.n, self.threshold, self.tokens, self.small, self.max_depth, self.local, self.block, self.text, self.key = df, n, threshold, tokens, small, max_depth, local, block, text, key
        self.least = max(1, int(np.ceil((threshold - slack) * tokens)))
        self.runs = runs_for(recall, threshold, tokens, max_depth, screened(threshold, tokens, self.least))
        self.sketches = materialize(sketches(df, n, threshold, tokens, self.runs, seed, text, key))
        self.documents = materialize(self.sketches.select("doc_id", "set_hash").distinct())
        by_set = self.sketches.where("set_hash is not null").groupBy("set_hash").agg(F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
        self.reps = materialize(by_set.join(self.documents.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")), "set_hash"))
        discard(self.sketches)
        self._buckets = self._marks = None

    def buckets(self) -> DataFrame:
        """(path, rep, set_hash, sketch, depth) of every bucket with two sets or more.

        One of more than `local` sets is split on, and at the last depth cut into blocks, a bucket for each two of them.
        """
        if self._buckets is not None:
            return self._buckets
        names = ["path", "rep", "set_hash", "sketch", "depth"]
        first = self.reps.select(F.explode("paths").alias("path"), "rep", "set_hash")
        paths = first.repartition("path").sortWithinPartitions("path").mapInArrow(releasing(drop_lone), first.schema)
        held = materialize(paths.join(self.reps.select("set_hash", "sketch"), "set_hash").select("path", "rep", "set_hash", "sketch", F.lit(1).alias("depth")))
        done, threshold = [], self.threshold

        def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    child, row = split(batch.column(0).to_numpy(), bytes_of(batch.column(3), batch.num_rows), threshold)
                    took = pa.array(row)
                    depth = pa.array(batch.column(4).to_numpy()[row] + 1, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(child), *(batch.column(c).take(took) for c in (1, 2, 3)), depth], names)

        for depth in range(1, self.max_depth + 1):
            large = held.groupBy("path").count().where(F.col("count") > self.local)
            if large.isEmpty():
                break
            large = materialize(large)
            done.append(held.join(large, "path", "left_anti").select(names))
            on = held.join(large, "path")
            if depth < self.max_depth:
                held = materialize(on.select(names).mapInArrow(releasing(children), held.schema))
                continue
            # Blocks of half of `local`, so that two of them are as large as any other bucket.
            own = on.withColumn("parts", F.ceil(F.col("count") * F.lit(2) / F.lit(self.local)).cast("int")).withColumn("own", F.pmod(F.xxhash64("set_hash"), F.col("parts")).cast("int"))
            both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            held = both.withColumn("path", F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))).select(names)
        out = held
        for d in done:
            out = out.unionByName(d)
        self._buckets = out
        return out

    def links(self) -> DataFrame:
        """(a, b): spanning links of the nodes whose sketches are near enough and that met in a bucket."""
        threshold, least, small, max_depth = self.threshold, self.least, self.small, self.max_depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, bounds in whole_groups(batches, 1):
                path, depth = table.column(0).to_numpy(), table.column(4).to_numpy()
                sketch = bytes_of(table.column(3), len(path))
                sizes = np.diff(bounds)
                two = bounds[:-1][sizes == 2]
                near = (sketch[two] == sketch[two + 1]).sum(axis=1) >= least
                found = list(zip(two[near].tolist(), (two[near] + 1).tolist()))
                for a, m in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
                    for rows in leaves(int(path[a]), np.arange(a, a + m), sketch, threshold, small, int(depth[a]), max_depth):
                        found += brute_links(rows, sketch, least)
                if found:
                    x, y = np.array(found, np.int64).T
                    rep, hashes = table.column(1).combine_chunks(), table.column(2).combine_chunks()
                    yield pa.RecordBatch.from_arrays([node(rep.take(pa.array(k)), hashes.take(pa.array(k))) for k in (x, y)], ["a", "b"])

        return self.buckets().repartition("path").sortWithinPartitions("path").mapInArrow(releasing(run), f"a {NODE}, b {NODE}").where("a <> b")

    def sides(self, large: DataFrame) -> DataFrame:
        """(root, p, q, rep, set_hash): where the nodes of large components (rep, set_hash, root, own) have near ones, by pair of blocks."""
        threshold, least, small, max_depth = self.threshold, self.least, self.small, self.max_depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, bounds in whole_groups(batches, 2):
                path, depth, own = (table.column(c).to_numpy() for c in (0, 5, 6))
                sketch = bytes_of(table.column(4), len(path))
                found: list[tuple[int, int]] = []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    if b - a > 1:
                        for rows in leaves(int(path[a]), np.arange(a, b), sketch, threshold, small, int(depth[a]), max_depth):
                            found += brute_sides(rows, sketch, least, own)
                if found:
                    r, other = np.unique(np.array(found, np.int64), axis=0).T
                    took = pa.array(r)
                    columns = [table.column(1), np.minimum(own[r], other), np.maximum(own[r], other), table.column(2), table.column(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) if isinstance(c, np.ndarray) else c.combine_chunks().take(took) for c in columns], ["root", "p", "q", "rep", "set_hash"])

        met = self.buckets().join(large.select("rep", "set_hash", F.xxhash64("root").alias("root"), "own"), ["rep", "set_hash"]).select("path", "root", "rep", "set_hash", "sketch", "depth", "own")
        return met.repartition("path", "root").sortWithinPartitions("path", "root").mapInArrow(releasing(run), "root long, p int, q int, rep long, set_hash long").distinct()

    def compared(self) -> DataFrame:
        """(node, links, other), a row or more for each node with exact partners: the documents that they stand for in one task, and one of them that connects it, or null."""
        if self._marks is not None:
            return self._marks
        n, threshold = self.n, self.threshold
        parts = materialize(connected(self.links()))
        sizes = parts.groupBy("root").agg(F.ceil(F.count("*") / F.lit(self.block)).cast("int").alias("blocks"))
        nodes = parts.join(sizes, "root").select("node.rep", "node.set_hash", "root", "blocks", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("own"))
        nodes = materialize(nodes.join(self.reps.select("set_hash", "weight"), "set_hash"))
        discard(parts)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets, _ = utf8(batch.column(6))
                wanted = batch.column(1).to_numpy()
                for i, j, values, bounds in gram_sets(data, offsets, n):
                    size = np.diff(bounds)
                    filled = np.flatnonzero(size > 0)
                    if not len(filled):
                        continue
                    hashes = set_hashes(values, np.append(bounds[filled], bounds[-1]))
                    own = filled[hashes.view(np.int64) == wanted[i + filled]]  # another version of the document may have come along
                    if len(own):
                        grams = np.concatenate([values[bounds[r] : bounds[r + 1]] for r in own])
                        took = pa.array(i + own)
                        yield pa.RecordBatch.from_arrays([batch.column(c).take(took) for c in range(6)] + [int64_list(grams.view(np.int64), np.concatenate([[0], np.cumsum(size[own])]))], ["rep", "set_hash", "root", "blocks", "own", "weight", "grams"])

        texts = only_ids(only(self.df, rep=self.key, text=self.text).select(F.col("rep").cast("long"), "text"), nodes)
        found = nodes.join(texts, "rep").select("rep", "set_hash", F.xxhash64("root").alias("root"), "blocks", "own", "weight", "text")
        grams = map_arrow(found, read, "rep long, set_hash long, root long, blocks int, own int, weight long, grams array<long>")
        large = nodes.where("blocks > 1")
        large = None if large.isEmpty() else large
        grams = materialize(grams) if large else grams
        columns = ["root", "p", "q", "own", "rep", "set_hash", "weight", "grams"]
        tasks = grams.where("blocks = 1").withColumns({"p": F.lit(0), "q": F.lit(0)}).select(columns)
        if large:
            tasks = tasks.unionByName(grams.where("blocks > 1").drop("root").join(self.sides(large), ["rep", "set_hash"]).select(columns))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, bounds in whole_groups(batches, 3):
                table = table.combine_chunks()
                p, q, side, rep, hashes, weight = (table.column(c).to_numpy() for c in range(1, 7))
                edges, values = lists(table.column(7))
                values = values.to_numpy().view(U)
                at, links, up = [], [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    own = a + np.sort(np.unique(hashes[a:b], return_index=True)[1])  # without repeated rows
                    if len(own) < 2:
                        continue
                    near = near_sets([values[edges[r] : edges[r + 1]] for r in own], threshold)
                    if p[a] != q[a]:
                        near &= side[own][:, None] != side[own][None, :]
                    k = np.flatnonzero(near.any(axis=1))
                    if len(k):
                        at.append(own[k])
                        links.append(near[k] @ weight[own])
                        tree = spanning(near)[k]
                        up.append(np.where(tree >= 0, own[tree], -1))
                if at:
                    at, links, up = (np.concatenate(x) for x in (at, links, up))
                    took, other = pa.array(at), pa.array(np.maximum(up, 0), mask=up < 0)
                    rep_, hash_ = table.column(4).chunk(0), table.column(5).chunk(0)
                    yield pa.RecordBatch.from_arrays([rep_.take(took), hash_.take(took), pa.array(links, pa.int64()), rep_.take(other), hash_.take(other)], ["rep", "set_hash", "links", "rep_b", "set_hash_b"])

        got = tasks.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(releasing(compare), "rep long, set_hash long, links long, rep_b long, set_hash_b long")
        other = F.when(F.col("rep_b").isNotNull(), F.struct(F.col("rep_b").alias("rep"), F.col("set_hash_b").alias("set_hash")))
        self._marks = materialize(got.select(F.struct("rep", "set_hash").alias("node"), "links", other.alias("other")))
        return self._marks

    def classes(self) -> DataFrame:
        """(doc_id, set_hash, class_id, links), a row for each document (for each of its versions).

        class_id: the least doc_id of those that links connect, links going on from one to the next. links: how
        many other documents (or versions) have a Jaccard at or over the threshold, copies among them.
        """
        marks = self.compared()
        roots = connected(marks.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        linked = marks.groupBy("node").agg(F.sum("links").alias("linked")).join(roots, "node", "left")
        linked = linked.select("node.set_hash", "linked", F.col("root.rep").alias("class_id"))
        sets = self.reps.select("set_hash", "rep", "weight").join(linked, "set_hash", "left")
        sets = sets.select("set_hash", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("links"))
        return self.documents.join(sets, "set_hash", "left").select("doc_id", "set_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))

    def summary(self) -> DataFrame:
        """(doc_id, class_id, links); see classes()."""
        return self.classes().drop("set_hash")

    def groups(self) -> DataFrame:
        """(doc_id, near): of each document with near copies the least doc_id of its class; of versions the least of theirs."""
        return self.classes().where("links > 0").groupBy("doc_id").agg(F.min("class_id").alias("near"))


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", **params) -> DataFrame:
    """The rows of df, all columns as they are, without those whose class has a document with a smaller doc_id.

    Rows without doc_id or without words stay, as do repeated rows of the document that stays and an empty table. Of a
    document's versions each goes with its own class, so every class keeps a version. Extra columns may bear any name.
    """
    join = Join(df, text=text, key=key, **params)
    gone = join.classes().where("class_id <> doc_id").select("doc_id", "set_hash")
    rows = Numbered(df)
    at = rows.place(text)
    n = join.n

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = utf8(batch.column(0).field(at))
            hashes, none = np.zeros(batch.num_rows, U), np.ones(batch.num_rows, bool)
            for i, j, values, bounds in gram_sets(data, offsets, n):
                filled = np.flatnonzero(np.diff(bounds) > 0)
                if len(filled):
                    hashes[i + filled], none[i + filled] = set_hashes(values, np.append(bounds[filled], bounds[-1])), False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes.view(np.int64), mask=none)], ["row", "doc_id", "set_hash"])

    packed = rows.df.select(rows.row().alias("row"), rows[key].cast("long").alias("doc_id"))
    several = materialize(gone)
    twice = join.documents.groupBy("doc_id").count().where("count > 1").limit(1)
    if twice.isEmpty():
        kept = packed.join(several.select("doc_id"), "doc_id", "left_anti")
    else:
        kept = map_arrow(packed, tagged, packed.withColumn("set_hash", F.lit(None).cast("long")).schema).join(several, ["doc_id", "set_hash"], "left_anti")
    return rows.restored(kept)
