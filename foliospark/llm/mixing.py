"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a hash of seed and doc_id; a document's
virtual finish time is the tokens of its source up to and with it, divided by the
source's target weight. The output is all documents by finish time, up to the total
budget of tokens. Up to the time at which some source runs dry, each source's share is
its weight's; from then on the others share what is left.

No source is summed or sorted in one task: its shuffle order is cut into 4,096 slices by
the first bits of the hash, and a slice starts where the sums of those before it end. The
budget's place is found by narrowing down finish times over aggregates.

Null source: a source of its own. Null or empty text: 0 tokens, so its row comes when its
turn does. Ties of finish time and hash: by doc_id (null last), then by a hash of all
columns. Repeated rows are documents of their own. Extra columns stay as they are, whatever
their names. Texts are counted whole, however long. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.runtime import Numbered, materialize, word_count

BINS = 4096
FEW = 100_000


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    if default <= 0 or any(w <= 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    out = F.lit(float(default))
    for name, w in sorted(weights.items()):
        out = F.when(source == F.lit(name), F.lit(float(w))).otherwise(out)
    return out


def _queue(source: Column) -> Column:
    """A source's name that is never null, so that the join and the window below share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


class Mixture:
    def __init__(self, df: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, budget_share: float = 0.8, budget_tokens: int | None = None, seed: str = "mix-1", text: str = "text", source: str = "source", key: str = "doc_id"):
        self.numbered = c = Numbered(df)
        draw = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(c[key].cast("string"), F.lit(""))).cast("binary"))
        self.weights, self.default = weights or {}, default
        self.base = c.df.select(
            c.row().alias("row"), c[key].cast("long").alias("key"), c[source].alias("source"), _queue(c[source]).alias("queue"), word_count(c[text]).alias("tokens"),
            draw.alias("draw"), F.xxhash64(*c.df.columns).alias("tie"), F.conv(F.substring(draw, 1, 3), 16, 10).cast("int").alias("slice"),
        )
        self.light = materialize(self.base.drop("row"))
        by_slice = self.light.groupBy("queue", "slice").agg(F.sum("tokens").alias("n"))
        before = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        self.offsets = materialize(by_slice.select("queue", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
        self.total = self.light.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        self.budget = budget_tokens if budget_tokens is not None else int(self.total * budget_share)

    def timed(self, rows: DataFrame) -> DataFrame:
        """Rows with their virtual finish time: one exchange, by queue and slice, for join and window."""
        within = Window.partitionBy("queue", "slice").orderBy("draw", F.col("key").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, 0)
        met = rows.join(self.offsets, ["queue", "slice"])
        return met.withColumn("finish", (F.col("before") + F.sum("tokens").over(within)) / _weight(F.col("source"), self.weights, self.default)).drop("before")

    @staticmethod
    def order() -> list[Column]:
        return [F.col("finish"), F.col("draw"), F.col("key").asc_nulls_last(), F.col("tie")]

    def last(self, timed: DataFrame) -> tuple | None:
        """(finish, draw, key, tie) of the last row within the budget; None if not even the first fits."""
        if self.total <= self.budget:
            return (float("inf"), "", None, 0)
        low, high, spent = timed.agg(F.min("finish"), F.max("finish")).first() + (0,)
        while True:
            inside = timed.where(F.col("finish").between(low, high))
            width = (high - low) / BINS
            bin_ = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0).cast("long")
            bins = sorted(inside.groupBy(bin_.alias("bin")).agg(F.sum("tokens"), F.count("*"), F.min("finish"), F.max("finish")).toLocalIterator())
            for _, tokens, rows, first, final in bins:
                if spent + tokens > self.budget:
                    break
                spent += tokens
            else:
                raise AssertionError("the budget is under the total")
            if rows <= FEW or first == final:
                break
            low, high = first, final
        run = Window.orderBy(*self.order()).rowsBetween(Window.unboundedPreceding, 0)
        near = timed.where(F.col("finish").between(first, final)).select("finish", "draw", "key", "tie", "tokens").withColumn("run", F.sum("tokens").over(run) + spent)
        # One bin of few rows, or of one finish time alone, is put in order by itself.
        found = near.where(F.col("run") <= self.budget).orderBy(F.col("run").desc(), F.col("finish").desc(), F.col("draw").desc(), F.col("key").desc_nulls_first(), F.col("tie").desc()).first()
        if found:
            return tuple(found[:4])
        earlier = timed.where(F.col("finish") < first).orderBy(F.col("finish").desc(), F.col("draw").desc(), F.col("key").desc_nulls_first(), F.col("tie").desc()).first()
        return (earlier["finish"], earlier["draw"], earlier["key"], earlier["tie"]) if earlier else None

    def within(self, timed: DataFrame) -> DataFrame:
        end = self.last(self.timed(self.light))
        if end is None:
            return timed.where(F.lit(False))
        finish, draw, key, tie = end
        if finish == float("inf"):
            return timed
        rank = lambda d, k, t: F.struct(d, k.isNull(), F.coalesce(k, F.lit(0)), t)
        at = rank(F.lit(draw), F.lit(key).cast("long"), F.lit(tie).cast("long"))
        return timed.where((F.col("finish") < F.lit(finish)) | ((F.col("finish") == F.lit(finish)) & (rank(F.col("draw"), F.col("key"), F.col("tie")) <= at)))

    def schedule(self) -> DataFrame:
        """(doc_id, source, tokens, finish) within the budget, sorted over all partitions."""
        return self.within(self.timed(self.light)).orderBy(*self.order()).select(F.col("key").alias("doc_id"), "source", "tokens", "finish")

    def rows(self) -> DataFrame:
        """The rows of the input within the budget, sorted over all partitions, all columns as they are."""
        return self.numbered.restored(self.within(self.timed(self.base)).orderBy(*self.order()).select("row"))
