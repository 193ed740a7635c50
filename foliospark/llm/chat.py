"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation again and again, a few turns longer each time. The
rolling hash of a conversation's first k turns is the exclusive or of two 64-bit hashes of
each turn with its position, so one running window gives all of them. A conversation
whose whole hash is a prefix hash of a longer one, or the whole of an equal one with a
smaller conv_id, is removed by an anti-join; what is left is rendered.

Turns are in order of turn (null first), then role, then text; repeated turns count as
often as they occur. Null role: "unknown"; null text: an empty turn. Rows with null
conv_id are left out. Marks of the format inside a text are defused with a space, so a
text can't open or close a turn. Extra columns make no difference, and their names may clash. Texts are hashed and
rendered whole, however long. Two turns are equal if both of their 64-bit hashes are: contents aren't
compared again. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.runtime import only

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def chat_format(df: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations."""
    turns = only(df, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.select("*", F.row_number().over(order).alias("pos"))
    rolling = Window.partitionBy("conv_id").orderBy("pos")
    for name, salt in (("h1", 1), ("h2", 2)):
        placed = placed.withColumn(name, F.expr(f"bit_xor(xxhash64({salt}, pos, role, text))").over(rolling.rowsBetween(Window.unboundedPreceding, 0)))
    safe = lambda c: F.replace(c, F.lit("<|im_"), F.lit("<| im_"))
    line = F.concat(F.lit(OPEN), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(CLOSE + "\n"))
    whole = placed.groupBy("conv_id").agg(
        F.max("pos").alias("n_turns"), F.max_by("h1", "pos").alias("h1"), F.max_by("h2", "pos").alias("h2"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "").alias("rendered")
    )
    lengths = Window.partitionBy("conv_id")
    prefixes = placed.select("conv_id", F.col("pos").alias("k"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.max("pos").over(lengths).alias("n"))
    # One row for each prefix, however many conversations begin with it.
    longest = prefixes.groupBy("k", "p1", "p2").agg(F.max("n").alias("most"), F.min(F.when(F.col("n") == F.col("k"), F.col("conv_id"))).alias("first"))
    covered = (F.col("n_turns") == F.col("k")) & (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2")) & ((F.col("most") > F.col("k")) | (F.col("first") < F.col("conv_id")))
    return whole.join(longest, covered, "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "rendered")
