"""Chat formatting: one rendering of a dialogue for every participant, with that speaker as assistant.

For each conversation and each participant p, turns are rendered in order: p's turns as assistant turns, the other speakers' as turns
of users named after them, and the loss mask marks p's turns. All is DataFrame expressions; no Python runs on executors.

A conversation may hold a third of all rows, so renderings come in parts of PART turns (an ordinary conversation has one). A turn's
place is its rank by (turn, role, text) in its conversation. Ranks come from a range partitioning on that order (of text, its first
HEAD code points) and prefix sums over partitions, so no task holds a large conversation. Partitions are written before they are counted:
bounds are sampled, and planned twice they would differ.

A null role is the participant "unknown"; a null text renders as empty; rows with a null conv_id belong to one conversation (null); null
turns come first; repeated rows are rendered as often as they come. Texts of any length are rendered whole; of equal places, role and text decide.
Other columns are not read, so they may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopeflow.llm.storage import parallelism, written

PART = 64
HEAD = 32
START, END = "<|im_start|>", "<|im_end|>"


def _escaped(c: F.Column) -> F.Column:
    """Texts can't forge a turn: the markers' opening is broken up inside them."""
    return F.replace(F.replace(c, F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))


def ranked(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: every turn with its rank in its conversation."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = parallelism(turns.sparkSession)
    dealt = rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, HEAD)).withColumn("slice", F.spark_partition_id())
    dealt = written(dealt, "turns")
    local = dealt.withColumn("k", F.row_number().over(Window.partitionBy("slice", "conv_id").orderBy("turn", "role", "text")) - 1)
    sizes = dealt.groupBy("slice", "conv_id").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Only conversations that lie in several slices have turns before a slice.
    offsets = sizes.withColumn("before", before).where("before > 0").select(F.col("slice").alias("s"), F.col("conv_id").alias("c"), "before")
    out = local.join(offsets, (F.col("slice") == F.col("s")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("place"), "role", "text")


def rotate_perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """One row per conversation, participant and part: conv_id, participant, part, n_turns, n_masked, rendered, mask.

    ``mask`` lists the code point ranges of ``rendered`` that the loss covers, as start:end (end exclusive), comma-joined: the text and end
    marker of each of the participant's turns.
    """
    rows = ranked(turns)
    people = turns.select(F.col("conv_id").alias("c"), F.coalesce("role", F.lit("unknown")).alias("participant")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("role") == F.col("participant")
    head = F.when(own, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), _escaped(F.col("role")), F.lit("\n")))
    body = F.concat(_escaped(F.col("text")), F.lit(END))
    seen = seen.select("conv_id", "participant", F.floor(F.col("place") / part).cast("long").alias("part"), F.struct("place", own.alias("own"), head.alias("head"), body.alias("body")).alias("t"))
    grouped = seen.groupBy("conv_id", "participant", "part").agg(F.array_sort(F.collect_list("t")).alias("t"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))

    def step(acc: F.Column, t: F.Column) -> F.Column:
        a = acc["at"] + F.length(t["head"])
        b = a + F.length(t["body"])
        spans = F.when(t["own"], F.concat(acc["spans"], F.array(F.concat_ws(":", a.cast("string"), b.cast("string"))))).otherwise(acc["spans"])
        return F.struct((b + 1).alias("at"), spans.alias("spans"))  # turns are parted by a line break

    spans = F.aggregate("t", start, step)["spans"]
    return grouped.select(
        "conv_id",
        "participant",
        "part",
        F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda t: t["own"])).cast("long").alias("n_masked"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"])), "\n").alias("rendered"),
        F.array_join(spans, ",").alias("mask"),
    )
