"""Chat formatting: collapse cumulative snapshots, then render.

Chat logs often hold a conversation several times, each time a few turns
longer. A rolling hash over the turns gives every prefix of every conversation
a key; a conversation whose whole is a proper prefix of another one is
dropped by an anti-join, equal conversations stay once, and what is maximal is
rendered with a chat template. DataFrame operations only.

Turns get their positions from running sums that are dealt by range, whatever
their numbers are. The prefix hash is a running sum of hashes of (position,
turn), so it is built in two levels: inside blocks of ``BLOCK`` positions, then
over the blocks' totals. A conversation with a third of all rows is many
blocks, and its rendering is many parts of ``PART`` turns; no task holds it
whole.

Defined results: turns go by turn number, NULL last, ties by the SHA-256 of
role and text; a NULL role or text is empty; a row repeated within a
conversation is one turn; rows with a NULL conv_id are one conversation, which
goes last where ids are compared; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import running_sums
from .common import cut

BLOCK = 256
PART = 64
MASK = 0xFFFFFFFF
SUMS = ("p0", "p1", "p2", "p3")
TEMPLATE = "<|im_start|>%s\n%s<|im_end|>\n"


def _running(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Sums of ``values`` up to and including each row (new name: column)
    within a conversation, in two levels."""
    inside = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"_{k}") for k, c in values.items()])
    totals = totals.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"),
                           *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in values])
    local = rows.withColumns({k: F.sum(c).over(inside) for k, c in values.items()})
    return local.join(totals, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))) \
        .withColumns({k: F.col(k) + F.col(f"_{k}") for k in values}) \
        .drop("_c", "_b", *[f"_{k}" for k in values])


def prefixes(conversations: DataFrame) -> DataFrame:
    """Each turn with its position from 0, the length ``n`` of its
    conversation and the hash (``SUMS``) of the prefix it ends."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat("role", F.lit("\n"), "text"), 256)) \
        .groupBy("conv_id", "turn", "digest").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    placed = running_sums(rows, {"position": F.lit(1)}, ["conv_id"], [F.col("turn").isNull(), "turn", "digest"], inclusive=False)
    placed = cut(placed.withColumn("block", F.floor(F.col("position") / BLOCK)))
    h, g = F.xxhash64("position", "digest"), F.xxhash64("digest", "position", F.lit(1))
    hashed = placed.drop("text", "role").withColumns(
        {"h0": F.shiftright(h, 32), "h1": h.bitwiseAND(MASK), "h2": F.shiftright(g, 32), "h3": g.bitwiseAND(MASK)})
    sums = _running(hashed, {p: f"h{k}" for k, p in enumerate(SUMS)}).select("conv_id", "position", *SUMS)
    length = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("conv_id", "_c")
    keyed = cut(sums.join(length, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c"))
    return placed, keyed


def maximal(keyed: DataFrame) -> DataFrame:
    """(conv_id, n, copies) of the conversations that are no proper prefix of
    another one; of equal ones the smallest conv_id."""
    whole = keyed.where(F.col("position") == F.col("n") - 1).groupBy("n", *SUMS) \
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = keyed.where(F.col("position") < F.col("n") - 1).select((F.col("position") + 1).alias("n"), *SUMS).distinct()
    return whole.join(inner, ["n", *SUMS], "left_anti").select("conv_id", "n", "copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies and the rendered text of every maximal
    conversation, in parts of ``PART`` turns."""
    placed, keyed = prefixes(conversations)
    kept = maximal(keyed).withColumnRenamed("conv_id", "_c")
    turns = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    turn = F.format_string(TEMPLATE, "role", "text")
    return turns.withColumn("part", F.floor(F.col("position") / PART)) \
        .groupBy("conv_id", "part", "n", "copies") \
        .agg(F.sort_array(F.collect_list(F.struct("position", turn.alias("turn")))).alias("turns")) \
        .select("conv_id", "part", F.col("n").alias("n_turns"), "copies",
                F.array_join(F.col("turns.turn"), "").alias("rendered"))
