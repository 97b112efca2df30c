"""Chat logs: collapse cumulative snapshots, then render what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def _numbered(turns: DataFrame, block: int) -> DataFrame:
    """Adds pos (1, 2, ... within a conversation) and the sums of hash parts up to there.

    A conversation is cut into blocks of ``block`` turn numbers; places and sums are taken
    within a block, and the blocks' totals, which are few, give each block its offset.
    """
    cut = turns.withColumn("part", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv", "part").orderBy("turn", "role", "text")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    totals = cut.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("n_turns", F.sum("n").over(Window.partitionBy("conv")))
    placed = cut.withColumn("rank", F.row_number().over(inside)).join(totals.drop("n").withColumnRenamed("part", "p2").withColumnRenamed("conv", "c2"), F.col("conv").eqNullSafe(F.col("c2")) & F.col("part").eqNullSafe(F.col("p2"))).drop("c2", "p2")
    placed = placed.withColumn("pos", F.col("rank") + F.col("skip")).drop("rank", "skip")

    content = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    one, two = F.xxhash64(*content), F.xxhash64(F.lit(17), *content)
    low = F.lit(0xFFFFFFFF)
    halves = {"h0": one.bitwiseAND(low), "h1": F.shiftrightunsigned(one, 32), "h2": two.bitwiseAND(low), "h3": F.shiftrightunsigned(two, 32)}
    hashed = placed.withColumns(halves)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy("conv", "part").agg(*[F.sum(h).alias(h) for h in halves])
    offsets = sums.select(F.col("conv").alias("c2"), F.col("part").alias("p2"), *[F.coalesce(F.sum(h).over(earlier), F.lit(0)).alias(f"o_{h}") for h in halves])
    rolled = hashed.withColumns({h: F.sum(h).over(running) for h in halves})
    return rolled.join(offsets, F.col("conv").eqNullSafe(F.col("c2")) & F.col("part").eqNullSafe(F.col("p2"))).select(
        "conv", "part", "turn", "role", "text", "pos", "n_turns", *[(F.col(h) + F.col(f"o_{h}")).alias(h) for h in halves])


def segment(role: Column, text: Column) -> Column:
    """One turn in its markers; markers inside a turn's own text are broken up."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_(start|end)\|>", "<| im_$1 |>")
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), inner, F.lit("<|im_end|>\n"))


def maximal_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The numbered turns of every conversation that is not the beginning of a longer one.

    Each turn carries 128 bits that roll up all turns to there, keyed by place, role and
    text.  A conversation whose last roll-up is a roll-up inside a longer conversation is a
    snapshot of it and goes (anti-join); of conversations equal in full the smallest id stays.

    Takes (conv, turn, role, text).  Rows equal in all four count once.  Turns with the same
    number stand in order of role and text, in one window, so a conversation whose turns all lack a number or share one
    is sorted by a single task; a null turn number comes first; null role and
    null text are values of their own.  An empty table gives an empty result.
    """
    rows = _numbered(turns.dropDuplicates(["conv", "turn", "role", "text"]), block)
    sums = ["h0", "h1", "h2", "h3"]
    ends = rows.filter("pos = n_turns").groupBy("n_turns", *sums).agg(F.min("conv").alias("conv"))
    inner = rows.filter("pos < n_turns").select(F.col("pos").alias("n_turns"), *sums).distinct()
    whole = ends.join(inner, ["n_turns", *sums], "left_anti").select(F.col("conv").alias("c2"))
    return rows.join(whole, F.col("conv").eqNullSafe(F.col("c2")), "left_semi")


def render(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, part, n_turns, text): the conversation as text, ``block`` turns to a row.

    Almost every conversation is one row, part 0; one with very many turns is several, whose
    texts joined in order of part are the whole, so no row grows without bound.
    """
    cut = rows.select("conv", F.floor((F.col("pos") - 1) / block).cast("int").alias("part"), "pos", segment(F.col("role"), F.col("text")).alias("s"))
    grouped = cut.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("all"))
    return grouped.select("conv", "part", F.size("all").cast("long").alias("n_turns"), F.array_join(F.transform("all", lambda x: x["s"]), "").alias("text"))


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Maximal conversations, rendered; other columns of the table are left out."""
    turns = conversations.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    return render(maximal_conversations(turns, block), block)
