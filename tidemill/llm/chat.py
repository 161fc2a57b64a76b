"""Cumulative-snapshot collapse: conversations that were logged after every turn are kept once, at their longest.

A turn's hash covers its place, role and text; the XOR of the hashes up to a turn identifies the prefix that ends
there (two 64-bit hashes of different seeds). A conversation whose whole hash is a shorter prefix of another one is a
snapshot of it and goes by an anti-join; of equal conversations the smallest id stays. What remains is rendered.
Running XORs are taken within blocks of turns and stitched by the blocks' totals, so a long conversation is not one
task. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import table
from tidemill.session import cut_lineage

TURNS_PER_BLOCK = 256
TURN = ("<|im_start|>", "\n", "<|im_end|>\n")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text")).distinct()


def prefixes(turns: DataFrame, per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """One row per turn: ``conv_id``, its ``place`` from 1 on, ``last``, and the hash ``h``, ``g`` of the prefix it ends.

    Turns are placed by turn number (null first), then role, then text; rows that repeat in all four columns are one
    turn. Null roles and texts count as empty. Rows without a conversation id are one conversation.
    """
    rows = _turns(turns).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / per_block))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"),
        F.sum("n").over(every).alias("all"))
    placed = rows.withColumn("inner", F.row_number().over(inside)).join(counts, same).select(
        "conv_id", "block", (F.col("skip") + F.col("inner")).alias("place"), "all", "role", "text")
    hashed = placed.select("conv_id", "block", "place", "all", F.xxhash64("place", "role", "text").alias("h"),
                           F.xxhash64(F.lit("second"), "text", "role", "place").alias("g"))
    hashed = cut_lineage(hashed, "turns")
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"{x}_before") for x in "hg"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("conv_id", "block", "place", "all", *(F.bit_xor(x).over(so_far).alias(x) for x in "hg")) \
        .join(totals, same).select("conv_id", "place", (F.col("place") == F.col("all")).alias("last"),
                                   *(F.col(x).bitwiseXOR(F.col(f"{x}_before")).alias(x) for x in "hg"))


def maximal(turns: DataFrame, per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """(conv_id, n_turns, n_equal) of the conversations that are no snapshot of a longer one, and first of their equals."""
    found = cut_lineage(prefixes(turns, per_block), "prefixes")
    whole = found.filter("last").groupBy("place", "h", "g").agg(
        F.min(F.struct(F.col("conv_id").isNull(), "conv_id")).alias("best"), F.count("*").alias("n_equal"))
    inner = found.filter("not last").select("place", "h", "g").distinct()
    return whole.join(inner, ["place", "h", "g"], "left_anti").select(
        "best.conv_id", F.col("place").alias("n_turns"), "n_equal")


def render(turns: DataFrame, per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered): the maximal conversations in chat markup, turns in order.

    An empty table gives an empty result; columns other than conv_id, turn, role and text are not read. A rendered
    conversation is one text, so its turns meet in one row; snapshots and copies have gone before that.
    """
    kept = cut_lineage(maximal(turns, per_block), "maximal")
    rows = _turns(turns).join(kept.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    grouped = rows.groupBy("conv_id", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("t"))
    marked = F.transform("t", lambda x: F.concat(F.lit(TURN[0]), x["role"], F.lit(TURN[1]), x["text"], F.lit(TURN[2])))
    return grouped.select("conv_id", "n_turns", "n_equal", F.array_join(marked, "").alias("rendered"))


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per maximal conversation: ``conv_id``, ``n_turns``, ``n_equal`` (conversations of the same turns), ``rendered``."""
    return render(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
