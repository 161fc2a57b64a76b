"""Mixing sources to target weights by the cube method.

A source's target spreads evenly over its documents: each is expected target / size-of-source times. The whole part of
that is taken at once; the fraction is an inclusion probability, and the cube method turns the probabilities of a
source into 0 or 1 while it keeps two totals: the number of documents and the number of words taken.

Flight: among three undecided documents there is a direction in which the probabilities can move without changing
either total; they move until one of them is 0 or 1. Documents are dealt into blocks by hash, blocks fly on their own,
and what is left of them (at most two documents a block) flies on in the blocks of the next level, until one block a
source is left; sources of few blocks hold documents of each back from the flight, ``LANDING`` in all, so that the last
block has enough of them. Landing: the last ``LANDING`` documents of a source's last block and what its flight left take,
of all 0/1 choices, the one that misses the word total least.

Only (source, id, size, hash) rows move. Hashes and seeds come from the rows, so a rerun or a lost task gives the same.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, table
from tidemill.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 4096
LANDING = 12


def sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``: the words of the text, 0 for null."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn and share all words by weight. None gets more than
    ``most`` times its size: in the order of size over weight, sources are full as long as the share by weight of what
    is left would overfill them; the others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)

    def left(name: str, times: int):
        return F.sum(name).over(every) - times * F.coalesce(F.sum(name).over(before), F.lit(0))

    shares = by_source.withColumn("weight", weight).withColumn("place", F.row_number().over(fill)) \
        .withColumn("share", left("source_size", most) / left("weight", 1)) \
        .withColumn("full", F.col("share") * F.col("weight") >= most * F.col("source_size"))
    first = F.min(F.when(~F.col("full"), F.struct("place", "share"))).over(every)
    return shares.withColumn("first", first).select(
        "source", "source_size", F.when(F.col("full"), (most * F.col("source_size")).cast("double"))
        .otherwise(F.col("first.share") * F.col("weight")).alias("target"))


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, hold: int = 0) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but for two, and the last ``hold`` that did not take part.

    The sums of ``p`` and of ``size * p`` stay.
    """
    p, size = p.copy(), size.astype(float)
    draws = rng.random(len(p) + 2)
    active: list[int] = []
    flying = np.flatnonzero((p > 0) & (p < 1))
    for turn, unit in enumerate(flying[:max(0, len(flying) - hold)].tolist()):
        active.append(unit)
        if len(active) < 3:
            continue
        x = size[active]
        u = np.array([x[1] - x[2], x[2] - x[0], x[0] - x[1]])
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        now, moves = p[active], u != 0
        up = np.min(np.where(u > 0, (1 - now), now)[moves] / np.abs(u[moves]))
        down = np.min(np.where(u > 0, now, (1 - now))[moves] / np.abs(u[moves]))
        now = now + u * (up if draws[turn] * (up + down) < down else -down)
        now[np.abs(now) < 1e-9] = 0.0
        now[np.abs(now - 1) < 1e-9] = 1.0
        p[active] = now
        active = [a for a, v in zip(active, now.tolist(), strict=True) if 0 < v < 1]
    return p


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The undecided (at most ``LANDING`` + 2) take 0 or 1 so that the word total, and then their number, change least."""
    p, open_ = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words = np.abs(choices @ size[open_].astype(float) - size[open_] @ p[open_])
        number = np.abs(choices.sum(axis=1) - p[open_].sum())
        p[open_] = choices[np.lexsort((number, np.round(words, 6)))[0]]
    return p


def _flight(level: int):
    """A block's rows with their probabilities after the flight, and after the landing if its source has no other block."""

    def run(block: pa.Table) -> pa.Table:
        size, p = block["size"].to_numpy(), block["p"].to_numpy()
        order = np.lexsort((size, block["key"].to_numpy()))
        name = f"{level}|{block['block'][0]}|{block['source'][0]}"
        left = block["left"][0].as_py()
        hold = -(-LANDING // left) if left <= LANDING else 0
        flown = fly(size[order], p[order], np.random.default_rng(zlib.crc32(name.encode())), hold)
        flown = land(size[order], flown) if left == 1 else flown
        after = np.empty_like(flown)
        after[order] = flown
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(after))

    return run


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; maps, which have no hash, by their text."""
    return F.xxhash64(*(F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes))


def mix(docs: DataFrame, id_column: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
        block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``key``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``docs`` needs its id, ``text`` and ``source``. ``key`` is a hash of the whole row. Null texts and texts without words
    have size 0 and take nothing; a null source is a source of its own; null ids and repeated rows are drawn like any
    others; an empty table gives an empty result.
    """
    own = sizes(docs.select(F.col(f"`{id_column}`").alias("id"), "text", F.col("source").cast("string").alias("source"),
                            _row_hash(docs).alias("key"))).drop("text")
    rows = cut_lineage(own, "sizes")
    by_source = cut_lineage(targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = rows.join(by_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s") \
        .withColumn("copies", F.floor(rate).cast("long")).withColumn("p", rate - F.floor(rate))
    counts = rows.groupBy("source").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    blocks = counts.agg(F.max("blocks")).first()[0] or 0
    units = units.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))) \
        .withColumn("block", F.pmod("key", "blocks")).drop("s").withColumnRenamed("blocks", "left")
    schema, done, level = units.schema, None, 0
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    while blocks:
        last = blocks == 1
        flown = units.groupBy("source", "block").applyInArrow(_flight(level), schema)
        flown = cut_lineage(flown, "flight")
        settled = flown if last else flown.filter(~undecided)
        done = settled if done is None else done.unionByName(settled)
        units = flown.filter(undecided).withColumn("block", F.floor(F.col("block") / (block // 2)).cast("long")) \
            .withColumn("left", F.ceil(F.col("left") / (block // 2)).cast("long"))
        blocks, level = 0 if last else -(-blocks // (block // 2)), level + 1
    done = units if done is None else done
    copies = F.col("copies") + F.col("p").cast("long")
    return done.select("id", "key", "source", "size", "source_size", "target", copies.alias("copies"),
                       (F.col("size") * copies).alias("taken"))


def draw(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The mix itself: the documents taken, with ``copies`` and ``taken`` (words, repeats counted).

    Rows that are equal in all columns become one row with the copies of all.
    """
    found = mix(docs, id_column)
    key, row = fresh("row_key", docs.columns), fresh("row", docs.columns)
    copies, taken = fresh("copies", docs.columns), fresh("taken", docs.columns)
    wanted = found.groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies), F.sum("taken").alias(taken)) \
        .filter(F.col(taken) > 0)
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.withColumn(key, _row_hash(docs)).groupBy(key).agg(F.first(F.struct(*own)).alias(row))
    return once.join(wanted, key).select(*(F.col(row)[c].alias(c) for c in docs.columns), copies, taken)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ``size``, its source's ``source_size`` and ``target``, and ``taken``, the words that the mix takes."""
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
