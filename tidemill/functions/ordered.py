"""Order-dependent computations that stay parallel when one key holds most rows.

Windows here never span a whole key. Rows are dealt by range of (key, order) into slices of about equal numbers of rows,
and windows run inside (key, slice). What a slice must know of those before or after it comes as one more row from a
table of one row per key and slice. So one key with all rows, at one time, still uses all tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.session import cut_lineage

SLICE = "_slice"
#: Distinct values of one key that one window of the percentiles holds.
HELD = 100_000


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys, keeping the left key columns."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in keys])


def sliced(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` with a number per slice of rows that follow one another in ``order``; written, so that the slices stay."""
    return cut_lineage(df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()), "slices")


def with_next(df: DataFrame, keys: list[str], time: str, tie: str, values: dict[str, str]) -> DataFrame:
    """Add, for each ``new name: column``, that column of the key's next row in (time, tie) order."""
    packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    rows = sliced(df, [*keys, time, tie]).withColumns({"_value": packed, "_tail": F.lit(False)})
    heads = rows.groupBy(*keys, SLICE).agg(F.min_by("_value", F.struct(time, tie)).alias("_value"))
    after = heads.withColumn("_value", F.lead("_value").over(W.partitionBy(*keys).orderBy(SLICE))).filter("_value IS NOT NULL")
    both = rows.unionByName(after.withColumn("_tail", F.lit(True)), allowMissingColumns=True)
    following = F.lead("_value").over(W.partitionBy(*keys, SLICE).orderBy("_tail", time, tie))
    found = both.withColumn("_next", following).filter(~F.col("_tail"))
    return found.withColumns({n: F.col("_next")[n] for n in values}).drop(SLICE, "_value", "_tail", "_next")


def prefix_sum(df: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the key's rows up to the current one in ``order``."""
    rows = sliced(df, [*keys, *order]).withColumns({"_value": F.col(value), "_head": F.lit(False)})
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, SLICE).agg(F.sum("_value").alias("_value"))
    heads = sums.withColumn("_value", F.sum("_value").over(before)).filter("_value IS NOT NULL")
    both = rows.unionByName(heads.withColumn("_head", F.lit(True)), allowMissingColumns=True)
    upto = W.partitionBy(*keys, SLICE).orderBy(F.desc("_head"), *order).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.sum("_value").over(upto)).filter(~F.col("_head")).drop(SLICE, "_value", "_head")


def with_running_sum(df: DataFrame, keys: list[str], time: str, tie: str, value: str, name: str) -> DataFrame:
    """Add the key's running sum of ``value`` in (time, tie) order, current row included."""
    return prefix_sum(df, keys, [time, tie], value, name)


def longest_streaks(df: DataFrame, keys: list[str], time: str, tie: str, hit: str) -> DataFrame:
    """Length of each run of consecutive rows with ``hit`` true: (keys, streak_start, streak_end, length)."""
    flagged = df.withColumn("_break", F.when(F.col(hit), 0).otherwise(1))
    islands = with_running_sum(flagged, keys, time, tie, "_break", "_island").filter(F.col(hit))
    return islands.groupBy(*keys, "_island").agg(
        F.min(time).alias("streak_start"), F.max(time).alias("streak_end"), F.count("*").alias("length")
    ).drop("_island")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Exact continuous percentiles per key, one column per ``name: probability``, plus ``n``.

    First a sketch brackets each wanted rank; then only values inside a bracket are kept and counted
    per value, the rest collapse to one count per gap. Groups of up to 2 * accuracy rows are counted
    per value directly. Where a key may have more than ``HELD`` distinct values inside its brackets, they are summed
    slice by slice, so no window grows with a key.
    """
    v = F.col("_v")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(v.isNotNull())
    margin = 2.0 / accuracy
    names, ps = list(probs), list(probs.values())
    wanted = [q for p in ps for q in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", wanted, accuracy).alias("_b"), F.count("*").alias("n"))
    small = F.col("n") <= 2 * accuracy
    bounds = {}
    for i in range(len(ps)):
        bounds[f"_lo{i}"] = F.when(small, F.lit(-math.inf)).otherwise(F.col("_b")[2 * i])
        bounds[f"_hi{i}"] = F.when(small, F.lit(math.inf)).otherwise(F.col("_b")[2 * i + 1])
    # A written table has a known size, so the planner broadcasts a small sketch and leaves the rows where they are.
    sketch = cut_lineage(sketch.select(*keys, "n", *[c.alias(name) for name, c in bounds.items()]), "sketch")
    joined = join_on(rows, sketch, keys) if keys else rows.crossJoin(F.broadcast(sketch))
    lows, highs = [F.col(f"_lo{i}") for i in range(len(ps))], [F.col(f"_hi{i}") for i in range(len(ps))]
    segment = reduce(lambda a, b: a + b, [(v >= lo).cast("int") for lo in lows] + [(v > hi).cast("int") for hi in highs])
    inside = reduce(lambda a, b: a | b, [v.between(lo, hi) for lo, hi in zip(lows, highs)])
    cells = joined.groupBy(*keys, "n", segment.alias("_seg"), F.when(inside, v).alias("_x")).agg(F.count("*").alias("_c"))
    # What a key can have inside its brackets follows from its rows, so this reads the sketch only.
    most = sketch.agg(F.max("n")).first()[0] or 0
    if min(most, max(2 * accuracy, 3 * margin * len(ps) * most)) > HELD:
        ranked = prefix_sum(cells, [*keys, "n"], ["_seg", "_x"], "_c", "_cum")
    else:
        upto = F.sum("_c").over(W.partitionBy(*keys, "n").orderBy("_seg", "_x").rowsBetween(W.unboundedPreceding, 0))
        ranked = cells.withColumn("_cum", upto)
    out = []
    for name, p in zip(names, ps):
        position = F.lit(p) * (F.col("n") - 1)
        for tag, rank in (("l", F.floor(position)), ("h", F.ceil(position))):
            # The first cell that reaches the rank; a collapsed one (no value) would mean a missed bracket.
            found = F.min_by(F.col("_x"), F.when(F.col("_cum") > rank, F.col("_cum")))
            out.append(F.coalesce(found, F.raise_error(F.lit("rank outside its bracket")).cast("double")).alias(f"_{tag}_{name}"))
    picked = ranked.groupBy(*keys, "n").agg(*out)
    return picked.select(*keys, "n", *[
        (F.col(f"_l_{name}") + (F.col(f"_h_{name}") - F.col(f"_l_{name}")) * (F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))))
        .alias(name)
        for name, p in zip(names, ps)
    ])


def exact_sample(df: DataFrame, n: int) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by content hash, without a global sort.

    Whole hash buckets are taken up to the one where the count reaches n; only that bucket is ranked.
    The per-bucket counts are at most 65,536 rows.
    """
    h = F.xxhash64(*df.columns)
    rows = df.withColumns({"_h": h, "_b": F.shiftrightunsigned(h, 48)})
    per_bucket = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    need = per_bucket.select("_b", "_c", (F.lit(n) - before).alias("_need")).filter(F.col("_need") > 0)
    kept = rows.join(need, "_b")
    whole = kept.filter(F.col("_need") >= F.col("_c"))
    # Copies of one row share a hash, so the cut bucket is collapsed to (row, copies) before ranking.
    cut = kept.filter(F.col("_need") < F.col("_c")).groupBy(*df.columns, "_b", "_h", "_need").agg(F.count("*").alias("_n"))
    order = W.partitionBy("_b").orderBy("_h", *df.columns).rowsBetween(W.unboundedPreceding, -1)
    left = F.least(F.col("_n"), F.col("_need") - F.coalesce(F.sum("_n").over(order), F.lit(0)))
    some = cut.withColumn("_left", left).filter(F.col("_left") > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_left"))))
    return whole.select(*df.columns).unionByName(some.select(*df.columns))
