"""Load modes on plain tables: insert-ignore, replace, upsert, content-hash merge, surrogate keys.

Each takes DataFrames and returns the new table content; sources.sinks writes it as a new version.
Deduplication is ``row_number() = 1``, which Spark limits per key before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

META_COLUMNS = ["_SOURCE", "_INGESTED_AT", "_RUN_ID", "_ROW_HASH"]


def pick_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") == 1).drop("_rn")


def full_order(df: DataFrame, first: list[Column] = ()) -> list[Column]:
    """A total order: the given columns, then every column."""
    return [*first, *[F.col(f"`{c}`") for c in df.columns]]


def append(target: DataFrame, delta: DataFrame) -> DataFrame:
    return target.unionByName(delta, allowMissingColumns=True)


def insert_ignore(target: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing keys win; within the batch the first row per key in ``order`` wins."""
    batch = pick_one(delta, keys, order)
    existing = target.join(batch.select(*keys), keys, "left_semi").select(*keys)
    return target.unionByName(batch.join(existing, keys, "left_anti"))


def insert_or_replace(target: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch wins over existing rows; within the batch the first row per key in ``order`` (newest first) wins."""
    return upsert(target, pick_one(delta, keys, order), keys)


def upsert(target: DataFrame, delta: DataFrame, keys: list[str], primary_key: list[str] | None = None,
           order: list[Column] | None = None) -> DataFrame:
    """Delete target rows whose key is in the batch, then insert the batch.

    Without a usable key (none given, or one that the batch lacks) the batch replaces by ``primary_key``; ``order`` then
    lists its newest row first. The keys of a small batch are broadcast by adaptive execution.
    """
    if not keys or any(k not in delta.columns for k in keys):
        if not primary_key or order is None:
            raise ValueError("an upsert needs a key of the batch, or a primary key and the order of its rows")
        return insert_or_replace(target, delta, primary_key, order)
    return target.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def surrogate_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """md5 of the columns' text joined by ||; null and '' are the same by design."""
    columns = columns or [c for c in df.columns if not c.startswith("_")]
    return F.md5(F.concat_ws("||", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]))


def choose_key(df: DataFrame, cursor: str | None) -> tuple[DataFrame, str]:
    """The cursor column when present, else a surrogate key over the non-underscore columns."""
    if cursor and cursor in df.columns:
        return df, cursor
    return df.withColumn("_ROW_KEY", surrogate_key(df)), "_ROW_KEY"


def row_hash(df: DataFrame, skip: list[str] = ()) -> Column:
    """md5 of the row's values at full precision; null, '' and NaN differ."""
    columns = [F.col(f"`{c}`") for c in df.columns if c not in META_COLUMNS and c not in skip]
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def merge(target: DataFrame, delta: DataFrame, keys: list[str], order: list[Column], skip: list[str] = (),
          whole: bool = False) -> DataFrame:
    """Content-hash merge.

    Returns the merged rows with ``_action``: insert, update (hash differs), unchanged, or kept (not in the batch).
    The batch is deduplicated first; ``order`` lists the winning row first. A target with a ``_ROW_HASH`` column is
    compared by it, others are hashed. Rows outside the batch pass through an anti join, which adaptive execution
    broadcasts for a small batch, so the target stays where it is; only the touched rows are compared. ``whole``, for
    a batch of the size of the target, meets it in one full outer join instead of reading it twice.
    """
    batch = pick_one(delta, keys, order)
    wanted = batch.select(*keys)
    columns = target.columns
    held_hash = F.col("_ROW_HASH") if "_ROW_HASH" in columns else row_hash(target, skip)
    src = batch.select(F.struct(*batch.columns).alias("s"), row_hash(batch, skip).alias("_sh"), *keys)
    held = target if whole else target.join(wanted, keys, "left_semi").select(*columns)
    tgt = held.select(F.struct(*columns).alias("t"), held_hash.alias("_th"), *keys)
    both = src.join(tgt, keys, "full_outer" if whole else "left")
    action = (
        F.when(F.col("t").isNull(), "insert")
        .when(F.col("s").isNull(), "kept")
        .when(F.coalesce("_th", F.lit("")) != F.col("_sh"), "update")
        .otherwise("unchanged")
    )
    use_source = F.col("_action").isin("insert", "update")

    def value(c: str) -> Column:
        new = F.col("_sh") if c == "_ROW_HASH" and c not in batch.columns else F.col(f"s.`{c}`")
        return F.when(use_source, new).otherwise(F.col(f"t.`{c}`")).alias(c)

    met = both.withColumn("_action", action).select(*map(value, columns), "_action")
    if whole:
        return met
    kept = target.join(wanted, keys, "left_anti").select(*columns, F.lit("kept").alias("_action"))
    return kept.unionByName(met)


def merge_stats(merged: DataFrame) -> DataFrame:
    """(ingested, inserts, updates, unchanged, loaded) of the deduplicated batch."""
    def n(action: str) -> Column:
        return F.count_if(F.col("_action") == action)

    return merged.agg(F.count_if(F.col("_action") != "kept").alias("ingested"), n("insert").alias("inserts"),
                      n("update").alias("updates"), n("unchanged").alias("unchanged")) \
        .withColumn("loaded", F.col("inserts") + F.col("updates"))


def reconcile(source: dict[str, DataFrame], destination: dict[str, DataFrame]) -> DataFrame:
    """Row counts per table on both sides, with a TOTAL row."""
    def counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
        out = None
        for table, df in tables.items():
            one = df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(table).alias("table_name"), name)
            out = one if out is None else out.unionByName(one)
        return out

    both = counts(source, "source_rows").join(counts(destination, "dest_rows"), "table_name", "full_outer")
    rows = both.select("table_name", F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
                       F.coalesce("dest_rows", F.lit(0)).alias("dest_rows"))
    total = rows.agg(F.lit("TOTAL").alias("table_name"), F.sum("source_rows").alias("source_rows"),
                     F.sum("dest_rows").alias("dest_rows"))
    return rows.unionByName(total).withColumn("matched", F.col("source_rows") == F.col("dest_rows"))


def dead_letters(df: DataFrame, checks: dict[str, Column], keys: list[str], at: Column) -> DataFrame:
    """Rows that fail any check, with the first failed check's name and the row as JSON."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return df.select(*keys, at.alias("failed_at"), error.alias("error"), F.to_json(F.struct(*df.columns)).alias("payload")) \
        .filter(F.col("error").isNotNull())


def open_letters(letters: DataFrame, acknowledged: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The newest n dead letters nobody acknowledged."""
    waiting = letters.join(acknowledged.select(*keys), keys, "left_anti")
    return waiting.orderBy(F.desc("failed_at"), *keys).limit(n)
