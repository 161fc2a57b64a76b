"""Remediation of damaged tables, one function per kind of damage, and their verification.

Each takes a DataFrame and returns the repaired one. Decisions about columns (which have nulls,
which look numeric) come from one aggregate row per table; the rows themselves never leave Spark.
Key and time columns are given explicitly; ``guess_columns`` finds them by exact name or suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import constants as k
from tidemill.functions.exprs import back, numeric_columns, string_columns, temporal_columns
from tidemill.functions.ordered import exact_percentiles, exact_sample
from tidemill.operators.merge import full_order, pick_one
from tidemill.session import cut_lineage

EPOCH = "1970-01-01 00:00:00"
UNKNOWN = "UNKNOWN"
SENTINEL_NUMBER, SENTINEL_TEXT = -1, "RECOVERY_SENTINEL"
FIRST_ROWS, TEXT_LIMIT, SALTS = 10_000, 65_535, 8

# Column names that mark keys and event times.
KEY_NAMES = ["id", "_id", "key", "order_id", "user_id", "trip_id"]
TIME_NAMES = ["event_time", "updated_at", "timestamp", "created_at", "ts"]


class EmptyInput(ValueError):
    """Raised where an empty table means the source could not be read."""


def guess_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """(key, time) by exact name first, then by an ``_id`` suffix."""
    lower = {c.lower(): c for c in df.columns}
    key = next((lower[n] for n in KEY_NAMES if n in lower), None) or next(
        (c for c in df.columns if c.lower().endswith("_id")), None)
    time = next((lower[n] for n in TIME_NAMES if n in lower), None)
    return key, time


def _null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """(rows, nulls per column) from one scan."""
    row = df.agg(F.count("*"), *[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]).first()
    return row[0], dict(zip(df.columns, row[1:]))


def _medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median per column, all columns in the same two passes; the result is one row per column."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns])
    values = df.select(F.inline(cells)).filter(F.col("x").isNotNull())
    return {r["c"]: r["median"] for r in exact_percentiles(values, ["c"], "x", {"median": 0.5}).collect()}


def _all_null(columns: list[str]) -> Column:
    return F.coalesce(*[F.col(f"`{c}`").cast("string") for c in columns]).isNull()


def _numeric_share(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """(non-null values, values that parse as numbers) per text column."""
    if not columns:
        return {}
    aggs = [a for c in columns for a in (F.count(c), F.count(F.col(c).try_cast("double")))]
    row = df.agg(*aggs).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def schema_change(df: DataFrame) -> DataFrame:
    """Fill columns with more than 10 % nulls (median / epoch / UNKNOWN); type text columns that are all numbers."""
    n, nulls = _null_counts(df)
    if n == 0:
        return df
    heavy = [c for c in df.columns if nulls[c] / n > 0.10]
    numeric, temporal = numeric_columns(df), temporal_columns(df)
    types = dict(df.dtypes)
    medians = _medians(df, [c for c in heavy if c in numeric])
    fills = {}
    for c in heavy:
        if c in numeric:
            fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)))
        elif c in temporal:
            fills[c] = F.coalesce(F.col(c), F.lit(EPOCH).cast(types[c]))
        else:
            fills[c] = F.coalesce(F.col(c), F.lit(UNKNOWN))
    filled = df.withColumns(fills) if fills else df
    shares = _numeric_share(filled, string_columns(filled))
    typed = {c: F.col(c).cast("double") for c, (some, parsed) in shares.items() if some and some == parsed}
    return filled.withColumns(typed) if typed else filled


def data_quality(df: DataFrame) -> DataFrame:
    """Drop exact copies, fill numbers with the median and text with UNKNOWN, trim, drop rows without any number."""
    # The distinct rows are read four times below, so they are written once instead of shuffled four times.
    unique = cut_lineage(df.distinct(), "unique")
    n, nulls = _null_counts(unique)
    if n == 0:
        return df
    numeric = numeric_columns(unique)
    medians = _medians(unique, [c for c in numeric if 0 < nulls[c] < n])
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()}
    fills |= {c: F.trim(F.coalesce(F.col(c), F.lit(UNKNOWN))) for c in string_columns(unique)}
    filled = unique.withColumns(fills) if fills else unique
    return filled.filter(~_all_null(numeric)) if numeric else filled


def connection(df: DataFrame) -> DataFrame:
    """Fail on empty input; drop columns without any value."""
    n, nulls = _null_counts(df)
    if n == 0:
        raise EmptyInput("no rows: source unreachable")
    return df.drop(*[c for c in df.columns if nulls[c] == n])


def volume(df: DataFrame) -> DataFrame:
    """Fail on empty input; drop rows without any value."""
    if df.isEmpty():
        raise EmptyInput("no rows: below the minimum of 1")
    return df.na.drop("all")


def timeout(df: DataFrame, max_rows: int) -> DataFrame:
    """Sample to at most max_rows by content hash, then narrow number columns to the smallest type that holds them."""
    total = df.count()
    sampled = exact_sample(df, max_rows) if total > max_rows else df
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("bigint", "int")]
    real = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    if not wide + real:
        return sampled
    row = df.agg(*[a for c in wide + real for a in (F.min(c), F.max(c))]).first()
    casts = {}
    for i, c in enumerate(wide + real):
        low, high = row[2 * i], row[2 * i + 1]
        if low is None:
            continue
        if c in real:
            target = "float" if max(abs(low), abs(high)) < 3.4e38 else None
        else:
            target = next((t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31))
                           if -(2 ** bits) <= low and high < 2 ** bits), None)
        if target:
            casts[c] = F.col(c).cast(target)
    return sampled.withColumns(casts) if casts else sampled


def logic(df: DataFrame) -> DataFrame:
    """Trim text ('nan' becomes null), drop exact copies, fill numbers with 0."""
    texts = {c: F.nullif(F.trim(F.col(c)), F.lit("nan")) for c in string_columns(df)}
    clean = (df.withColumns(texts) if texts else df).distinct()
    return clean.na.fill(0, subset=numeric_columns(df))


def rate_limit(df: DataFrame, order: list, n: int = FIRST_ROWS) -> DataFrame:
    """The first n rows in the given total order."""
    return df.orderBy(*order).limit(n)


def cdc_lag(df: DataFrame, key: str | None = None, time: str | None = None) -> DataFrame:
    """Latest row per key (unknown times last); exact copies removed when no key or time is known."""
    guessed = guess_columns(df)
    key, time = key or guessed[0], time or guessed[1]
    if not (key and time):
        return df.distinct()
    timed = df.withColumn(time, F.col(time).try_cast("timestamp_ntz"))
    return pick_one(timed, [key], full_order(timed, [F.desc_nulls_last(time)]))


def incremental_sync(df: DataFrame, as_of: Column, key: str | None = None, time: str | None = None, days: int = 7) -> DataFrame:
    """Rows of the last ``days`` with a known time, the newest per key."""
    if time:
        timed = df.withColumn(time, F.col(time).try_cast("timestamp_ntz"))
        df = timed.filter(F.col(time) >= back(as_of, f"{days} days"))
    if not key:
        return df.distinct()
    order = full_order(df, [F.desc_nulls_last(time)] if time else [])
    return pick_one(df, [key], order)


def cascading(df: DataFrame) -> DataFrame:
    """Nulls become -1 in number columns and RECOVERY_SENTINEL in text; other types turn to text when they hold nulls."""
    _, nulls = _null_counts(df)
    plain = set(numeric_columns(df)) | set(string_columns(df))
    other = {c: F.coalesce(F.col(c).cast("string"), F.lit(SENTINEL_TEXT)) for c in df.columns if nulls[c] and c not in plain}
    df = df.withColumns(other) if other else df
    return df.na.fill(SENTINEL_NUMBER, subset=numeric_columns(df)).na.fill(SENTINEL_TEXT, subset=string_columns(df))


def checkpoint(df: DataFrame, time: str | None = None) -> DataFrame:
    """Drop exact copies; each output partition in event-time order."""
    time = time or guess_columns(df)[1]
    unique = df.distinct()
    return unique.sortWithinPartitions(time) if time else unique


def duplicate_spike(df: DataFrame, keys: list[str] | None = None, time: str | None = None) -> DataFrame:
    """Newest row per key; without keys one row per content."""
    if not keys:
        return df.distinct()
    return pick_one(df, keys, full_order(df, [F.desc_nulls_last(time)] if time else []))


def _object_columns(df: DataFrame) -> list[str]:
    """Text columns with a value that starts with '{'."""
    texts = string_columns(df)
    if not texts:
        return []
    row = df.agg(*[F.bool_or(F.startswith(F.trim(c), F.lit("{"))) for c in texts]).first()
    return [c for c, found in zip(texts, row) if found]


def _flat_fields(prefix: str, data_type, path: str, joiner: str) -> list[tuple[str, str]]:
    out = []
    for f in data_type.fields:
        where, name = f"{path}.`{f.name}`", f"{prefix}{joiner}{f.name}"
        if f.dataType.typeName() == "struct":
            out += _flat_fields(name, f.dataType, where, ".")
        else:
            out.append((where, name))
    return out


def snowflake_schema(df: DataFrame) -> DataFrame:
    """JSON object columns flattened to ``column__field``; the fields come from all rows."""
    for c in _object_columns(df):
        schema = df.select(F.schema_of_variant_agg(F.try_parse_json(c))).first()[0]
        if not schema or not schema.startswith("OBJECT<"):
            continue
        parsed = df.withColumn("_json", F.from_json(c, schema.replace("OBJECT<", "STRUCT<")))
        fields = _flat_fields(c, parsed.schema["_json"].dataType, "_json", "__")
        df = parsed.select(*[x for x in df.columns if x != c], *[F.col(path).alias(name) for path, name in fields])
    return df


def bigquery_type(df: DataFrame) -> DataFrame:
    """Text columns with more than 80 % numbers become numeric (9 digits), text columns named as times become timestamps."""
    shares, n = _numeric_share(df, string_columns(df)), df.count()
    casts = {}
    for c, (_, parsed) in shares.items():
        if n and parsed / n > 0.8:
            casts[c] = F.round(F.col(c).try_cast("decimal(38,9)"), 9)
        elif any(w in c.lower() for w in ("time", "date", "ts")):
            casts[c] = F.col(c).try_cast("timestamp_ntz")
    return (df.withColumns(casts) if casts else df).na.drop("all")


def mysql_cdc(df: DataFrame, key: str = "id", position: str = "_binlog_position") -> DataFrame:
    """Flag-like integer columns become boolean, datetime text is parsed, the highest log position per key wins."""
    whole = [f.name for f in df.schema.fields
             if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") and f.name not in (key, position)]
    flags = {}
    if whole:
        row = df.agg(F.count("*"), *[F.count_if(F.col(c).isin(0, 1, -128, 127)) for c in whole]).first()
        flags = {c: F.coalesce(F.col(c) == 1, F.lit(False)) for c, hits in zip(whole, row[1:]) if row[0] and hits / row[0] > 0.95}
    times = {c: F.col(c).try_cast("timestamp_ntz") for c in string_columns(df)
             if any(w in c.lower() for w in ("datetime", "created_at", "updated_at"))}
    df = df.withColumns(flags | times) if flags or times else df
    if position in df.columns and key in df.columns:
        df = pick_one(df, [key], full_order(df, [F.desc_nulls_last(position)]))
    return df


def mongodb_flatten(df: DataFrame) -> DataFrame:
    """Nested documents to ``column.field``; columns that hold nulls become text with 'null'."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [F.col(path).alias(name) for path, name in _flat_fields(f.name, f.dataType, f"`{f.name}`", ".")]
        else:
            out.append(F.col(f"`{f.name}`"))
    flat = df.select(*out)
    _, nulls = _null_counts(flat)
    return flat.select(*[
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")).alias(c) if nulls[c] else F.col(f"`{c}`").alias(c)
        for c in flat.columns
    ])


def redshift_load(df: DataFrame) -> DataFrame:
    """Text cut to the load limit, NUL characters removed, rows with unprintable characters dropped.

    Unprintable: any control, format, unassigned or separator character but the plain space.
    """
    texts = string_columns(df)
    cut = {c: F.replace(F.substring(c, 1, TEXT_LIMIT), F.lit("\x00"), F.lit("")) for c in texts}
    df = df.withColumns(cut) if cut else df
    for c in texts:
        df = df.filter(F.col(c).isNull() | ~F.col(c).rlike(r"[\p{C}\p{Z}&&[^ ]]"))
    return df


def partition_skew(df: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Add ``_partition_salt``: 0..salts-1 for keys above 5 times the mean frequency, else 0.

    The salt comes from row position, not content, so copies of one row spread too. Positions can
    change when a lost task is repeated, so the salted rows are written before anything is shuffled by them.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    mean = sizes.agg(F.avg("_n")).scalar()
    hot = sizes.filter(F.col("_n") > mean * k.SKEW_RATIO).select(key, F.lit(True).alias("_hot"))
    # Less than a fifth of the keys can be hot; the planner broadcasts them only when they are small.
    placed = df.withColumn("_row", F.monotonically_increasing_id())
    salted = placed.join(hot, key, "left").withColumn(
        "_partition_salt", F.when(F.col("_hot"), F.pmod("_row", F.lit(salts))).otherwise(0).cast("int")).drop("_row", "_hot")
    return cut_lineage(salted, "salted")


def verify(df: DataFrame) -> DataFrame:
    """What the checks of every remediation need: rows, columns, null cells, largest and mean null share, copies."""
    n = F.count("*")
    shares = [F.coalesce((n - F.count(F.col(f"`{c}`"))) / F.nullif(n, F.lit(0)), F.lit(0.0)) for c in df.columns]
    measured = df.agg(
        n.alias("rows"),
        sum((n - F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0)).alias("null_cells"),
        F.greatest(*shares, F.lit(0.0)).alias("max_null_share") if shares else F.lit(0.0).alias("max_null_share"),
        (sum(shares, F.lit(0.0)) / len(shares) if shares else F.lit(0.0)).alias("mean_null_share"),
    )
    distinct = df.groupBy(*df.columns).agg(F.lit(1)).agg(F.count("*")).scalar()
    return measured.select("rows", F.lit(len(df.columns)).alias("columns"), "null_cells", "max_null_share",
                           "mean_null_share", (F.col("rows") - distinct).alias("copies"))


# Verification rule per remediation, over the measures of ``verify``.
PASSES = {
    "schema_change": "rows > 0 AND max_null_share < 0.15",
    "data_quality": "rows > 0 AND null_cells = 0",
    "connection": "rows > 0 AND columns > 0",
    "volume": "rows > 0",
    "timeout": "rows > 0",
    "logic": "rows > 0 AND copies = 0",
    "rate_limit": "rows > 0 AND rows <= 10000",
    "cdc_lag": "rows > 0 AND copies = 0",
    "incremental_sync": "rows > 0",
    "cascading": "rows > 0 AND null_cells = 0",
    "checkpoint": "rows > 0",
    "duplicate_spike": "rows > 0 AND copies = 0",
    "snowflake_schema": "rows > 0",
    "bigquery_type": "rows > 0",
    "mysql_cdc": "rows > 0",
    "mongodb_flatten": "rows > 0",
    "redshift_load": "rows > 0",
    "partition_skew": "rows > 0",
}


def verified(df: DataFrame, remedy: str) -> DataFrame:
    """One row: the remedy, its measures and whether it passes."""
    return verify(df).select(F.lit(remedy).alias("remedy"), "*", F.expr(PASSES[remedy]).alias("passed"))
