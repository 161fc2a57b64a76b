"""Landed JSON payloads and grids to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_node(payload: Column, data_root: str | None) -> Column:
    """The node at a dotted path, as JSON text."""
    path = "$" + "".join(f".{p}" for p in data_root.split(".")) if data_root else "$"
    return F.get_json_object(payload, path)


def node_rows(node: Column) -> Column:
    """A node as an array of maps.

    List of objects -> one map each; list of scalars -> {value}; object of equal-length
    arrays -> zipped; any other object -> one map; anything else -> no rows.
    """
    node = F.trim(node)
    items = F.from_json(node, "array<string>")
    fields = F.from_json(node, "map<string,string>")
    from_list = F.transform(
        items,
        lambda e: F.when(F.startswith(F.trim(e), F.lit("{")), F.from_json(e, "map<string,string>"))
        .otherwise(F.create_map(F.lit("value"), e)),
    )
    arrays = F.transform(F.map_values(fields), lambda v: F.from_json(v, "array<string>"))
    sizes = F.array_distinct(F.transform(arrays, lambda a: F.size(a)))
    all_arrays = F.forall(F.map_values(fields), lambda v: F.coalesce(F.startswith(F.trim(v), F.lit("[")), F.lit(False)))
    n = F.size(F.try_element_at(arrays, F.lit(1)))
    zipped = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda i: F.map_from_arrays(F.map_keys(fields), F.transform(arrays, lambda a: F.try_element_at(a, i))),
    )
    return (
        F.when(F.startswith(node, F.lit("[")), from_list)
        .when(F.startswith(node, F.lit("{")) & all_arrays & (F.size(sizes) == 1), zipped)
        .when(F.startswith(node, F.lit("{")), F.array(fields))
        .otherwise(F.array().cast("array<map<string,string>>"))
    )


def json_rows(df: DataFrame, payload: str, data_root: str | None, keep: list[str], columns: list[str]) -> DataFrame:
    """Explode each payload to rows with the requested columns as text; missing ones are null."""
    exploded = df.select(*keep, F.explode(node_rows(json_node(F.col(payload), data_root))).alias("_row"))
    return exploded.select(*keep, *[F.try_element_at("_row", F.lit(c)).alias(c) for c in columns])


def union_pages(pages: DataFrame, feed: str, page_no: str, items: str, limit: int | None = None) -> DataFrame:
    """Items of each feed's pages up to the stop page.

    Stops at the first empty page; with a page size also after the first short page.
    The stop page is one aggregate per feed, so a large feed costs one partial value per task.
    """
    n = F.size(items)
    short = n < (limit if limit is not None else 1)
    stop = pages.groupBy(feed).agg(F.min(F.when(short, F.col(page_no))).alias("_stop"))
    kept = pages.join(stop, feed).filter(F.col("_stop").isNull() | (F.col(page_no) <= F.col("_stop")))
    return kept.select(feed, page_no, F.explode(items).alias("item"))


def grid_table(grid: DataFrame, row_no: str, cells: str) -> DataFrame:
    """Rows of cells to a table: the lowest row number holds the header, short rows padded with ''."""
    header = grid.orderBy(row_no).select(cells).first()[0]
    first = grid.agg(F.min(row_no)).scalar()
    return grid.filter(F.col(row_no) > first).select(
        *[F.coalesce(F.try_element_at(cells, F.lit(i + 1)), F.lit("")).alias(name) for i, name in enumerate(header)]
    )
