"""Lineage graph: nodes and edges from model manifests, neighbours, column mapping, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import cut_lineage

_ENTRY = ("struct<name:string,resource_type:string,schema:string,depends_on:struct<nodes:array<string>>>")
MANIFEST = f"struct<nodes:map<string,{_ENTRY}>,sources:map<string,{_ENTRY}>>"
KEPT_TYPES = ["model", "seed", "snapshot"]


def layer(name: Column, resource_type: Column, schema: Column) -> Column:
    n, s = F.lower(name), F.lower(F.coalesce(schema, F.lit("")))
    return (
        F.when(resource_type == "source", "source")
        .when(n.startswith("stg_") | (s == "staging"), "staging")
        .when(n.startswith("fct_") | n.startswith("dim_") | (s == "marts"), "mart")
        .otherwise("raw")
    )


def _entries(manifests: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per source and kept node of each manifest."""
    m = manifests.select(*keep, F.from_json(text, MANIFEST).alias("m"))

    def part(field: str, kind: Column) -> DataFrame:
        rows = m.select(*keep, F.explode(F.map_entries(f"m.{field}")).alias("e")).select(
            *keep, F.col("e.key").alias("id"), F.col("e.value.*"))
        return rows.withColumn("resource_type", kind)

    nodes = part("nodes", F.col("resource_type")).filter(F.col("resource_type").isin(KEPT_TYPES))
    return part("sources", F.lit("source")).unionByName(nodes)


def manifest_nodes(manifests: DataFrame, text: str, keep: list[str]) -> DataFrame:
    short = F.element_at(F.split("id", r"\."), -1)
    return _entries(manifests, text, keep).select(
        *keep, "id", F.coalesce("name", short).alias("name"), "resource_type", F.coalesce("schema", F.lit("")).alias("schema"),
        layer(F.coalesce("name", short), F.col("resource_type"), F.col("schema")).alias("layer"))


def manifest_edges(manifests: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Dependency edges whose both ends are in the graph."""
    entries = _entries(manifests, text, keep)
    edges = entries.select(*keep, F.explode("depends_on.nodes").alias("src"), F.col("id").alias("dst"))
    known = entries.select(*keep, F.col("id").alias("src"))
    # Every dst is an entry itself, so only the source end can be unknown.
    return edges.join(known, [*keep, "src"], "left_semi")


def neighbours(nodes: DataFrame, edges: DataFrame, keep: list[str]) -> DataFrame:
    """(node, direction, neighbour name): all upstream nodes, and downstream models."""
    up = edges.select(*keep, F.col("dst").alias("id"), F.lit("upstream").alias("direction"), F.col("src").alias("other"))
    down = edges.filter(F.col("dst").startswith("model.")).select(
        *keep, F.col("src").alias("id"), F.lit("downstream").alias("direction"), F.col("dst").alias("other"))
    short = F.element_at(F.split("other", r"\."), -1)
    return up.unionByName(down).join(nodes.select(*keep, "id", "name"), [*keep, "id"]).select(
        *keep, "name", "direction", short.alias("neighbour"))


def column_mappings(models: DataFrame, key: str) -> DataFrame:
    """Column pairs of each model (raw_code, source_columns, dest_columns).

    ``a AS b`` pairs first; then source columns named in the first SELECT list that keep their name;
    with neither, any column of both sides named in the code; without code, equal names.
    """
    code = F.coalesce("raw_code", F.lit(""))
    pattern = F.lit(r"\b(\w+)\s+[Aa][Ss]\s+(\w+)\b")
    pairs = F.arrays_zip(F.regexp_extract_all(code, pattern, F.lit(1)).alias("s"), F.regexp_extract_all(code, pattern, F.lit(2)).alias("d"))
    sources, dests = F.col("source_columns"), F.col("dest_columns")

    def same(cols: Column, transform: str) -> Column:
        return F.transform(cols, lambda c: F.struct(c.alias("source_col"), c.alias("dest_col"), F.lit(transform).alias("transform")))

    base = models.withColumns({
        "_aliases": F.filter(pairs, lambda p: F.array_contains(sources, p["s"]) & F.array_contains(dests, p["d"])),
        "_list": F.regexp_extract(code, r"(?is)SELECT\s+(.*?)\s+FROM", 1),
        "_code": code,
    })
    aliased_src, aliased_dst = F.transform("_aliases", lambda p: p["s"]), F.transform("_aliases", lambda p: p["d"])
    kept = F.filter(sources, lambda c: F.contains(F.col("_list"), c) & F.array_contains(dests, c)
                    & ~F.array_contains(aliased_src, c) & ~F.array_contains(aliased_dst, c))
    by_alias = F.transform("_aliases", lambda p: F.struct(
        p["s"].alias("source_col"), p["d"].alias("dest_col"), F.lit("alias").alias("transform")))
    found = F.concat(by_alias, same(kept, "passthrough"))
    mentioned = F.filter(dests, lambda c: F.contains(F.col("_code"), c) & F.array_contains(sources, c))
    chosen = (
        F.when(F.col("_code") == "", same(F.array_intersect(sources, dests), "passthrough"))
        .when(F.size(found) > 0, found).otherwise(same(mentioned, "inferred"))
    )
    return base.select(key, F.inline(chosen))


def reach(seeds: DataFrame, edges: DataFrame, guard: int = 100_000) -> DataFrame:
    """(seed, node, depth) of everything downstream of each seed, at its smallest depth.

    It ends when a round finds nothing new; a graph deeper than ``guard`` rounds raises.

    Breadth first: each round joins only the newest nodes with the edges and drops those seen before.
    Rounds are written to the shared checkpoint folder, so a lost executor does not replay the loop.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct(), "edges")
    frontier = cut_lineage(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct(), "reach")
    seen, depth = frontier, 0
    while True:
        depth += 1
        if depth > guard:
            raise RecursionError(f"the graph is deeper than {guard}")
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        fresh = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut_lineage(fresh, "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = cut_lineage(seen, "seen")  # one table again, so a deep graph does not read hundreds of them
    return seen.filter(F.col("depth") > 0)


def blast_radius(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes affected per seed and distance."""
    return reach(seeds, edges).groupBy("seed", "depth").agg(F.count("*").alias("nodes"))
