"""Connected components of an edge table, by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Steps


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs to (node, root): the smallest node of each component.

    Each round takes the smallest root among neighbours and then follows that root's own root, so the distance covered
    grows from round to round. Every round is a table in the shared folder. An empty edge table gives an empty result.
    """
    steps = Steps(edges.sparkSession)
    both = steps.write(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "to").distinct(), "edges")
    roots = table = steps.write(both.groupBy("node").agg(F.least("node", F.min("to")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("to"), F.col("root").alias("r")), "to") \
            .groupBy("node").agg(F.min("r").alias("r"))
        met = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        met = steps.write(met, "met")
        steps.drop(table)
        up = met.select(F.col("node").alias("root"), F.col("root").alias("top"))
        table = steps.write(met.join(up, "root").select("node", "old", F.least("root", "top").alias("root")), "roots")
        steps.drop(met)
        roots = table.select("node", "root")
        if table.filter("old <> root").isEmpty():
            steps.drop(both)
            return roots
