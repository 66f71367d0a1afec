"""Connected components of an edge table by alternating large and small stars.

Each round hangs neighbours under the smallest node they know; a chain of n links settles in a
logarithmic number of rounds. A hub is only ever aggregated or joined with its one minimum, so
Spark combines it before the shuffle and may split its side of the join. Every round is a table
in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.session import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node."""
    table = materialize(edges.where(F.col(a) != F.col(b))
                  .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(table)
    while mark[0]:
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(root.select("u", F.col("m").alias("v"))).distinct())
        table, before = materialize(small, "stars"), mark
        mark = _mark(table)
        if mark == before:
            break
    stars = table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
