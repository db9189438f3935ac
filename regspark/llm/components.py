"""Connected components of links by alternating large and small stars, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _toward_minimum(links: DataFrame, name: str) -> DataFrame:
    """links (u, v) with the least neighbour of u, or u itself, as m.

    The minima are a written table, so that both sides of the join are plain
    exchanges, which adaptive execution can split where one u has many links.
    """
    least = written(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in a link (a, b) of longs; root is the least node of its component.

    Loops and repeated links do no harm; an empty input gives no row.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_toward_minimum(both, "least").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        stars = _toward_minimum(large, "least")
        small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        state = now
