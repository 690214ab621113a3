"""Connected components by repeated contraction to the smallest neighbour; everything stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges(a, b): component is the smallest id reachable, the id itself included.

    Each round points every vertex at its smallest neighbour (a pre-aggregated minimum, so hubs cost nothing), follows the pointer
    once more, and replaces the graph by its quotient. The smallest vertex of a component always keeps its name, so the last name is
    the minimum. Rounds grow with the logarithm of a component's width. Null ends are ignored; an empty input gives no rows.
    """
    e = cut(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    labels = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("to")))
        q = p.join(p.select(F.col("v").alias("to"), F.col("to").alias("top")), "to", "left").select("v", F.coalesce("top", "to").alias("top"))
        q = cut(q)
        e = cut(
            e.join(q.select(F.col("v").alias("a"), F.col("top").alias("x")), "a")
            .join(q.select(F.col("v").alias("b"), F.col("top").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        labels = cut(labels.join(q, F.col("component") == F.col("v"), "left").select("id", F.coalesce("top", "component").alias("component")))
    return labels
