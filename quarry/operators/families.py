"""Which sources repeat others: families found from what they say and who said it first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def copies(statements: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """source, original, n, said of sources that repeat another: n of the `said` different texts of a source were first said by the original.

    A text counts for the source that said it first (ties: the first by name) against everybody who said it later; at least `least` texts
    and `share` of what the source says. Each text is one row a source before anything is compared, so a text that all repeat costs a row
    for each of them, and no pairs of repeaters are formed. Null texts and sources say nothing.
    """
    told = statements.where("text is not null and source is not null").groupBy(F.xxhash64("text").alias("_h"), F.sha2(F.col("text").cast("binary"), 256).alias("_k"), "source").agg(F.min("at").alias("at"))
    first = told.groupBy("_h", "_k").agg(F.min(F.struct("at", "source")).alias("f"))
    late = told.join(first, ["_h", "_k"]).where((F.col("source") != F.col("f.source")) & (F.col("at") > F.col("f.at")))
    said = told.groupBy("source").agg(F.count("*").alias("said"))
    pairs = late.groupBy("source", F.col("f.source").alias("original")).agg(F.count("*").alias("n"))
    return pairs.join(said, "source").where((F.col("n") >= least) & (F.col("n") >= share * F.col("said"))).select("source", "original", "n", "said")


def families(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, family for every source: the first by name of all that repeat one another, directly or not.

    The graph of copies is contracted: every source takes the smallest name among itself and its neighbours, equal names become one vertex,
    until no edge is left. A hub's neighbours are aggregated before they are shuffled.
    """
    label = cut(sources.select("source").where("source is not null").distinct().withColumn("family", F.col("source")))
    edges = cut(pairs.select(F.least("source", "original").alias("a"), F.greatest("source", "original").alias("b")).where("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        low = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("to")))
        label = cut(label.join(low, F.col("family") == F.col("v"), "left").select("source", F.coalesce("to", "family").alias("family")))
        to = lambda side, name: low.select(F.col("v").alias(side), F.col("to").alias(name))  # noqa: B023, E731
        edges = cut(edges.join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return label


def independent(statements: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """statements with the family of their source, and whether the source repeats another of it."""
    pairs = cut(copies(statements, least, share))
    named = families(statements, pairs)
    repeats = pairs.select("source").distinct().withColumn("_r", F.lit(True))
    return statements.join(named, "source", "left").join(repeats, "source", "left").withColumn("copies", F.coalesce("_r", F.lit(False))).drop("_r")
