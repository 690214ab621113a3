"""Keyed lookups: first-wins deduplication, ambiguity-safe maps, tiers, prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; rows with a null key all stay."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    ranked = df.where(~null).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return ranked.unionByName(df.where(null))


def unique_map(df: DataFrame, key: Column, value: str) -> DataFrame:
    """key -> value for keys that mean one value only; an ambiguous or blank key resolves nothing."""
    return df.select(key.alias("key"), value).where("key is not null and key <> ''").groupBy("key").agg(F.min(value).alias(value), F.max(value).alias("_high")).where(F.col(value) == F.col("_high")).drop("_high")


def tiered(df: DataFrame, tiers: list[tuple[str, Column, DataFrame, str]], out: str) -> DataFrame:
    """Left joins in order of trust: tiers are (name, key of df, map(key, value), value); the first that resolves gives out and out_tier."""
    cur = df
    for n, key, table, value in tiers:
        m = table.select(F.col("key").alias(f"_k_{n}"), F.col(value).alias(f"_v_{n}"))
        cur = cur.join(m, key == F.col(f"_k_{n}"), "left")
    tier = F.coalesce(*(F.when(F.col(f"_v_{n}").isNotNull(), F.lit(n)) for n, *_ in tiers))
    return cur.select(*(cur[c] for c in df.columns), F.coalesce(*(F.col(f"_v_{n}") for n, *_ in tiers)).alias(out), tier.alias(f"{out}_tier"))


def by_prefix(column: Column, prefixes: list[tuple[str, str]], other: str | None = None) -> Column:
    """Name of the first prefix a text starts with: one expression, no join."""
    return F.coalesce(*(F.when(F.startswith(column, F.lit(p)), F.lit(n)) for p, n in prefixes), F.lit(other))


def commonest(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group; ties go to the shorter, then to the first in order."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.length(value), value)
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def near_dates(left: DataFrame, right: DataFrame, left_date: str, right_date: str, days: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that agree in the columns by, with dates at most days apart: an equi-join on buckets of that width and its two neighbours."""
    width = max(days, 1)
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    r = right.withColumn("_b", F.explode(F.array(*(bucket(F.col(right_date)) + k for k in (-1, 0, 1)))))
    return left.withColumn("_b", bucket(F.col(left_date))).join(r, [*by, "_b"]).where(F.abs(F.datediff(left_date, right_date)) <= days).drop("_b")


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that are the only one of both their sides."""
    n = lambda k: F.count("*").over(Window.partitionBy(k))
    return pairs.withColumn("_a", n(a)).withColumn("_b", n(b)).where("_a = 1 and _b = 1").drop("_a", "_b")
