"""Verdicts with reason codes, findings, queues, coverage, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a row, best first; outcomes of a check by rank.
STATES = ("cleared", "advisory", "repairable", "needs_decision", "blocked")
OUTCOMES = ("pass", "unchecked", "review", "fail")


def codes(rules: list[tuple[str, str, Column]]) -> Column:
    """array of struct(code, rank) of the rules (code, state, condition) that hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(STATES.index(state)).alias("rank"))) for code, state, c in rules)))


def worst(found: Column) -> Column:
    """The worst state among codes; cleared where there is none."""
    return F.element_at(F.array(*(F.lit(s) for s in STATES)), F.coalesce(F.array_max(F.transform(found, lambda x: x["rank"])), F.lit(0)) + 1)


def summary(df: DataFrame, found: str, row_id: str, most: int = 5) -> DataFrame:
    """code, n, state and up to most sample ids: pre-aggregated, samples are the smallest ids."""
    e = df.select(row_id, F.explode(F.array_distinct(found)).alias("f")).select(row_id, "f.code", "f.rank")
    n = e.groupBy("code").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    from .series import samples

    s = samples(e.select("code", row_id).distinct(), "code", [F.col(row_id)], most).groupBy("code").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%019d", row_id))), ",").alias("_s"))
    ids = F.array_join(F.transform(F.split("_s", ","), lambda x: x.cast("long").cast("string")), ",")
    return n.join(s, "code").select("code", "n", F.element_at(F.array(*(F.lit(x) for x in STATES)), F.col("rank") + 1).alias("state"), ids.alias("samples"))


def first_reason(rules: list[tuple[str, Column]], passed: str = "eligible") -> Column:
    """The first rule that holds, in order."""
    out = None
    for name, c in rules:
        out = F.when(F.coalesce(c, F.lit(False)), name) if out is None else out.when(F.coalesce(c, F.lit(False)), name)
    return out.otherwise(passed)


def queue(findings: DataFrame, stages: list[str]) -> DataFrame:
    """One row a finding key: its stages, sorted, and the code of the latest stage."""
    rank = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col("stage"))
    return findings.withColumn("_r", rank).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"), F.max_by("code", F.struct("_r", "code")).alias("code"), F.count("*").alias("n"))


def coverage(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check × outcome counts from one pass; missing outcomes are 0."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("outcome")) for k, v in checks.items()))).alias("x")).select("x.*")
    return long.groupBy("check").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def gate(skip: Column, reject: Column, hold: Column) -> Column:
    return first_reason([("skip", skip), ("reject", reject), ("hold", hold)], "publish")


def shared_links(df: DataFrame, link: Column, title: Column, least: int = 3) -> DataFrame:
    """(link, titles) of links that at least `least` different titles carry."""
    return df.select(link.alias("link"), F.lower(title).alias("t")).where("link is not null and link <> ''").groupBy("link").agg(F.countDistinct("t").alias("titles")).where(F.col("titles") >= least)
