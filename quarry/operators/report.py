"""One report over an inventory: all counts from a single pass, and findings by row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .quality import STATES, worst


def counted(rows: DataFrame, values: Mapping[str, Column], upcoming: Column | None = None) -> DataFrame:
    """section, key, n, upcoming: how many rows have each value of each section.

    A section's value is a column, or an array where a row counts for several; null counts for none. All sections come from one scan:
    a row becomes a (section, key) for each of its values, and these are counted before they are shuffled.
    """
    is_list = {k: rows.select(v.alias("v")).schema["v"].dataType.typeName() == "array" for k, v in values.items()}

    def keys(section: str, v: Column) -> Column:
        return F.transform(v.cast("array<string>") if is_list[section] else F.array(v.cast("string")), lambda x: F.struct(F.lit(section).alias("section"), x.alias("key")))

    each = [keys(k, v) for k, v in values.items()]
    flat = rows.select(F.explode(F.filter(F.flatten(F.array(*(F.coalesce(e, F.array().cast("array<struct<section:string,key:string>>")) for e in each))), lambda x: x["key"].isNotNull())).alias("s"), (upcoming if upcoming is not None else F.lit(True)).alias("_u"))
    return flat.groupBy("s.section", "s.key").agg(F.count("*").alias("n"), F.count_if("_u").alias("upcoming"))


def first_keys(counts: DataFrame, section: str, most: int, prefix: str = "|") -> DataFrame:
    """Of a section whose keys are 'group|member', the `most` commonest members of each group, by count and name."""
    from pyspark.sql import Window

    own = counts.where(F.col("section") == section).withColumn("group", F.substring_index("key", prefix, 1)).withColumn("member", F.substring_index("key", prefix, -1))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "member"))).where(F.col("rank") <= most).select("group", "rank", "member", "n")


def inventory(rows: DataFrame, cutoffs: DataFrame, observation: Observation | None = None) -> DataFrame:
    """counted() of rows(id, status, source, start_date, seen_at, codes: array of struct(code, rank)) for a report.

    cutoffs(source, cutoff) say since when a source's events must have been seen: an older one is stale, and stale adds a finding before
    the worst state is taken, so that the second pass of a report needs no second scan. Only approved rows have states, codes and currency.
    A source without cutoff has unknown currency; rows without a source are `unattributed`. With an observation the totals are observed
    while the report is written.
    """
    j = rows.join(cutoffs.select("source", "cutoff"), "source", "left")
    currency = F.when(F.col("cutoff").isNull() | F.col("seen_at").isNull(), "unknown").when(F.col("seen_at") >= F.col("cutoff"), "current").otherwise("stale")
    j = j.withColumn("currency", currency)
    stale = F.array(F.struct(F.lit("currency.not_reseen").alias("code"), F.lit(STATES.index("advisory")).alias("rank")))
    found = F.when(F.col("currency") == "stale", F.concat(F.coalesce("codes", F.array().cast("array<struct<code:string,rank:int>>")), stale)).otherwise(F.col("codes"))
    j = j.withColumn("found", found)
    if observation is not None:
        j = j.observe(observation, F.count("*").alias("rows"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("source").isNull()).alias("unattributed"))
    public = lambda x: F.when(F.col("status") == "approved", x)
    name = F.coalesce("source", F.lit("unattributed"))
    codes = F.array_distinct(F.transform("found", lambda f: f["code"]))
    return counted(j, {
        "status": F.col("status"), "state": public(worst(F.col("found"))), "currency": public(F.col("currency")), "code": public(codes), "source": public(name),
        "code_source": public(F.transform(codes, lambda k: F.concat(k, F.lit("|"), name))), "source_currency": public(F.concat(name, F.lit("|"), F.col("currency"))),
    })


def findings_by_row(findings: DataFrame) -> DataFrame:
    """id, codes: array of struct(code, keys) of findings(key, code, ids): what is known of each row, by code."""
    each = findings.select(F.explode(F.array_distinct("ids")).alias("id"), "code", "key")
    by_code = each.groupBy("id", "code").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return by_code.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "keys"))).alias("codes"))
