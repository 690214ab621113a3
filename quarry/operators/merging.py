"""Two accounts of one thing: sources merged, identities put together, overrides by precedence, hours of several pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .quality import first_reason


def short_title(title: Column) -> Column:
    """Letters and digits of what stands before a bar, & as and."""
    return F.regexp_replace(F.replace(F.lower(F.split_part(F.coalesce(title, F.lit("")), F.lit("|"), F.lit(1))), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "")


def two_sources(left: DataFrame, right: DataFrame, fill: tuple[str, ...] = ("image_url",)) -> DataFrame:
    """left and right (external_id, title, start_date, end_date, fill...) as one list with kept_from and review.

    A row of the right that has the title of one of the left and overlaps its days is the same thing: the left one stays, takes what it
    lacks, and is up for review where the days differ. Of several matches of a left row the first by id fills; a right row that fits several
    left rows goes to the first by id.
    """
    last = lambda d, s: F.coalesce(d, s)
    a = left.withColumn("_t", short_title(F.col("title")))
    b = right.select(short_title(F.col("title")).alias("_t"), F.struct("external_id", "start_date", "end_date", *fill).alias("r"))
    j = a.join(b, "_t").where((F.col("r.start_date") <= last(F.col("end_date"), F.col("start_date"))) & (last(F.col("r.end_date"), F.col("r.start_date")) >= F.col("start_date")))
    owner = j.groupBy(F.col("r.external_id").alias("_o")).agg(F.min("external_id").alias("_to"))
    j = j.join(owner, F.col("r.external_id") == F.col("_o")).where("external_id = _to")
    differ = (F.col("r.start_date") != F.col("start_date")) | ~F.col("r.end_date").eqNullSafe(F.col("end_date"))
    met = j.groupBy("external_id").agg(F.bool_or(differ).alias("_differ"), *(F.min_by(f"r.{c}", F.when(~blank(F.col(f"r.{c}")), F.col("r.external_id"))).alias(f"_f_{c}") for c in fill))
    same = j.select(F.col("r.external_id").alias("external_id")).distinct()
    kept = left.join(met, "external_id", "left").select(*(F.when(blank(F.col(c)), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in left.columns), F.lit("left").alias("kept_from"), F.coalesce("_differ", F.lit(False)).alias("review"))
    return kept.unionByName(right.join(same, "external_id", "left_anti").select(*left.columns, F.lit("right").alias("kept_from"), F.lit(False).alias("review")))


def one_identity(rows: DataFrame, by: str, order: Column, first: tuple[str, ...], latest: tuple[str, ...], terms: str, flags: tuple[str, ...]) -> DataFrame:
    """One row a group: for each field the first that is said, in order; the latest of days; all terms, sorted; whether any flag is set."""
    said = lambda c: F.min_by(c, F.when(~blank(F.col(c)), order))
    each = rows.groupBy(by).agg(*(said(c).alias(c) for c in first), *(F.max(c).alias(c) for c in latest), *(F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in flags))
    words = rows.select(by, F.explode(terms).alias("_w")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("_w")).alias(terms))
    return each.join(words, by, "left").withColumn(terms, F.coalesce(terms, F.array().cast("array<string>")))


def overrides(edges: DataFrame, tiers: list[tuple[str, DataFrame, list[str]]], default: Column) -> DataFrame:
    """edges with status and basis: of the first tier, (name, table(keys..., status), keys), whose keys the edge has; else default and 'default'. A key is once in its table."""
    out = edges
    for n, table, keys in tiers:
        out = out.join(table.select(*keys, F.col("status").alias(f"_s_{n}")), keys, "left")
    status = F.coalesce(*(F.col(f"_s_{n}") for n, *_ in tiers), default)
    basis = F.coalesce(*(F.when(F.col(f"_s_{n}").isNotNull(), n) for n, *_ in tiers), F.lit("default"))
    return out.select(*edges.columns, status.alias("status"), basis.alias("basis"))


def fingerprint(rows: DataFrame, kind: str, line: str) -> DataFrame:
    """(kind, n, hash) of all lines of each kind in order: equal for equal catalogs. For catalogs, which are small: a kind's lines are one text."""
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")).alias("hash"))


#: Ranks of evidence.
RANKS = {"owner_correction": 100, "verified": 80, "manual": 80}


def evidence_rank(source: Column, tier: Column, tiers: dict[str, int]) -> Column:
    """Rank of a value by who says it; else ten for each step of its source's tier."""
    get = lambda table, k: F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), k)
    return F.coalesce(get(RANKS, source), get(tiers, tier) * 10, F.lit(0))


def agreed_hours(pages: DataFrame, by: str) -> DataFrame:
    """(by, day, hours, pages, status) of pages(by, url, day, hours): hours that all pages of a place agree on, by day; a day on which they differ is a conflict and has none."""
    g = pages.groupBy(by, "day").agg(F.countDistinct("hours").alias("_n"), F.min("hours").alias("hours"), F.countDistinct("url").alias("pages"))
    status = first_reason([("conflict", F.col("_n") > 1), ("high", F.col("pages") >= 3), ("medium-high", F.col("pages") == 2)], "medium")
    return g.select(by, "day", F.when(F.col("_n") == 1, F.col("hours")).alias("hours"), "pages", status.alias("status"))
