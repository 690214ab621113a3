"""State of runs and of sessions that go on over several of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_progress(runs: DataFrame, slug: str, now: Column, minutes: int) -> DataFrame:
    """Open runs of a source that began within the last minutes: while there is one, no other starts."""
    age = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    return runs.where((F.col("source_slug") == slug) & (F.col("outcome") == "started") & F.col("finished_at").isNull() & age.between(0, minutes * 60))


def finished(runs: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    """runs with the outcome, end and counts of results(run_id, outcome, finished_at, ...) where a run is still open; a closed one stays."""
    fields = [c for c in results.columns if c != key]
    r = results.select(F.col(key).alias("_k"), F.struct(*fields).alias("_r"))
    j = runs.join(r, F.col(key) == F.col("_k"), "left")
    take = F.col("_k").isNotNull() & (F.col("outcome") == "started")
    return j.select(*(F.when(take, F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in runs.columns))


def restored(stored: DataFrame, listed: DataFrame, key: str, mark: str = "WITHDRAWN") -> DataFrame:
    """stored rows that a pass withdrew (rejected, with its mark in the note) and that the source lists again are approved; others stay."""
    again = stored.join(listed.select(key).distinct().withColumn("_l", F.lit(True)), key, "left")
    back = F.coalesce(F.col("_l") & (F.col("status") == "rejected") & F.contains(F.coalesce("internal_note", F.lit("")), F.lit(mark)), F.lit(False))
    new = {"status": F.when(back, "approved").otherwise(F.col("status")), "internal_note": F.when(back, F.concat("internal_note", F.lit("\nRESTORED"))).otherwise(F.col("internal_note"))}
    return again.select(*(new.get(c, F.col(c)).alias(c) for c in stored.columns))


def session_slice(ids: DataFrame, cursor: Column, size: int, key: str = "at") -> DataFrame:
    """The next ids of a session in order from its cursor on, with its state: next_cursor, and complete where none are left."""
    total = ids.agg(F.count("*")).scalar()
    end = F.least(cursor + size, total)
    return ids.where((F.col(key) >= cursor) & (F.col(key) < cursor + size)).withColumn("next_cursor", end.cast("long")).withColumn("complete", end >= total)


def backlog(items: DataFrame, done: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Items not yet promoted or matched, the first in order, at most so many a run; what is left comes in the next."""
    return items.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).limit(most)


def split_past(rows: DataFrame, stored: DataFrame, key: str, today: Column, grace_days: int = 1) -> DataFrame:
    """rows with a column dropped: new ones whose last day is past the grace are; stored ones never are. Dates are texts."""
    s, e = F.col("start_date").try_cast("date"), F.col("end_date").try_cast("date")
    unreadable = F.col("end_date").isNotNull() & (F.trim("end_date") != "") & e.isNull()
    past = F.coalesce(~unreadable & (F.greatest(s, e) < F.date_sub(today, grace_days)), F.lit(False))
    return rows.join(stored.select(key).distinct().withColumn("_s", F.lit(True)), key, "left").withColumn("dropped", past & F.col("_s").isNull()).drop("_s")
