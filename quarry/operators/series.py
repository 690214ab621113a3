"""Ordered analytics over runs and days: streaks, islands, volumes, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least days of a run, completed runs of a baseline, share and amount that deviate.
RUN_DAYS, BASELINE_RUNS, DEVIATION, LEAST_DEVIATION = 3, 7, 0.5, 5


def streak(df: DataFrame, by: str, order: list[str], holds: Column) -> DataFrame:
    """(by, streak): rows newer, in the order of columns, than the newest for which holds is not true; null counts as false.

    Two aggregates that combine before they shuffle: a group with a third of all rows is never sorted in one task.
    """
    rows = df.select(by, F.struct(*order).alias("_at"), F.coalesce(holds, F.lit(False)).alias("_ok"))
    ended = rows.groupBy(by).agg(F.max(F.when(~F.col("_ok"), F.col("_at"))).alias("_end"))
    return rows.join(ended, by).groupBy(by).agg(F.count_if(F.col("_end").isNull() | (F.col("_at") > F.col("_end"))).alias("streak"))


def fold_days(days: DataFrame, by: list[str], day: str, least: int = RUN_DAYS) -> DataFrame:
    """(by, first_day, last_day, days): consecutive days as one run where there are at least `least`, else day by day. Days are distinct."""
    w = Window.partitionBy(*by).orderBy(day)
    island = days.withColumn("_i", F.date_sub(day, F.row_number().over(w)))
    runs = island.groupBy(*by, "_i").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days"))
    long = runs.where(F.col("days") >= least)
    short = runs.where(F.col("days") < least).withColumn("first_day", F.explode(F.sequence("first_day", "last_day"))).withColumn("last_day", F.col("first_day")).withColumn("days", F.lit(1).cast("long"))
    return long.unionByName(short).drop("_i")


def volume(runs: DataFrame, by: str, order: str, measure: str) -> DataFrame:
    """Each run with the median of up to seven before it, and whether it deviates from that."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-BASELINE_RUNS, -1)
    base = F.percentile(measure, F.lit(0.5)).over(w)
    delta = F.abs(F.col(measure) - F.col("baseline"))
    off = (delta >= LEAST_DEVIATION) & F.when(F.col("baseline") == 0, F.col(measure) > 0).otherwise(delta > DEVIATION * F.col("baseline"))
    return runs.withColumn("baseline", base).withColumn("deviates", F.coalesce(off, F.lit(False)))


def latest(runs: DataFrame, by: str, order: Column) -> DataFrame:
    """The newest row of each group by a pre-aggregated maximum, without sorting the groups."""
    cols = [c for c in runs.columns if c != by]
    return runs.groupBy(by).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(by, *(F.col(f"_r.{c}").alias(c) for c in cols))


def samples(df: DataFrame, by: str, order: list[Column], most: int = 5) -> DataFrame:
    """Up to most rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def missed(slots: DataFrame, runs: DataFrame, slot: str, ts: str, width: str = "1 hour") -> DataFrame:
    """Slots without a run in [slot, slot + width): an equi-join on the truncated time, no range join."""
    had = runs.select(F.window(F.col(ts).cast("timestamp"), width)["start"].alias("_s")).distinct()
    return slots.join(had, slots[slot].cast("timestamp") == F.col("_s"), "left_anti")


def sessions(events: DataFrame, by: str, ts: str, gap_minutes: int) -> DataFrame:
    """(by, session, first_ts, last_ts, n): a new session after gap_minutes without an event."""
    w = Window.partitionBy(by).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))  # a fraction of a second over the gap is over it
    t = events.withColumn("_new", F.coalesce((at - F.lag(at).over(w) > gap_minutes * 60_000_000).cast("int"), F.lit(1)))
    return t.withColumn("session", F.sum("_new").over(w)).groupBy(by, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def carry(df: DataFrame, by: str, order: str, header: Column, out: str) -> DataFrame:
    """The last header seen so far in each group."""
    return df.withColumn(out, F.last(header, True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
