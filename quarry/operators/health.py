"""Health of sources: measures of their runs and their events, one row a source, from aggregates that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import first_reason

#: Limits of the measures.
LOOKBACK_RUNS, BASELINE, STALLED_MINUTES, GRACE_HOURS, STREAK_FAILING = 14, 7, 15, 6, 3
STALE_EVENTS, STALE_SHARE, DEVIATION, LEAST_DEVIATION, ABANDONED_DAYS = 3, 0.5, 0.5, 5, 3
DONE = ("success", "partial")


def newest(runs: DataFrame, by: str, ts: str, most: int) -> DataFrame:
    """The newest rows of each group with their rank: first within slices of a group, then among what is left, so that no group is sorted whole."""
    w = lambda *k: Window.partitionBy(*k).orderBy(F.desc(ts), F.desc("run_id"))
    few = runs.withColumn("_s", F.pmod(F.xxhash64("run_id"), F.lit(64))).withColumn("_n", F.row_number().over(w(by, "_s"))).where(F.col("_n") <= most)
    return few.withColumn("rank", F.row_number().over(w(by))).where(F.col("rank") <= most).drop("_s", "_n")


def _streak(done: DataFrame, holds: Column, name: str) -> DataFrame:
    rows = done.select("slug", F.struct("started_at", "run_id").alias("_at"), F.coalesce(holds, F.lit(False)).alias("_ok"))
    end = rows.groupBy("slug").agg(F.max(F.when(~F.col("_ok"), F.col("_at"))).alias("_end"))
    return rows.join(end, "slug").groupBy("slug").agg(F.count_if(F.col("_end").isNull() | (F.col("_at") > F.col("_end"))).alias(name))


def currency_cutoff(cadence: Column, last_retrieving: Column, logged: Column, now: Column) -> Column:
    """The time since which an event must have been seen: the last run that fetched less an hour, or two cadences where runs are not logged."""
    ago = now - F.make_dt_interval(F.lit(0), (2 * cadence + GRACE_HOURS).cast("int"))
    return F.when(cadence.isNull(), F.lit(None)).when(last_retrieving.isNotNull(), last_retrieving - F.make_dt_interval(hours=F.lit(1))).when(~logged, ago)


def measures(sources: DataFrame, runs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """One row of each source(slug, cadence_hours): its newest run, streaks, volume against the runs before, history, and how current its events are.

    runs(slug, run_id, started_at, finished_at, outcome, fetched, parsed, written), events(slug, status, seen_at).
    """
    done = runs.where(F.col("finished_at").isNotNull() & (F.col("outcome") != "started"))
    run = lambda *c: F.struct("started_at", "run_id", *c)
    last = runs.groupBy("slug").agg(F.count("*").alias("runs"), F.max(run("outcome", "finished_at")).alias("last"), F.min("started_at").alias("first_run"))
    fetching = F.when(F.coalesce(F.col("fetched"), F.col("written")) > 0, F.col("started_at"))
    ended = done.groupBy("slug").agg(F.max(run("outcome", "fetched", "parsed", "written")).alias("end"), F.max(F.when(F.col("outcome").isin(*DONE), F.col("started_at"))).alias("last_success_at"), F.max(fetching).alias("last_retrieving_at"))
    zero_fetch, zero_write = _streak(done, F.col("fetched") == 0, "zero_fetch_streak"), _streak(done, (F.col("written") == 0) & ~F.coalesce(F.col("fetched") == 0, F.lit(False)), "zero_write_streak")
    good = newest(done.where(F.col("outcome").isin(*DONE)), "slug", "started_at", BASELINE + 1)
    median = lambda c: F.percentile(F.when(F.col("rank") > 1, F.col(c)), F.lit(0.5))
    vol = good.groupBy("slug").agg(F.max(F.when(F.col("rank") == 1, F.struct("started_at", "run_id"))).alias("good"), F.count("*").alias("n_good"), *(F.max(F.when(F.col("rank") == 1, F.col(c))).alias(f"now_{c}") for c in ("fetched", "written")), *(median(c).alias(f"base_{c}") for c in ("fetched", "written")))
    before = newest(runs, "slug", "started_at", LOOKBACK_RUNS + 1).where("rank > 1")
    stalled = lambda o, f, s: (o == "started") & f.isNull() & (F.unix_timestamp(now) - F.unix_timestamp(s) > STALLED_MINUTES * 60)
    open_, bad = stalled(F.col("outcome"), F.col("finished_at"), F.col("started_at")), F.col("outcome").isin("failed", "blocked")
    history = before.groupBy("slug").agg(F.count("*").alias("runs_examined"), F.count_if(open_).alias("abandoned_earlier"), F.max(F.when(open_, F.col("started_at"))).alias("abandoned_at"), F.count_if(bad).alias("failed_earlier"), F.max(F.when(bad, F.col("started_at"))).alias("failed_at"))
    s = sources.join(last, "slug", "left")
    for part in (ended, zero_fetch, zero_write, vol, history):
        s = s.join(part, "slug", "left")
    cutoff = currency_cutoff(F.col("cadence_hours"), F.col("last_retrieving_at"), F.col("runs").isNotNull(), now)
    cut = s.select("slug", cutoff.alias("cutoff"))
    shown, judged = F.col("status") == "approved", F.col("seen_at").isNotNull() & F.col("cutoff").isNotNull()
    e = events.join(cut, "slug").groupBy("slug").agg(
        F.count_if(shown).alias("upcoming_public"), F.count_if(F.col("status") == "pending_review").alias("upcoming_pending"), F.max(F.when(shown, F.col("seen_at"))).alias("last_seen_at"),
        F.count_if(shown & judged & (F.col("seen_at") >= F.col("cutoff"))).alias("current"), F.count_if(shown & judged & (F.col("seen_at") < F.col("cutoff"))).alias("stale"),
    )
    s = s.join(e, "slug", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    seen = zero("current") + zero("stale")
    share = F.try_divide(zero("current"), seen)
    delta = lambda c: F.abs(F.col(f"now_{c}") - F.col(f"base_{c}"))
    newest_counts = (F.col("end.started_at") == F.col("good.started_at")) & (F.col("n_good") >= 3)
    off = lambda c: F.coalesce(newest_counts & (delta(c) >= LEAST_DEVIATION) & F.when(F.col(f"base_{c}") == 0, F.col(f"now_{c}") > 0).otherwise(delta(c) > DEVIATION * F.col(f"base_{c}")), F.lit(False))
    sign = lambda c: F.when(c.isNull(), "unknown").when(c > 0, "ok").otherwise("fail")
    execution = first_reason([("unknown", F.col("last").isNull()), ("fail", stalled(F.col("last.outcome"), F.col("last.finished_at"), F.col("last.started_at")) | F.col("end.outcome").isin("failed", "blocked")), ("ok", F.col("end").isNotNull())], "unknown")
    fresh = first_reason([("unknown", F.col("cadence_hours").isNull() | (seen < 1)), ("fail", (seen >= STALE_EVENTS) & (share < STALE_SHARE))], "ok")
    out = s.select(
        "slug", "cadence_hours", zero("runs").alias("runs"), F.col("last.started_at").alias("last_attempt_at"), "last_success_at", F.col("last.outcome").alias("last_outcome"), F.col("end.fetched").alias("last_fetched"), F.col("end.parsed").alias("last_parsed"),
        F.col("end.written").alias("last_written"), zero("zero_fetch_streak").alias("zero_fetch_streak"), zero("zero_write_streak").alias("zero_write_streak"), "last_retrieving_at", zero("upcoming_public").alias("upcoming_public"), zero("upcoming_pending").alias("upcoming_pending"),
        "last_seen_at", share.alias("reseen_share"), (off("fetched") | off("written")).alias("volume_deviates"), zero("runs_examined").alias("runs_examined"), zero("abandoned_earlier").alias("abandoned_earlier"), "abandoned_at", zero("failed_earlier").alias("failed_earlier"), "failed_at",
        execution.alias("execution"), sign(F.col("end.fetched")).alias("retrieval"), sign(F.coalesce("end.parsed", "end.written")).alias("useful"), sign(F.col("end.written")).alias("writing"), fresh.alias("currency"),
    )
    return out.withColumn("status", status(now))


def status(now: Column) -> Column:
    """The gravest of what the measures of a row say, over the columns of measures()."""
    c = F.col
    late = F.unix_timestamp(now) - F.unix_timestamp("last_attempt_at") > (2 * F.coalesce(c("cadence_hours"), F.lit(24)) + GRACE_HOURS) * 3600
    scheduled = c("cadence_hours").isNotNull()
    lately = F.unix_timestamp(now) - F.unix_timestamp("abandoned_at") <= ABANDONED_DAYS * 86400
    return first_reason([
        ("failing", scheduled & (F.coalesce(late, F.lit(False)) | (c("execution") == "fail") | (c("zero_fetch_streak") >= STREAK_FAILING) | (c("zero_write_streak") >= STREAK_FAILING))), ("unscheduled", ~scheduled & (c("upcoming_public") > 0)),
        ("stale", scheduled & (c("currency") == "fail")), ("degraded", scheduled & ((c("zero_fetch_streak") > 0) | (c("zero_write_streak") > 0) | ((c("abandoned_earlier") > 0) & lately)) | c("volume_deviates")),
        ("insufficient_evidence", scheduled & (c("runs") == 0)), ("inactive", ~scheduled),
    ], "healthy")


def event_currency(seen_at: Column, cadence: Column, cutoff: Column, reobserves: Column, recurring: Column) -> Column:
    """current, stale or unknown: an event is stale only if a source that re-observes on a schedule did not see it again."""
    known = recurring & reobserves & cadence.isNotNull() & cutoff.isNotNull() & seen_at.isNotNull()
    return first_reason([("unknown", ~F.coalesce(known, F.lit(False))), ("current", seen_at >= cutoff)], "stale")


def run_alerts(entries: DataFrame, today: Column, alert_days: int = 3) -> DataFrame:
    """(type, feed, n) of a run's entries(feed, kind, result): what a person should look at, and blocked feeds again at that age and every week."""
    from ..functions.classes import blocked_days

    days = blocked_days(F.col("result"), today)
    again = F.col("kind").isin("blocked", "blocked_persistent") & (days >= alert_days) & ((days == alert_days) | (days % 7 == 0))
    first = F.when(F.col("kind").isin("blocked", "timeout", "failed"), F.col("kind")).when(F.col("kind") == "empty_unexpected", "unexpected_empty")
    kinds = F.array_compact(F.array(first, F.when(again, "blocked_long"), F.when(F.col("kind") == "deferred", "budget_exhausted")))
    e = entries.select(F.explode(kinds).alias("type"), "feed")
    return e.select("type", F.when(F.col("type") != "budget_exhausted", F.col("feed")).alias("feed")).groupBy("type", "feed").agg(F.count("*").alias("n"))
