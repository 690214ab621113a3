"""Queries over the driver's tables that show each operator, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates as D
from .functions import addresses, geo, text, titles, urls
from . import cases, jobs, readings
from .lineage import spread
from .operators import articles, duplicates, lookup, merge, quality, series
from .plans import discovery
from .plans.discovery import State
from .sources import calendar, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TODAY, CLOCK = date(1997, 6, 11), 20 * 60
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listing(spark: SparkSession, d: str) -> DataFrame:
    """Orders with customers and nations as event listings; every column is a function of the keys."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), c("o_custkey") == c("c_custkey"), "left").join(t(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"), "left")
    k, start = c("o_orderkey"), c("o_orderdate").cast("date")
    return o.select(
        k.alias("id"), F.concat_ws(" ", "c_name", "o_orderpriority").alias("title"), c("c_name").alias("venue"), c("n_name").alias("city"), F.when(k % 3 > 0, F.concat(F.lit("Quarter "), (k % 9).cast("string"))).alias("neighborhood"),
        c("c_mktsegment").alias("category"), (k % 4 == 0).alias("free"), c("o_orderpriority").alias("source"), start.alias("start_date"), F.when(k % 3 != 0, F.date_add(start, (k % 45).cast("int"))).alias("end_date"),
        F.when(k % 5 == 0, "recurring").when(k % 5 == 1, "continuous").when(k % 5 == 2, "single").alias("semantics"),
        F.when(k % 10 == 0, F.array(start, F.date_add(start, 7), F.date_add(start, 14))).alias("occurrence_dates"),
        F.when(k % 6 == 0, "7:00 PM - 9:30 PM").when(k % 6 == 1, "noon").when(k % 6 == 2, "10:30 AM - 7:15 PM").alias("time"), F.lit(False).alias("all_day"),
        (c("n_nationkey") * 1.5 + 20).cast("double").alias("lat"), (c("n_nationkey") * -2.0 - 60).cast("double").alias("lng"), c("o_totalprice").alias("price"), c("o_orderstatus").alias("status"),
    )


EV = """ev AS (SELECT o_orderkey AS id, concat_ws(' ', c_name, o_orderpriority) AS title, c_name AS venue, n_name AS city, CASE WHEN o_orderkey % 3 > 0 THEN 'Quarter ' || (o_orderkey % 9) END AS neighborhood, c_mktsegment AS category, o_orderkey % 4 = 0 AS free, o_orderpriority AS source,
  CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) END AS end_date,
  CASE o_orderkey % 5 WHEN 0 THEN 'recurring' WHEN 1 THEN 'continuous' WHEN 2 THEN 'single' END AS semantics, o_orderkey % 10 = 0 AS has_dates, o_orderkey % 6 AS tm,
  n_nationkey * 1.5 + 20 AS lat, n_nationkey * -2.0 - 60 AS lng, o_totalprice AS price, o_orderstatus AS status
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
es AS (SELECT *, greatest(start_date, coalesce(end_date, start_date)) AS last_date, CASE WHEN semantics = 'single' THEN 'confirmed' WHEN semantics = 'continuous' THEN 'ongoing'
  WHEN semantics = 'recurring' THEN CASE WHEN has_dates THEN 'confirmed' ELSE 'unverified' END WHEN coalesce(end_date > start_date, false) THEN 'unverified' ELSE 'confirmed' END AS state FROM ev),
ed AS (SELECT *, CASE WHEN state = 'ongoing' THEN NULL WHEN state = 'unverified' THEN CAST([] AS DATE[]) WHEN semantics = 'recurring' THEN [start_date, start_date + 7, start_date + 14] ELSE [start_date] END AS days FROM es)"""
NOW = f"DATE '{TODAY}'"


def _over(minutes: int) -> str:
    ends = {0: 21 * 60 + 30, 2: 19 * 60 + 15}
    return "(tm IN (" + (", ".join(str(k) for k, e in ends.items() if e < minutes) or "-1") + "))"


def _when(a: date | None, b: date | None, mode: str, forward: bool = True) -> str:
    lo, hi = (f"DATE '{a}'" if a else None), (f"DATE '{b}'" if b else None)
    alive = (lambda x: f"({x} > {NOW} OR ({x} = {NOW} AND NOT {_over(CLOCK)}))") if forward else (lambda x: "true")
    inside = lambda p, q: " AND ".join([f"{q} >= {lo}" if lo else "true", f"{p} <= {hi}" if hi else "true"])
    certain = f"len(list_filter(days, lambda d: {alive('d')} AND {inside('d', 'd')})) > 0"
    unsure = f"({str(mode == 'all').lower()} AND {alive('last_date')}" + (f" AND last_date >= {lo})" if lo else ")")
    night = " AND tm IN (0)" if mode == "tonight" else ""
    return f"(CASE WHEN days IS NULL THEN {alive('last_date')} AND {inside('start_date', 'last_date')} WHEN len(days) = 0 THEN {unsure} ELSE {certain} END{night})"


def _discover(mode: str, first: date | None = None, last: date | None = None):
    state = State(mode=mode, first=first, last=last)
    a, b, _, forward = discovery.window(state, TODAY)

    def run(spark, d):
        e = discovery.prepare(listing(spark, d)).where(discovery.predicate(state, TODAY, CLOCK))
        return e.select("id", c("start_date").cast("string").alias("start_date"), "state")

    run.__name__ = f"discover_{mode}"
    query(f"WITH {EV} SELECT id, CAST(start_date AS VARCHAR) AS start_date, state FROM ed WHERE {_when(a, b, mode, forward)}")(run)


for _mode in ("today", "tonight", "tomorrow", "weekend", "week", "next7", "all"):
    _discover(_mode)
_discover("dates", date(1996, 3, 1), date(1996, 3, 9))


@query("SELECT o_orderkey, coalesce(n_name, c_name) AS place, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'")
def public_view(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    n = t(spark, d, "nation").join(t(spark, d, "region"), c("n_regionkey") == c("r_regionkey"), "left")
    return o.join(t(spark, d, "customer"), c("o_custkey") == c("c_custkey"), "left").join(n, c("c_nationkey") == c("n_nationkey"), "left").select("o_orderkey", F.coalesce("n_name", "c_name").alias("place"), "r_name")


@query(f"WITH {EV} SELECT id FROM ev WHERE start_date >= {NOW} OR end_date >= {NOW}")
def inventory_filter(spark, d):
    return listing(spark, d).where(discovery.inventory(TODAY)).select("id")


@query(f"WITH {EV} SELECT count(*) AS n FROM ed WHERE {_when(TODAY, date(1997, 6, 17), 'next7')} AND category IN ('BUILDING', 'MACHINERY') AND free")
def count_distinct_events(spark, d):
    return discovery.count(listing(spark, d), State(mode="next7", categories=("MACHINERY", "BUILDING"), free=True), TODAY, minutes=CLOCK)


@query(f"WITH {EV}, h AS (SELECT category, id FROM ed WHERE {_when(TODAY, date(1997, 6, 17), 'next7')} AND free) SELECT x.category AS value, count(h.id) AS n FROM (SELECT DISTINCT c_mktsegment AS category FROM customer) x LEFT JOIN h USING (category) GROUP BY 1")
def facet_category(spark, d):
    values = t(spark, d, "customer").select(c("c_mktsegment").alias("value")).distinct()
    return discovery.facet(listing(spark, d), State(mode="next7", categories=("BUILDING",), free=True), TODAY, "category", values, minutes=CLOCK)


@query(f"WITH {EV} SELECT city AS value, count(*) AS n FROM ed WHERE {_when(TODAY, date(1997, 6, 17), 'next7')} AND category = 'BUILDING' AND city IS NOT NULL GROUP BY 1")
def facet_city(spark, d):
    return discovery.facet(listing(spark, d), State(mode="next7", categories=("BUILDING",)), TODAY, "city", minutes=CLOCK)


@query(f"WITH {EV} SELECT id, title FROM ed WHERE {_when(TODAY, None, 'all')} AND contains(lower(concat_ws(' ', title, venue, city, category, neighborhood, source)), '1-urgent')")
def discover_search(spark, d):
    return discovery.prepare(listing(spark, d)).where(discovery.predicate(State(search="1-Urgent"), TODAY, CLOCK)).select("id", "title")


@query(f"WITH {EV} SELECT id, neighborhood FROM ed WHERE {_when(TODAY, None, 'all')} AND neighborhood = 'Quarter 4' AND contains(lower(concat_ws(' ', title, venue, city, category, neighborhood, source)), 'quarter 4 ')")
def discover_neighborhood(spark, d):
    return discovery.prepare(listing(spark, d)).where(discovery.predicate(State(neighborhood="Quarter 4", search="quarter 4 "), TODAY, CLOCK)).select("id", "neighborhood")


@query(f"WITH {EV} SELECT neighborhood AS value, count(*) AS n FROM ed WHERE {_when(TODAY, date(1997, 6, 17), 'next7')} AND category = 'BUILDING' AND neighborhood IS NOT NULL GROUP BY 1")
def facet_neighborhood(spark, d):
    return discovery.facet(listing(spark, d), State(mode="next7", categories=("BUILDING",), neighborhood="Quarter 1"), TODAY, "neighborhood", minutes=CLOCK)


_HAV = "2 * 3958.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - 42.0) / 2), 2) + cos(radians(42.0)) * cos(radians(lat)) * pow(sin(radians(lng + 80.0) / 2), 2))))"


@query(f"WITH {EV} SELECT DISTINCT city, CAST(floor({_HAV} + 0.5) AS BIGINT) AS miles, {_HAV} <= 2000 AS near FROM ev WHERE city IS NOT NULL")
def place_distance(spark, d):
    m = geo.haversine(F.lit(42.0), F.lit(-80.0), c("lat"), c("lng"))
    return listing(spark, d).where("city is not null").select("city", F.floor(m + 0.5).cast("long").alias("miles"), (m <= 2000).alias("near")).distinct()


@query(f"WITH {EV} SELECT id FROM ed WHERE {_when(TODAY, None, 'all')} AND {_HAV} <= 500")
def discover_radius(spark, d):
    return discovery.prepare(listing(spark, d)).where(discovery.predicate(State(origin=(42.0, -80.0), radius=500.0), TODAY, CLOCK)).select("id")


@query(f"WITH {EV} SELECT id FROM ed WHERE state = 'unverified' AND last_date >= DATE '1997-06-11' AND start_date <= DATE '1997-06-17'")
def unconfirmed_list(spark, d):
    return discovery.unconfirmed(listing(spark, d), State(mode="next7"), TODAY).select("id")


@query(f"WITH {EV} SELECT state, semantics, count(*) AS n FROM es GROUP BY ALL")
def schedule_state(spark, d):
    return discovery.prepare(listing(spark, d)).groupBy("state", "semantics").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, a AS (SELECT id, state, CASE WHEN days IS NULL THEN {NOW} BETWEEN start_date AND last_date ELSE list_contains(days, {NOW}) END AS act, {NOW} BETWEEN start_date AND last_date AS ins FROM ed)
SELECT id, CASE WHEN act THEN CASE WHEN state = 'ongoing' THEN 'ongoing' ELSE 'confirmed' END WHEN state = 'unverified' AND ins THEN 'unverified' END AS availability FROM a WHERE act OR (state = 'unverified' AND ins)""")
def availability_day(spark, d):
    e = discovery.prepare(listing(spark, d))
    return e.select("id", D.availability(c("state"), c("days"), c("start_date"), c("end_date"), F.lit(TODAY)).alias("availability")).where("availability is not null")


@query(f"""WITH {EV} SELECT id, CAST(CASE WHEN state = 'ongoing' THEN CASE WHEN last_date >= {NOW} THEN greatest(start_date, {NOW}) END ELSE list_min(list_filter(days, lambda x: x >= {NOW})) END AS VARCHAR) AS next_date,
CASE WHEN state = 'confirmed' AND semantics = 'recurring' THEN start_date + 14 >= {NOW} WHEN state = 'confirmed' THEN start_date >= {NOW} ELSE last_date >= {NOW} END AS upcoming FROM ed""")
def next_date(spark, d):
    e = discovery.prepare(listing(spark, d))
    return e.select("id", D.next_date(c("state"), c("days"), c("start_date"), c("end_date"), F.lit(TODAY)).cast("string").alias("next_date"), D.upcoming(c("state"), c("semantics"), c("start_date"), c("end_date"), c("occurrence_dates"), F.lit(TODAY)).alias("upcoming"))


@query(f"""WITH {EV}, x AS (SELECT id, CASE WHEN days IS NOT NULL THEN list_filter(days, lambda q: q >= {NOW})[1:60]
ELSE [CAST(q AS DATE) for q in range(CAST(CASE WHEN {NOW} > start_date AND {NOW} <= last_date THEN {NOW} ELSE start_date END AS TIMESTAMP), CAST(last_date + 1 AS TIMESTAMP), INTERVAL 1 DAY)][1:60] END AS l FROM ed)
SELECT id, CAST(unnest(l) AS VARCHAR) AS day FROM x""")
def expand_days(spark, d):
    e = discovery.prepare(listing(spark, d))
    return e.select("id", F.explode(D.listed_days(c("days"), c("start_date"), c("end_date"), F.lit(TODAY))).alias("day")).withColumn("day", c("day").cast("string"))


@query(f"""WITH {EV} SELECT id, CASE WHEN semantics = 'recurring' AND NOT has_dates THEN 'recurring-without-dates' WHEN semantics = 'recurring' AND start_date + 14 > last_date THEN 'occurrence-outside-range'
WHEN state = 'unverified' AND semantics IS NULL AND tm < 3 THEN 'unclassified-multiday-clock-time' WHEN state = 'unverified' THEN 'unverified-multiday-schedule' END AS reason FROM es""")
def review_reason(spark, d):
    e = discovery.prepare(listing(spark, d))
    return e.select("id", D.review_reason(c("state"), c("semantics"), c("start_date"), c("end_date"), c("occurrence_dates"), c("time"), c("all_day")).alias("reason"))


@query("SELECT event_id, CAST(CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Detroit' AS DATE) AS VARCHAR) AS day, CAST(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Detroit') * 60 + minute(ts) AS INT) AS minutes FROM events")
def tz_local_day(spark, d):
    day, minutes = D.local_clock(c("ts").cast("timestamp"))
    return t(spark, d, "events").select("event_id", day.cast("string").alias("day"), minutes.cast("int").alias("minutes"))


# a rule for every customer: by its key the day of the week, the step, the number of the weekday in a month, the day left out and the day moved
_DAYS = ("SU", "MO", "TU", "WE", "TH", "FR", "SA")


def _ruled(spark, d, start, rrule):
    none = lambda kind: F.lit(None).cast(kind)
    return spread(t(spark, d, "customer").select("c_custkey"), "c_custkey").select(c("c_custkey").alias("uid"), start.alias("start_date"), rrule.alias("rrule"), F.lit("x").alias("summary"), none("string").alias("status"), F.array().cast("array<date>").alias("exdates"), none("date").alias("recurrence_date"))


@query("""WITH r AS (SELECT c_custkey AS rule, DATE '2026-01-01' + CAST(c_custkey % 40 AS INT) AS start, c_custkey % 7 AS dow, 1 + c_custkey % 3 AS step FROM customer),
f AS (SELECT *, start + CAST((dow - dayofweek(start) + 7) % 7 AS INT) AS first FROM r)
SELECT rule, CAST(CAST(unnest(range(CAST(first AS TIMESTAMP), TIMESTAMP '2026-06-01', to_days(CAST(7 * step AS INT)))) AS DATE) AS VARCHAR) AS day FROM f""")
def recurrence_weekly(spark, d):
    k = c("c_custkey")
    day = F.element_at(F.array(*(F.lit(x) for x in _DAYS)), (k % 7).cast("int") + 1)
    e = _ruled(spark, d, F.date_add(F.lit(date(2026, 1, 1)), (k % 40).cast("int")), F.concat(F.lit("FREQ=WEEKLY;INTERVAL="), (1 + k % 3).cast("string"), F.lit(";BYDAY="), day))
    return calendar.expand(e, F.lit(date(2026, 5, 31))).select(c("uid").alias("rule"), c("day").cast("string").alias("day"))


@query("""WITH m AS (SELECT CAST(unnest(range(TIMESTAMP '2026-01-01', TIMESTAMP '2027-01-01', INTERVAL 1 MONTH)) AS DATE) AS m), r AS (SELECT c_custkey AS rule, c_custkey % 7 AS dow, c_custkey % 5 AS n FROM customer),
x AS (SELECT rule, CASE WHEN n < 4 THEN m + CAST((dow - dayofweek(m) + 7) % 7 AS INT) + CAST(7 * n AS INT) ELSE last_day(m) - CAST((dayofweek(last_day(m)) - dow + 7) % 7 AS INT) END AS day FROM r, m)
SELECT rule, CAST(day AS VARCHAR) AS day FROM x""")
def recurrence_monthly_nth(spark, d):
    k = c("c_custkey")
    nth = F.when(k % 5 < 4, (k % 5 + 1).cast("string")).otherwise("-1")
    e = _ruled(spark, d, F.lit(date(2026, 1, 1)), F.concat(F.lit("FREQ=MONTHLY;BYDAY="), nth, F.element_at(F.array(*(F.lit(x) for x in _DAYS)), (k % 7).cast("int") + 1)))
    return calendar.expand(e, F.lit(date(2026, 12, 31))).select(c("uid").alias("rule"), c("day").cast("string").alias("day"))


@query("""WITH r AS (SELECT c_custkey AS rule, c_custkey % 8 AS x, (c_custkey + 3) % 8 AS y FROM customer), d AS (SELECT rule, x, y, unnest(range(8)) AS i FROM r)
SELECT rule, CAST(DATE '2026-01-05' + CAST(7 * i + CASE WHEN i = y THEN 1 ELSE 0 END AS INT) AS VARCHAR) AS day FROM d WHERE i <> x""")
def recurrence_exdate(spark, d):
    k, first = c("c_custkey"), F.lit(date(2026, 1, 5))
    stamp = lambda n, more=0: F.date_format(F.date_add(first, (7 * (n % 8) + more).cast("int")), "yyyyMMdd")
    ics = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u"), k.cast("string"), F.lit("\r\nSUMMARY:Weekly\\, long\r\n  title\r\nDTSTART;VALUE=DATE:20260105\r\nDTEND;VALUE=DATE:20260106\r\nRRULE:FREQ=WEEKLY;UNTIL=20260228;BYDAY=MO\r\nEXDATE;VALUE=DATE:"), stamp(k),
        F.lit("\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:u"), k.cast("string"), F.lit("\r\nSUMMARY:Moved\r\nDTSTART;VALUE=DATE:"), stamp(k + 3, 1), F.lit("\r\nRECURRENCE-ID;VALUE=DATE:"), stamp(k + 3), F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR"),
    )
    read = calendar.vevents(spread(t(spark, d, "customer").select("c_custkey"), "c_custkey").select(ics.alias("ics")), "ics")
    return calendar.expand(read, F.lit(date(2026, 12, 31))).select(F.substring("uid", 2, 20).cast("long").alias("rule"), c("day").cast("string").alias("day"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS g FROM d),
r AS (SELECT user_id, min(day) AS a, max(day) AS b, count(*) AS n FROM i GROUP BY user_id, g)
SELECT user_id, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day, n AS days FROM r WHERE n >= 3
UNION ALL SELECT user_id, CAST(q AS VARCHAR), CAST(q AS VARCHAR), 1 FROM (SELECT user_id, CAST(unnest(range(CAST(a AS TIMESTAMP), CAST(b + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS q FROM r WHERE n < 3)""")
def run_folding(spark, d):
    days = t(spark, d, "events").select("user_id", c("ts").cast("date").alias("day")).distinct()
    return series.fold_days(days, ["user_id"], "day").select("user_id", c("first_day").cast("string").alias("first_day"), c("last_day").cast("string").alias("last_day"), "days")


@query("WITH r AS (SELECT event_type, value < 50 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type, coalesce(min(CASE WHEN NOT coalesce(ok, false) THEN n END), max(n) + 1) - 1 AS streak FROM r GROUP BY 1")
def streak_zero(spark, d):
    return series.streak(t(spark, d, "events"), "event_type", ["ts", "event_id"], c("value") < 50)


@query("""WITH v AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(floor(sum(value)) AS BIGINT) AS volume FROM events GROUP BY 1, 2), b AS (SELECT *, quantile_cont(volume, 0.5) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM v)
SELECT event_type, CAST(day AS VARCHAR) AS day, volume, CAST(2 * m AS BIGINT) AS twice_baseline, coalesce(abs(volume - m) >= 5 AND CASE WHEN m = 0 THEN volume > 0 ELSE abs(volume - m) > 0.5 * m END, false) AS deviates FROM b""")
def volume_anomaly(spark, d):
    v = t(spark, d, "events").groupBy("event_type", c("ts").cast("date").alias("day")).agg(F.floor(F.sum("value")).cast("long").alias("volume"))
    return series.volume(v, "event_type", "day", "volume").select("event_type", c("day").cast("string").alias("day"), "volume", (2 * c("baseline")).cast("long").alias("twice_baseline"), "deviates")


@query("SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_run(spark, d):
    return series.latest(t(spark, d, "events").select("event_type", "event_id", "user_id", "ts"), "event_type", F.struct("ts", "event_id")).select("event_type", "event_id", "user_id")


@query("WITH s AS (SELECT x AS slot FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) AS r(x)) SELECT CAST(slot AS VARCHAR) AS slot FROM s WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'signup' AND date_trunc('hour', ts) = slot)")
def missed_slots(spark, d):
    slots = spark.range(30 * 24).select(F.timestamp_seconds(c("id") * 3600 + 1704067200).alias("slot"))
    return series.missed(slots, t(spark, d, "events").where("event_type = 'signup'"), "slot", "ts").select(F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"))


@query("WITH m AS (SELECT event_type, max(ts) AS top FROM events GROUP BY 1), u AS (SELECT event_type, user_id, max(ts) AS seen FROM events GROUP BY 1, 2) SELECT event_type, CASE WHEN seen >= top - INTERVAL 7 DAY THEN 'current' ELSE 'stale' END AS currency, count(*) AS n FROM u JOIN m USING (event_type) GROUP BY 1, 2")
def currency(spark, d):
    e = t(spark, d, "events")
    seen = e.groupBy("event_type", "user_id").agg(F.max("ts").alias("seen"))
    top = e.groupBy("event_type").agg(F.max("ts").alias("top"))
    return seen.join(top, "event_type").groupBy("event_type", F.when(c("seen") >= c("top") - F.expr("interval 7 days"), "current").otherwise("stale").alias("currency")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 720 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(k AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2")
def sessions(spark, d):
    return series.sessions(t(spark, d, "events"), "user_id", "ts", 720).select("user_id", "session", "n")


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'std' WHEN starts_with(p_type, 'SMALL') THEN 'small' WHEN starts_with(p_type, 'S') THEN 's' ELSE 'other' END AS owner FROM part")
def prefix_attribution(spark, d):
    return t(spark, d, "part").select("p_partkey", lookup.by_prefix(c("p_type"), [("STANDARD", "std"), ("SMALL", "small"), ("S", "s")], "other").alias("owner"))


@query("WITH k AS (SELECT lower(trim(p_name)) AS k, min(p_partkey) AS p FROM part GROUP BY 1 HAVING min(p_partkey) = max(p_partkey)) SELECT p_partkey, p AS resolved FROM part LEFT JOIN k ON k = lower(trim(p_name))")
def unique_key_join(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("name"))
    m = lookup.unique_map(p, c("name"), "p_partkey").withColumnRenamed("p_partkey", "resolved")
    return p.join(m, p["name"] == m["key"], "left").select("p_partkey", "resolved")


@query("""WITH a AS (SELECT c_custkey % 7 AS k, min(c_custkey) AS v FROM customer WHERE c_custkey % 7 < 3 GROUP BY 1), b AS (SELECT c_nationkey AS k, min(c_custkey) AS v FROM customer GROUP BY 1 HAVING count(*) > 5)
SELECT s_suppkey, coalesce(a.v, b.v) AS resolved, CASE WHEN a.v IS NOT NULL THEN 'name' WHEN b.v IS NOT NULL THEN 'nation' END AS resolved_tier FROM supplier LEFT JOIN a ON a.k = s_suppkey % 7 LEFT JOIN b ON b.k = s_nationkey""")
def two_tier_resolve(spark, d):
    cu = t(spark, d, "customer")
    a = cu.where("c_custkey % 7 < 3").groupBy((c("c_custkey") % 7).alias("key")).agg(F.min("c_custkey").alias("v"))
    b = cu.groupBy(c("c_nationkey").alias("key")).agg(F.min("c_custkey").alias("v"), F.count("*").alias("n")).where("n > 5")
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return lookup.tiered(s, [("name", c("s_suppkey") % 7, a, "v"), ("nation", c("s_nationkey"), b, "v")], "resolved").drop("s_nationkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_new_ids(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey IN (3, 6, 9)")
def semi_known_ids(spark, d):
    known = t(spark, d, "orders").select(c("o_custkey").alias("k")).unionByName(spark.createDataFrame([(3,), (6,), (9,)], "k long"))
    return t(spark, d, "customer").join(known, c("c_custkey") == c("k"), "left_semi").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def dedupe_keep_first(spark, d):
    return lookup.keep_first(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], c("l_shipdate"), c("l_linenumber")).drop("l_shipdate")


@query("WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, length(o_orderpriority), o_orderpriority) AS r FROM n) WHERE r = 1")
def mode_tiebreak(spark, d):
    return lookup.commonest(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("""WITH x AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS sources, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem GROUP BY 1)
SELECT l_partkey, sources, days, CASE WHEN sources >= 2 THEN 'learned' WHEN days >= 2 THEN 'single_source' ELSE 'insufficient' END AS status FROM x""")
def independent_sources(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("sources"), F.countDistinct(c("l_shipdate").cast("date")).alias("days"))
    return x.withColumn("status", quality.first_reason([("learned", c("sources") >= 2), ("single_source", c("days") >= 2)], "insufficient"))


@query("WITH p AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS link, lower(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ \\t\\r\\n]+', ' ', 'g'))) AS t FROM pages) SELECT link, count(DISTINCT t) AS titles FROM p WHERE link <> '' GROUP BY 1 HAVING count(DISTINCT t) >= 3")
def shared_links(spark, d):
    return quality.shared_links(t(spark, d, "pages"), urls.host(c("url")), pages.title_of(c("html")))


@query("""WITH p AS (SELECT page_id, trim(coalesce(url, '')) AS u FROM pages), q AS (SELECT *, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\\?([^#]*)', 1) AS qs FROM p)
SELECT page_id, host, CASE WHEN u = '' THEN 'missing' WHEN regexp_matches(u, '\\s') OR NOT regexp_matches(u, '(?i)^https?://') OR NOT contains(host, '.') THEN 'malformed' WHEN regexp_matches(path, '(?i)^/?(index\\.(html?|php|aspx?)|home/?|en/?)?$') AND qs = '' THEN 'homepage' ELSE 'specific' END AS link_class FROM q""")
def link_class(spark, d):
    return t(spark, d, "pages").select("page_id", urls.host(c("url")).alias("host"), urls.link_class(c("url")).alias("link_class"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ \\t\\r\\n]+', ' ', 'g')) AS title FROM pages")
def html_title_meta(spark, d):
    return t(spark, d, "pages").select("page_id", pages.title_of(c("html")).alias("title"))


@query("WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages) SELECT page_id, CAST(i - 1 AS INT) AS at, h[i] AS href FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM l)")
def html_links(spark, d):
    return pages.links(t(spark, d, "pages"), "page_id", "html").select("page_id", "at", "href")


_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_REFS = " ".join(f"WHEN '&{k};' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in text._NAMED.items())
_DECODED = rf"""array_to_string(list_transform(regexp_extract_all(html, '&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,9}});|[^&]+|&'), lambda p: CASE
  WHEN regexp_matches(p, '^&#[0-9]+;$') AND CAST(regexp_extract(p, '([0-9]+)', 1) AS INT) BETWEEN 1 AND 1114111 THEN chr(CAST(regexp_extract(p, '([0-9]+)', 1) AS INT))
  WHEN regexp_matches(p, '^&#[xX][0-9a-fA-F]+;$') THEN chr(CAST('0x' || regexp_extract(p, '([0-9a-fA-F]+);$', 1) AS INT)) ELSE CASE p {_REFS} ELSE p END END), '')"""


@query(rf"""WITH a AS (SELECT page_id, html, {_DECODED} AS x FROM pages),
b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(x, '(?is)<script(?:[^A-Za-z0-9_].*?)??</script{_WS}*>|<style(?:[^A-Za-z0-9_].*?)??</style{_WS}*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:{text._HTML_TAGS})(?:(?:{_WS}|/)[^<>]*)?>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, html, regexp_replace(regexp_replace(x, '{text._CSS.replace('WS', _WS)}', ' ', 'g'), '[ 	\x{{00A0}}]+', ' ', 'g') AS x FROM b),
d AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(x, ' *
 *', chr(10), 'g'), '
{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+\z', '', 'g') AS x FROM c)
SELECT page_id, md5(CASE WHEN x = '' THEN html ELSE x END) AS digest FROM d""")
def html_to_text(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(text.sanitized(c("html")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key FROM documents")
def title_normalize(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.plain(c("text")).cast("binary")).alias("key"))


@query("""WITH b AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM conversations)
SELECT x.conv_id, x.turn, CAST(floor(1000.0 * len(list_intersect(x.w, y.w)) / nullif(len(list_distinct(list_concat(x.w, y.w))), 0)) AS BIGINT) AS per_mille FROM b x JOIN b y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1""")
def token_jaccard(spark, d):
    b = t(spark, d, "conversations").select("conv_id", "turn", text.tokens(c("text")).alias("w"))
    after = b.select("conv_id", (c("turn") - 1).alias("turn"), c("w").alias("next"))
    shared, every = F.size(F.array_intersect("w", "next")), F.size(F.array_union("w", "next"))
    return b.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.floor(F.try_divide(F.lit(1000.0) * shared, every)).cast("long").alias("per_mille"))


@query("WITH k AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS k FROM documents), g AS (SELECT k, min(doc_id) AS first_id, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, first_id, n FROM k JOIN g USING (k)")
def exact_duplicates(spark, d):
    k = t(spark, d, "documents").select("doc_id", F.md5(text.plain(c("text")).cast("binary")).alias("k"))
    g = k.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return k.join(g, "k").select("doc_id", "first_id", "n")


@query("WITH k AS (SELECT doc_id, source, n_chars, md5(text) AS k FROM documents), r AS (SELECT *, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER (PARTITION BY k ORDER BY source = 'src0' DESC, n_chars DESC, doc_id) AS rank FROM k) SELECT doc_id, group_size, CAST(rank AS INT) AS rank FROM r")
def survivor_pick(spark, d):
    k = t(spark, d, "documents").select("doc_id", "source", "n_chars", F.md5(c("text").cast("binary")).alias("k"))
    return duplicates.survivors(k, ["k"], [F.desc(c("source") == "src0"), F.desc("n_chars"), c("doc_id")]).select("doc_id", "group_size", "rank")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS code FROM lineitem)
SELECT code, count(*) AS n, CASE code WHEN 'large' THEN 'advisory' WHEN 'discount' THEN 'needs_decision' ELSE 'blocked' END AS state FROM f GROUP BY 1""")
def integrity_summary(spark, d):
    rules = [("large", "advisory", c("l_quantity") > 45), ("discount", "needs_decision", c("l_discount") > 0.09), ("returned", "blocked", c("l_returnflag") == "R")]
    x = t(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), quality.codes(rules).alias("found"))
    return quality.summary(x, "found", "id").drop("samples")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'blocked' WHEN l_discount > 0.09 THEN 'needs_decision' WHEN l_quantity > 45 THEN 'advisory' ELSE 'cleared' END AS state FROM lineitem""")
def integrity_codes(spark, d):
    rules = [("large", "advisory", c("l_quantity") > 45), ("discount", "needs_decision", c("l_discount") > 0.09), ("returned", "blocked", c("l_returnflag") == "R")]
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quality.worst(quality.codes(rules)).alias("state"))


@query("""WITH f AS (SELECT o_custkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'import' WHEN o_orderstatus = 'O' THEN 'published' ELSE 'audit' END AS stage, o_orderpriority AS code FROM orders),
r AS (SELECT *, CASE stage WHEN 'import' THEN 1 WHEN 'published' THEN 2 ELSE 3 END AS r FROM f)
SELECT key, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages, arg_max(code, lpad(CAST(r AS VARCHAR), 2, '0') || code) AS code, count(*) AS n FROM r GROUP BY 1""")
def findings_queue(spark, d):
    f = t(spark, d, "orders").select(c("o_custkey").alias("key"), F.when(c("o_orderstatus") == "F", "import").when(c("o_orderstatus") == "O", "published").otherwise("audit").alias("stage"), c("o_orderpriority").alias("code"))
    return quality.queue(f, ["import", "published", "audit"])


@query("""WITH x AS (SELECT 'price' AS check, CASE WHEN o_totalprice > 200000 THEN 'fail' WHEN o_totalprice > 100000 THEN 'review' ELSE 'pass' END AS o FROM orders UNION ALL SELECT 'status', CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'unchecked' ELSE 'review' END FROM orders)
SELECT "check", count(*) FILTER (WHERE o = 'pass') AS pass, count(*) FILTER (WHERE o = 'unchecked') AS unchecked, count(*) FILTER (WHERE o = 'review') AS review, count(*) FILTER (WHERE o = 'fail') AS fail FROM x GROUP BY 1""".replace("AS check,", 'AS "check",'))
def coverage_matrix(spark, d):
    p = c("o_totalprice")
    s = c("o_orderstatus")
    return quality.coverage(t(spark, d, "orders"), {"price": F.when(p > 200000, "fail").when(p > 100000, "review").otherwise("pass"), "status": F.when(s == "F", "pass").when(s == "O", "unchecked").otherwise("review")})


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'skip' WHEN o_totalprice > 300000 THEN 'reject' WHEN o_orderpriority = '1-URGENT' THEN 'hold' ELSE 'publish' END AS decision, count(*) AS n FROM orders GROUP BY 1")
def gate_decision(spark, d):
    g = quality.gate(c("o_orderstatus") == "P", c("o_totalprice") > 300000, c("o_orderpriority") == "1-URGENT")
    return t(spark, d, "orders").groupBy(g.alias("decision")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT * FROM (VALUES (1, 'A', 1.5, true), (2, 'B', NULL, false), (100000001, 'N', 7.0, true)) AS v(k, name, bal, has_bal))
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL AND c_custkey IS DISTINCT FROM 2 THEN name ELSE c_name END AS c_name, CASE WHEN has_bal THEN bal ELSE c_acctbal END AS c_acctbal FROM customer FULL JOIN p ON k = c_custkey""")
def upsert_merge(spark, d):
    stored = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").withColumn("locked", F.when(c("c_custkey") == 2, F.array(F.lit("c_name"))))
    patch = spark.createDataFrame([(1, "A", 1.5, ["c_name", "c_acctbal"]), (2, "B", None, ["c_name"]), (100000001, "N", 7.0, ["c_name", "c_acctbal"])], "c_custkey long, c_name string, c_acctbal double, present array<string>")
    return merge.upsert(stored, patch, "c_custkey", "locked").drop("locked")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND false")
def withdraw_capped(spark, d):
    cu = t(spark, d, "customer").select("c_custkey")
    few = merge.withdraw(cu, cu.where("c_custkey % 10 <> 0"), "c_custkey")
    return few.unionByName(merge.withdraw(cu, cu.where("c_custkey % 3 <> 0"), "c_custkey"))  # a third is refused


@query(f"""WITH {EV}, x AS (SELECT id, start_date + CAST(id % 5 - 2 AS INT) AS s, start_date + CAST(id % 9 AS INT) AS e, start_date, last_date, semantics, has_dates, id % 20 = 0 AS complete FROM es),
y AS (SELECT *, greatest(s, e) AS l, semantics = 'recurring' AND has_dates AS known, semantics = 'continuous' AS held FROM x),
z AS (SELECT *, coalesce(known AND complete AND l > start_date + 14, false) AS clip, CASE WHEN known OR held THEN least(s, start_date) ELSE s END AS lo FROM y),
w AS (SELECT *, CASE WHEN clip THEN start_date + 14 WHEN known THEN greatest(l, start_date + 14) WHEN held THEN greatest(l, last_date) ELSE l END AS hi FROM z)
SELECT id, CAST(lo AS VARCHAR) AS range_start, CAST(CASE WHEN hi > lo THEN hi END AS VARCHAR) AS range_end, CASE WHEN clip THEN 'clipped-to-evidence' WHEN known AND (lo <> s OR hi <> l) THEN 'widened-to-evidence' WHEN held AND (lo <> s OR hi <> l) THEN 'held-existing' ELSE 'incoming' END AS action FROM w""")
def range_preserve(spark, d):
    e = listing(spark, d)
    k = c("id")
    r = merge.preserve_range(F.date_add("start_date", (k % 5 - 2).cast("int")), F.date_add("start_date", (k % 9).cast("int")), c("start_date"), c("end_date"), c("semantics"), c("occurrence_dates"), k % 20 == 0)
    return e.select("id", r.alias("r")).select("id", c("r.start").cast("string").alias("range_start"), c("r.end").cast("string").alias("range_end"), c("r.action").alias("action"))


@query("WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(x, lambda q: trim(q) <> '' AND NOT starts_with(q, 'The')), chr(10)) AS note FROM l")
def note_lines(spark, d):
    x = F.filter(F.split("text", "\n"), lambda q: (F.trim(q) != "") & ~F.startswith(q, F.lit("The")))
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(x, "\n").alias("note"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def conversation_carry(spark, d):
    return series.carry(t(spark, d, "conversations").select("conv_id", "turn", "role").distinct(), "conv_id", "turn", F.when(c("role") == "user", c("turn")), "asked").drop("role")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 150000) AS large FROM orders GROUP BY 1")
def count_filter(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("finished"), F.count_if(c("o_totalprice") > 150000).alias("large"))


@query("SELECT o_orderpriority, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def rn_samples(spark, d):
    return series.samples(t(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority", [F.desc("o_totalprice"), c("o_orderkey")]).drop("o_totalprice")


@query("SELECT 'regions' AS name, count(*) = 5 AS ok FROM region UNION ALL SELECT 'nations', count(*) = count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'orphans', count(*) = 0 FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)")
def union_checks(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return (
        r.agg(F.lit("regions").alias("name"), (F.count("*") == 5).alias("ok"))
        .unionByName(n.agg(F.lit("nations").alias("name"), (F.count("*") == F.countDistinct("n_nationkey")).alias("ok")))
        .unionByName(n.join(r, c("n_regionkey") == c("r_regionkey"), "left_anti").agg(F.lit("orphans").alias("name"), (F.count("*") == 0).alias("ok")))
    )


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT k, 'new' AS side FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'gone' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def set_delta(spark, d):
    o = t(spark, d, "orders")
    a, b = (o.where(c("o_orderstatus") == s).select(c("o_custkey").alias("k")).distinct() for s in "FO")
    return b.exceptAll(a).withColumn("side", F.lit("new")).unionByName(a.exceptAll(b).withColumn("side", F.lit("gone")))


@query("SELECT coalesce(source, 'ALL') AS source, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS long FROM documents GROUP BY GROUPING SETS ((), (source))")
def total_and_by_source(spark, d):
    return t(spark, d, "documents").rollup("source").agg(F.count("*").alias("n"), F.count_if(c("n_chars") > 2000).alias("long")).withColumn("source", F.coalesce("source", F.lit("ALL")))


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS l FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY l IS NOT NULL, l, c_custkey LIMIT 25")
def topk_due(spark, d):
    last = t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("l"))
    return t(spark, d, "customer").join(last, c("o_custkey") == c("c_custkey"), "left").orderBy(c("l").asc_nulls_first(), "c_custkey").limit(25).select("c_custkey")


@query("SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey % 5 END ASC NULLS LAST, n_nationkey) AS INT) AS rank FROM nation")
def nulls_last_sort(spark, d):
    k = F.when(c("n_nationkey") % 4 != 0, c("n_nationkey") % 5)
    return t(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(k.asc_nulls_last(), "n_nationkey")).alias("rank"))  # 25 rows


@query("SELECT n_nationkey, md5(concat_ws('|', n_name, CAST(n_regionkey AS VARCHAR), CASE WHEN n_nationkey % 2 = 0 THEN 'x' END)) AS fingerprint FROM nation")
def fingerprint(spark, d):
    return t(spark, d, "nation").select("n_nationkey", F.md5(F.concat_ws("|", "n_name", c("n_regionkey").cast("string"), F.when(c("n_nationkey") % 2 == 0, "x")).cast("binary")).alias("fingerprint"))


_SQUARE = [(-1.0, -1.0), (11.0, -1.0), (11.0, 8.0), (-1.0, 8.0), (-1.0, -1.0)]
_HOLE = [(3.0, 2.0), (6.0, 2.0), (6.0, 5.0), (3.0, 5.0), (3.0, 2.0)]


@query("SELECT s_suppkey, (s_suppkey % 17 - 2) + 0.5 BETWEEN -1 AND 11 AND (s_nationkey % 12 - 2) + 0.5 BETWEEN -1 AND 8 AND NOT ((s_suppkey % 17 - 2) + 0.5 BETWEEN 3 AND 6 AND (s_nationkey % 12 - 2) + 0.5 BETWEEN 2 AND 5) AS inside FROM supplier")
def point_in_polygon(spark, d):
    x, y = (c("s_suppkey") % 17 - 2 + 0.5).cast("double"), (c("s_nationkey") % 12 - 2 + 0.5).cast("double")
    return t(spark, d, "supplier").select("s_suppkey", geo.in_polygon(x, y, [_SQUARE, _HOLE]).alias("inside"))


@query("SELECT p_partkey, lower(replace(p_type, ' ', '.')) AS path, starts_with(lower(replace(p_type, ' ', '.')), 'standard.') OR lower(p_type) = 'standard' AS hit FROM part")
def event_path_taxonomy(spark, d):
    p = t(spark, d, "part").withColumn("category", F.lower(F.replace("p_type", F.lit(" "), F.lit("."))))
    return p.select("p_partkey", c("category").alias("path"), discovery.what(State(categories=("standard",)), {}).alias("hit"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN p_size > 25 THEN 'big' END, CASE WHEN p_retailprice < 1000 THEN 'cheap' END, CASE WHEN contains(p_type, 'BRASS') THEN 'brass' END], lambda x: x IS NOT NULL)), ',') AS features FROM part")
def features_of(spark, d):
    f = F.array_compact(F.array(F.when(c("p_size") > 25, "big"), F.when(c("p_retailprice") < 1000, "cheap"), F.when(F.contains("p_type", F.lit("BRASS")), "brass")))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(f), ",").alias("features"))


@query("WITH x AS (SELECT CASE WHEN o_totalprice <= 0 THEN 'no_price' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'eligible' END AS reason FROM orders) SELECT reason, count(*) AS n FROM x GROUP BY 1")
def reason_funnel(spark, d):
    r = quality.first_reason([("no_price", c("o_totalprice") <= 0), ("pending", c("o_orderstatus") == "P"), ("low", c("o_orderpriority") == "5-LOW")])
    return t(spark, d, "orders").groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(datediff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 3")
def near_date_pairs(spark, d):
    a = t(spark, d, "orders").select("o_custkey", "o_orderkey", c("o_orderdate").cast("date").alias("day"))
    b = a.select("o_custkey", c("o_orderkey").alias("other"), c("day").alias("other_day"))
    return lookup.near_dates(a, b, "day", "other_day", 3, by=("o_custkey",)).where("o_orderkey < other").select("o_orderkey", "other")


@query("""WITH w AS (SELECT doc_id, lang, source, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM documents),
f AS (SELECT * FROM w WHERE len(w) >= 20) SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.w, y.w)) AS shared FROM f x JOIN f y ON x.lang = y.lang AND x.source = y.source AND x.doc_id < y.doc_id
WHERE len(list_intersect(x.w, y.w)) >= 20 AND len(list_intersect(x.w, y.w)) >= 0.85 * least(len(x.w), len(y.w))""")
def containment_pairs(spark, d):
    return duplicates.all_contained_pairs(t(spark, d, "documents"), ["lang", "source"], "doc_id", "text")


@query()
def consolidation_plan(spark, d):
    e = listing(spark, d).select("id", text.title_key(F.concat_ws(" ", "source", "category"), c("start_date")).alias("title_key"), "start_date", c("city").alias("place"), "source", duplicates.start_time(c("time")).alias("clock"), "end_date", "all_day")
    return duplicates.decisions(e, [c("id")])


@query("""WITH k AS (SELECT DISTINCT o_orderkey % 6 AS k FROM orders), t AS (SELECT CASE k WHEN 0 THEN '7:00 PM - 9:30 PM' WHEN 1 THEN 'noon' WHEN 2 THEN '10:30 AM - 7:15 PM' END AS time, CASE k WHEN 0 THEN 1140 WHEN 1 THEN 720 WHEN 2 THEN 630 END AS start, CASE k WHEN 0 THEN 1290 WHEN 2 THEN 1155 END AS "end" FROM k)
SELECT DISTINCT time, start, "end", coalesce(start >= 1020, false) AS evening, coalesce("end" < 1200, false) AS ended FROM t""")
def duplicate_time_ranges(spark, d):
    r = D.time_range(c("time"))
    return listing(spark, d).groupBy("time").agg(F.min(r["start"]).alias("start"), F.min(r["end"]).alias("end"), F.bool_or(D.evening(c("time"))).alias("evening"), F.bool_or(D.ended(c("time"), F.lit(CLOCK))).alias("ended"))


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    from .streaming.batches import counts

    return counts(t(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: CASE WHEN regexp_matches(w, '[AEIOUY]') THEN w[1] || lower(w[2:]) ELSE w END), ' ') AS title, 'all_caps_to_title_case' AS reason FROM part""")
def title_case(spark, d):
    return t(spark, d, "part").select("p_partkey", titles.title_case(F.upper("p_name")).alias("x")).select("p_partkey", "x.title", "x.reason")


@query("""SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS number, CASE WHEN c_custkey % 3 <> 0 THEN 'w' END AS dir, lower(c_mktsegment) AS name, 'st' AS type,
c_custkey || CASE WHEN c_custkey % 3 <> 0 THEN ' W. ' ELSE ' ' END || c_mktsegment || ' Street #' || c_nationkey AS street, translate(n_name, '0123456789_', 'abcdefghij ') AS city, 'MI' AS state, CASE WHEN c_custkey % 2 = 0 THEN '48201' ELSE '' END AS zip FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def address_parts(spark, d):
    cu = t(spark, d, "customer").join(t(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    line = F.concat(c("c_custkey").cast("string"), F.when(c("c_custkey") % 3 != 0, " W. ").otherwise(" "), "c_mktsegment", F.lit(" Street #"), c("c_nationkey").cast("string"))
    city = F.translate("n_name", "0123456789_", "abcdefghij ")  # a part with a digit is no city
    whole = F.concat_ws(", ", line, city, F.when(c("c_custkey") % 2 == 0, "MI 48201").otherwise("MI"))
    x = cu.select("c_custkey", addresses.street(whole).alias("s"), addresses.address(whole).alias("a"))
    return x.select("c_custkey", "s.number", "s.dir", "s.name", "s.type", "a.street", "a.city", "a.state", "a.zip")


@query("""WITH a AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS hay, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS published FROM documents),
e AS (SELECT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS title, DATE '2024-01-01' + CAST(item_id % 60 AS INT) AS day FROM benchmark),
f AS (SELECT *, array_to_string(string_split(title, ' ')[1:2], ' ') AS venue FROM e),
m AS (SELECT doc_id AS article_id, item_id AS event_id, abs(datediff('day', published, day)) AS gap, length(title) >= 6 AND contains(hay, title) AS by_title, length(venue) >= 6 AND contains(hay, venue) AS by_venue FROM a JOIN f ON contains(hay, venue)),
r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY by_title DESC, gap, event_id) AS n FROM m WHERE by_title OR (by_venue AND gap <= 21))
SELECT article_id, event_id, CASE WHEN by_title THEN 'title' ELSE 'venue_date' END AS match_type, CAST(gap AS INT) AS day_gap FROM r WHERE n = 1""")
def article_match(spark, d):
    first = F.lit(date(2024, 1, 1))
    a = t(spark, d, "documents").select(c("doc_id").alias("article_id"), "text", F.date_add(first, (c("doc_id") % 60).cast("int")).alias("published"))
    e = t(spark, d, "benchmark").select(c("item_id").alias("event_id"), c("text").alias("title"), F.array_join(F.slice(F.split(text.plain(c("text")), " "), 1, 2), " ").alias("venue"), F.date_add(first, (c("item_id") % 60).cast("int")).alias("start_date"))
    return articles.match(a, e, TODAY)


QUERIES |= cases.QUERIES | jobs.QUERIES | readings.QUERIES
ORACLE |= cases.ORACLE | jobs.ORACLE | readings.ORACLE
