"""Queries of the operators that work on whole tables: health of sources, pairs, identities, repairs, counts; with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import health, pairs, repair, venues
from .plans import paging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col
NOW = datetime(2024, 1, 30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# runs of sources: the events table, every event a run; three users' events leave a run open
_OUT = "CASE event_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'started' WHEN 3 THEN 'blocked' ELSE 'success' END"
_RUNS = f"""r AS (SELECT event_type || (user_id % 7) AS slug, event_id AS run_id, ts AS started_at, {_OUT} AS outcome, CASE WHEN event_id % 11 <> 2 THEN ts + INTERVAL 1 MINUTE END AS finished_at,
  CASE WHEN event_id % 13 <> 5 THEN event_id % 3 * 10 END AS fetched, CASE WHEN event_id % 4 = 0 THEN event_id % 3 * 9 END AS parsed, CASE WHEN event_id % 3 > 0 THEN event_id % 5 * 4 ELSE 0 END AS written FROM events)"""


def _runs(spark, d):
    e = t(spark, d, "events")
    k, ts = c("event_id"), c("ts").cast("timestamp")
    outcome = F.when(k % 11 == 0, "failed").when(k % 11 == 1, "partial").when(k % 11 == 2, "started").when(k % 11 == 3, "blocked").otherwise("success")
    return e.select(
        F.concat("event_type", (c("user_id") % 7).cast("string")).alias("slug"), k.alias("run_id"), ts.alias("started_at"), outcome.alias("outcome"), F.when(k % 11 != 2, ts + F.expr("INTERVAL 1 MINUTE")).alias("finished_at"),
        F.when(k % 13 != 5, k % 3 * 10).alias("fetched"), F.when(k % 4 == 0, k % 3 * 9).alias("parsed"), F.when(k % 3 > 0, k % 5 * 4).otherwise(0).alias("written"),
    )


@query(f"""WITH {_RUNS}, s AS (SELECT DISTINCT slug, CASE WHEN slug LIKE '%6' THEN NULL WHEN slug LIKE '%5' THEN 1 ELSE 24 END AS cadence FROM r UNION ALL SELECT 'never', 24),
d AS (SELECT * FROM r WHERE finished_at IS NOT NULL AND outcome <> 'started'), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY started_at DESC, run_id DESC) AS k FROM r),
dn AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY started_at DESC, run_id DESC) AS k FROM d),
l AS (SELECT * FROM n WHERE k = 1), e AS (SELECT * FROM dn WHERE k = 1), a AS (SELECT slug, count(*) AS runs FROM r GROUP BY 1),
x AS (SELECT slug, max(CASE WHEN outcome IN ('success', 'partial') THEN started_at END) AS last_success, max(CASE WHEN coalesce(fetched, written) > 0 THEN started_at END) AS last_retrieving FROM d GROUP BY 1),
zf AS (SELECT slug, coalesce(min(CASE WHEN coalesce(fetched, -1) <> 0 THEN k END), max(k) + 1) - 1 AS zf, coalesce(min(CASE WHEN NOT (written = 0 AND coalesce(fetched, -1) <> 0) THEN k END), max(k) + 1) - 1 AS zw FROM dn GROUP BY 1),
g AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY started_at DESC, run_id DESC) AS q FROM d WHERE outcome IN ('success', 'partial')),
v AS (SELECT slug, max(CASE WHEN q = 1 THEN started_at END) AS good, count(CASE WHEN q <= 8 THEN 1 END) AS ng, max(CASE WHEN q = 1 THEN fetched END) AS nf, max(CASE WHEN q = 1 THEN written END) AS nw,
  quantile_cont(CASE WHEN q BETWEEN 2 AND 8 THEN fetched END, 0.5) AS bf, quantile_cont(CASE WHEN q BETWEEN 2 AND 8 THEN written END, 0.5) AS bw FROM g GROUP BY 1),
h AS (SELECT slug, count(*) AS examined, count(*) FILTER (outcome = 'started' AND finished_at IS NULL AND epoch(TIMESTAMP '{NOW}') - epoch(started_at) > 900) AS aband, count(*) FILTER (outcome IN ('failed', 'blocked')) AS failed FROM n WHERE k BETWEEN 2 AND 15 GROUP BY 1),
ev AS (SELECT o_orderkey, (SELECT min(slug) FROM s) AS none, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending_review' END AS status, TIMESTAMP '2024-01-29' - CAST(o_orderkey % 40 AS INT) * INTERVAL 1 HOUR AS seen, o_orderkey % (SELECT count(*) FROM s) AS j FROM orders),
so AS (SELECT *, row_number() OVER (ORDER BY slug) - 1 AS j FROM s),
cu AS (SELECT s.slug, s.cadence, CASE WHEN cadence IS NULL THEN NULL WHEN last_retrieving IS NOT NULL THEN last_retrieving - INTERVAL 1 HOUR WHEN runs IS NULL THEN TIMESTAMP '{NOW}' - CAST(2 * cadence + 6 AS INT) * INTERVAL 1 HOUR END AS cutoff FROM s LEFT JOIN x USING (slug) LEFT JOIN a USING (slug)),
ec AS (SELECT so.slug, count(*) FILTER (status = 'approved') AS pub, count(*) FILTER (status = 'pending_review') AS pend, count(*) FILTER (status = 'approved' AND seen >= cutoff) AS cur, count(*) FILTER (status = 'approved' AND seen < cutoff) AS stale FROM ev JOIN so USING (j) JOIN cu ON cu.slug = so.slug GROUP BY 1)
SELECT s.slug, coalesce(runs, 0) AS runs, l.outcome AS last_outcome, e.fetched AS last_fetched, e.written AS last_written, coalesce(zf, 0) AS zero_fetch_streak, coalesce(zw, 0) AS zero_write_streak, coalesce(pub, 0) AS upcoming_public,
  coalesce(pend, 0) AS upcoming_pending, cur / nullif(CAST(cur + stale AS DOUBLE), 0) AS reseen_share,
  coalesce(e.started_at = good AND ng >= 3 AND abs(nf - bf) >= 5 AND CASE WHEN bf = 0 THEN nf > 0 ELSE abs(nf - bf) > 0.5 * bf END, false) OR coalesce(e.started_at = good AND ng >= 3 AND abs(nw - bw) >= 5 AND CASE WHEN bw = 0 THEN nw > 0 ELSE abs(nw - bw) > 0.5 * bw END, false) AS volume_deviates,
  coalesce(examined, 0) AS runs_examined, coalesce(aband, 0) AS abandoned_earlier, coalesce(failed, 0) AS failed_earlier, strftime(x.last_success, '%Y-%m-%d %H:%M:%S') AS last_success_at, strftime(x.last_retrieving, '%Y-%m-%d %H:%M:%S') AS last_retrieving_at,
  CASE WHEN l.slug IS NULL THEN 'unknown' WHEN (l.outcome = 'started' AND l.finished_at IS NULL AND epoch(TIMESTAMP '{NOW}') - epoch(l.started_at) > 900) OR coalesce(e.outcome IN ('failed', 'blocked'), false) THEN 'fail' WHEN e.slug IS NOT NULL THEN 'ok' ELSE 'unknown' END AS execution,
  CASE WHEN e.fetched IS NULL THEN 'unknown' WHEN e.fetched > 0 THEN 'ok' ELSE 'fail' END AS retrieval, CASE WHEN s.cadence IS NULL OR coalesce(cur + stale, 0) < 1 THEN 'unknown' WHEN cur + stale >= 3 AND cur / (cur + stale) < 0.5 THEN 'fail' ELSE 'ok' END AS currency
FROM s LEFT JOIN a USING (slug) LEFT JOIN l ON l.slug = s.slug LEFT JOIN e ON e.slug = s.slug LEFT JOIN x ON x.slug = s.slug LEFT JOIN zf ON zf.slug = s.slug LEFT JOIN v ON v.slug = s.slug LEFT JOIN h ON h.slug = s.slug LEFT JOIN ec ON ec.slug = s.slug""")
def source_health(spark, d):
    runs = _runs(spark, d)
    never = spark.createDataFrame([("never",)], "slug string")
    names = runs.select("slug").distinct().union(never)
    sources = names.withColumn("cadence_hours", F.when(c("slug").endswith("6"), None).when(c("slug").endswith("5"), 1).otherwise(24))
    ordered = [r["slug"] for r in names.orderBy("slug").collect()]  # the sources of the test data: a few dozen
    at = F.element_at(F.array(*(F.lit(s) for s in ordered)), (c("o_orderkey") % len(ordered) + 1).cast("int"))
    seen = F.timestamp_add("HOUR", -(c("o_orderkey") % 40), F.lit(datetime(2024, 1, 29)).cast("timestamp"))
    events = t(spark, d, "orders").select(at.alias("slug"), F.when(c("o_orderstatus") == "F", "approved").otherwise("pending_review").alias("status"), seen.alias("seen_at"))
    m = health.measures(sources, runs, events, F.lit(NOW).cast("timestamp"))
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return m.select(
        "slug", "runs", "last_outcome", "last_fetched", "last_written", "zero_fetch_streak", "zero_write_streak", "upcoming_public", "upcoming_pending", "reseen_share", "volume_deviates", "runs_examined", "abandoned_earlier", "failed_earlier",
        stamp("last_success_at").alias("last_success_at"), stamp("last_retrieving_at").alias("last_retrieving_at"), "execution", "retrieval", "currency",
    )


# listings: orders of the same day at places that follow from the customer
_ROWS = """o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 6 = 0 THEN o_custkey % 5 END AS venue_id, 'Hall ' || (o_custkey % 4) AS venue, 'City ' || (o_custkey % 3) AS city, CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 7) || ' Main St' END AS address,
  CASE o_orderkey % 4 WHEN 0 THEN '7:00 PM' WHEN 1 THEN '8 PM' WHEN 2 THEN '19:00' END AS tm, o_orderpriority AS source, 'Big ' || o_orderpriority || ' show ' || (o_orderkey % 3) AS title FROM orders),
k AS (SELECT id, day, unnest(list_filter(['0' || venue_id, '1' || lower(city) || '|' || lower(address), '2' || lower(city) || '|' || lower(venue)], lambda x: x IS NOT NULL)) AS k FROM o),
p AS (SELECT x.id AS a, y.id AS b, CAST(min(x.k[1]) AS INT) AS w FROM k x JOIN k y ON x.day = y.day AND x.k = y.k AND x.id < y.id GROUP BY 1, 2),
m AS (SELECT id, CASE tm WHEN '7:00 PM' THEN 1140 WHEN '8 PM' THEN 1200 WHEN '19:00' THEN 1140 END AS s FROM o)"""


def _rows(spark, d):
    k, u = c("o_orderkey"), c("o_custkey")
    return t(spark, d, "orders").select(
        k.alias("id"), c("o_orderdate").cast("date").alias("start_date"), F.when(u % 6 == 0, u % 5).alias("venue_id"), F.concat(F.lit("Hall "), (u % 4).cast("string")).alias("venue"), F.concat(F.lit("City "), (u % 3).cast("string")).alias("city"),
        F.when(u % 2 == 0, F.concat((u % 7).cast("string"), F.lit(" Main St"))).alias("address"), F.when(k % 4 == 0, "7:00 PM").when(k % 4 == 1, "8 PM").when(k % 4 == 2, "19:00").alias("time"), F.lit(False).alias("all_day"), c("o_orderpriority").alias("source"),
        F.concat(F.lit("Big "), "o_orderpriority", F.lit(" show "), (k % 3).cast("string")).alias("title"), F.concat(F.lit("https://a.org/"), (u % 4).cast("string")).alias("event_url"), F.lit(None).cast("string").alias("ticket_url"),
    )


@query(f"""WITH {_ROWS} SELECT a, b, CASE WHEN x.s = y.s THEN 'same_venue_same_start_review' ELSE 'same_venue_time_unresolved' END AS kind, ['venue_id', 'same_address_and_city', 'same_name_and_city'][w + 1] AS way
FROM p JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.s = y.s OR x.s IS NULL OR y.s IS NULL""")
def same_place_pairs(spark, d):
    return pairs.same_place(_rows(spark, d))


@query(f"""WITH {_ROWS}, q AS (SELECT id, source, list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1)) AS ws, title FROM o),
j AS (SELECT a, b, u.s AS ta, z.s AS tb, len(list_intersect(f.ws, g.ws)) AS n, least(len(f.ws), len(g.ws)) AS sm, len(f.ws) AS la, len(g.ws) AS lb, lower(f.title) = lower(g.title) AS eq FROM p JOIN m u ON u.id = a JOIN m z ON z.id = b JOIN q f ON f.id = a JOIN q g ON g.id = b WHERE f.source <> g.source),
z AS (SELECT a, b, CASE WHEN ta = tb AND (eq OR (la = lb AND n = la) OR (n >= 2 AND n >= 0.5 * sm)) THEN 'same_start_similar_title' WHEN (ta IS NULL OR tb IS NULL) AND (eq OR (la = lb AND n = la)) THEN 'start_unparsed_identical_title_tokens' END AS basis, round(n / sm, 2) AS overlap FROM j)
SELECT * FROM z WHERE basis IS NOT NULL""")
def cross_source_pairs(spark, d):
    return pairs.cross_source(_rows(spark, d))


@query(f"WITH {_ROWS}, u AS (SELECT o_orderkey AS id, o_custkey % 4 AS u FROM orders) SELECT x.id AS a, y.id AS b FROM o x JOIN o y ON x.day = y.day AND x.id < y.id JOIN m e ON e.id = x.id JOIN m f ON f.id = y.id JOIN u g ON g.id = x.id JOIN u h ON h.id = y.id WHERE e.s = f.s AND g.u = h.u")
def shared_link_pairs(spark, d):
    return pairs.shared_link_pairs(_rows(spark, d))


@query("""WITH c AS (SELECT o_orderkey, 'show ' || o_custkey AS title, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_orderkey AS row, 'The Show ' || o_custkey AS title, CAST(o_orderdate AS DATE) AS day, o_custkey FROM orders),
j AS (SELECT r.row, c.o_orderkey AS card FROM r JOIN c ON r.day = c.day AND c.title = 'show ' || o_custkey), n AS (SELECT *, count(*) OVER (PARTITION BY row) AS a, count(*) OVER (PARTITION BY card) AS b FROM j) SELECT row, card FROM n WHERE a = 1 AND b = 1""")
def listing_cards(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", c("o_orderdate").cast("date").alias("day"))
    rows = o.select(c("o_orderkey").alias("id"), F.concat(F.lit("The Show "), c("o_custkey").cast("string")).alias("title"), c("day").alias("start_date"), F.lit(None).cast("int").alias("minute"))
    cards = o.where("o_orderkey % 2 = 0").select(c("o_orderkey").alias("id"), F.concat(F.lit("Cancelled: show "), c("o_custkey").cast("string")).alias("title"), c("day").alias("date"), F.lit(None).cast("int").alias("minute"))
    return pairs.listing_cards(rows, cards)


@query("SELECT o_orderkey, 'uid-' || left(sha1(CAST(o_orderkey AS VARCHAR)), 12) || '-' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS stable, 'ical-' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '-' || left(md5(o_orderpriority), 10) AS legacy, 'x:' || array_to_string(list_sort([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)]), ':') AS key FROM orders")
def stable_ids(spark, d):
    o = t(spark, d, "orders")
    day = c("o_orderdate").cast("date")
    return o.select("o_orderkey", pairs.stable_id("uid-", c("o_orderkey"), day).alias("stable"), pairs.legacy_id("ical-", day, c("o_orderpriority")).alias("legacy"), pairs.finding_key("x", c("o_orderkey"), c("o_custkey")).alias("key"))


# one calendar a customer: every order an occurrence; stored rows are of four kinds
@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3650 AS INT) AS day, 'T' || o_orderkey AS title, 'uid-' || left(sha1('u' || o_orderkey), 12) || '-' || CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3650 AS INT) AS VARCHAR) AS sid FROM orders),
d AS (SELECT *, count(*) OVER (PARTITION BY day, k % 4 = 2) AS same FROM o), p AS (SELECT day, count(*) FILTER (k % 4 >= 2) AS pend, count(*) FILTER (k % 4 = 2) AS legacy, min(CASE WHEN k % 4 = 2 THEN 'ical-' || CAST(day AS VARCHAR) || '-x' || k END) AS lid FROM o GROUP BY 1)
SELECT sid AS stable_id, CASE WHEN k % 4 = 0 THEN 'keep' WHEN k % 4 = 1 THEN 'adopt' WHEN pend = 1 AND legacy = 1 THEN 'adopt-by-date' ELSE 'new' END AS action,
  CASE WHEN k % 4 = 1 THEN 'ical-' || CAST(o.day AS VARCHAR) || '-' || left(md5(title), 10) WHEN k % 4 >= 2 AND pend = 1 AND legacy = 1 THEN lid END AS adopted FROM o JOIN p USING (day)""")
def identity_plan(spark, d):
    k = c("o_orderkey")
    day = F.date_add(c("o_orderdate").cast("date"), (k % 3650).cast("int"))
    o = t(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("u"), k.cast("string")).alias("uid"), day.alias("day"), day.alias("original_day"), F.concat(F.lit("T"), k.cast("string")).alias("title"))
    sid, legacy = pairs.stable_id("uid-", c("uid"), c("day")), pairs.legacy_id("ical-", c("day"), c("title"))
    unknown = F.concat(F.lit("ical-"), c("day").cast("string"), F.lit("-x"), c("k").cast("string"))
    stored = o.where("k % 4 < 3").select(F.when(c("k") % 4 == 0, sid).when(c("k") % 4 == 1, legacy).otherwise(unknown).alias("external_id"), c("day").alias("start_date"), F.lit("approved").alias("status"))
    return pairs.identity_plan(o.drop("k"), stored)


@query("""WITH s AS (SELECT o_orderkey AS k, 'e' || o_orderkey AS external_id, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'P' AS rejected FROM orders)
SELECT external_id, CASE WHEN k % 10 = 0 THEN 'cancelled-in-feed' ELSE 'missing-from-feed' END AS reason FROM s WHERE k % 10 = 0 OR (k % 3 = 0 AND NOT rejected AND day >= DATE '1997-01-01')""")
def flagged_rows(spark, d):
    s = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("e"), c("o_orderkey").cast("string")).alias("external_id"), c("o_orderdate").cast("date").alias("start_date"), F.when(c("o_orderstatus") == "P", "rejected").otherwise("approved").alias("status"))
    plan = s.where("o_orderkey % 3 <> 0").select(c("external_id").alias("stable_id"), F.lit("keep").alias("action"), F.lit(None).cast("string").alias("adopted"))
    return pairs.flagged(plan, s.where("o_orderkey % 10 = 0"), s, F.lit(date(1997, 1, 1)))


# statements about venues: orders name a hall by customer, in families by priority
@query("""WITH s AS (SELECT 'hall ' || (o_custkey % 40) AS name_key, CASE WHEN o_custkey % 40 < 10 AND o_orderkey % 50 = 0 THEN 'oak' ELSE 'main' || (o_custkey % 40) END AS street_key, (o_custkey % 40) || ' Main' AS address, CASE WHEN o_custkey % 40 IN (3, 4) AND o_orderkey % 50 = 0 THEN 'Novi' ELSE 'Troy' END AS city,
  CASE WHEN o_custkey % 40 < 20 THEN o_orderpriority ELSE '1-URGENT' END AS family, CAST(o_orderdate AS DATE) AS day FROM orders),
f AS (SELECT name_key, family, family = '1-URGENT' AS own, count(DISTINCT day) AS days, family = '5-LOW' AS copies FROM s GROUP BY 1, 2), g AS (SELECT name_key, count(*) AS families, count(*) FILTER (NOT copies) AS agreeing, max(CASE WHEN NOT copies AND own THEN days END) AS own_days FROM f GROUP BY 1),
p AS (SELECT name_key, count(DISTINCT street_key) AS streets, count(DISTINCT city) AS cities, min(address) AS address, min(CASE WHEN city = 'Troy' THEN city END) AS city, min(street_key) AS st FROM s GROUP BY 1),
z AS (SELECT name_key, CASE WHEN name_key IN ('hall 0', 'hall 15') AND (streets > 1 OR cities > 1 OR st <> 'main' || split_part(name_key, ' ', 2)) THEN 'canonical_conflict' WHEN name_key IN ('hall 0', 'hall 15') THEN 'canonical' WHEN cities > 1 THEN 'ambiguous' WHEN streets > 1 THEN 'conflict' WHEN agreeing >= 2 THEN 'learned' WHEN agreeing = 1 AND own_days >= 2 THEN 'learned_first_party' ELSE 'single_source' END AS status, address, city, families FROM p JOIN g USING (name_key))
SELECT name_key, status, CASE WHEN status IN ('learned', 'learned_first_party', 'single_source') THEN address END AS address, CASE WHEN status IN ('learned', 'learned_first_party', 'single_source') THEN city END AS city, families FROM z""")
def venue_knowledge(spark, d):
    h, k = c("o_custkey") % 40, c("o_orderkey")
    odd = (k % 50) == 0
    s = t(spark, d, "orders").select(
        F.concat(F.lit("Hall "), h.cast("string")).alias("name"), F.when((h < 10) & odd, "oak").otherwise(F.concat(F.lit("main"), h.cast("string"))).alias("street_key"), F.concat(h.cast("string"), F.lit(" Main")).alias("address"), F.when(h.isin(3, 4) & odd, "Novi").otherwise("Troy").alias("city"),
        F.when(h < 20, c("o_orderpriority")).otherwise("1-URGENT").alias("family"), (F.when(h < 20, c("o_orderpriority")).otherwise("1-URGENT") == "5-LOW").alias("copies"), (F.when(h < 20, c("o_orderpriority")).otherwise("1-URGENT") == "1-URGENT").alias("first_party"), c("o_orderdate").cast("date").alias("day"),
    )
    canonical = spark.createDataFrame([("Hall 0", "main0", "Troy"), ("hall 15", "main15", "Troy")], "name string, street_key string, city string")
    return venues.learn(s, canonical)


@query("""WITH r AS (SELECT 'hall ' || (c_custkey % 60) AS name_key, CASE WHEN c_custkey % 60 = 7 AND c_custkey % 120 = 7 THEN 'side' WHEN c_custkey % 60 IN (8, 9) THEN 'shared' WHEN c_custkey % 60 <> 10 THEN 's' || (c_custkey % 60) END AS street_key, CASE WHEN c_custkey % 60 = 11 AND c_custkey % 120 = 11 THEN 'novi' ELSE 'troy' END AS city, c_custkey % 60 <> 12 AS own FROM customer),
g AS (SELECT name_key, count(DISTINCT street_key) AS n, count(DISTINCT city) AS m, bool_and(own) AS own, min(street_key) AS street_key FROM r GROUP BY 1)
SELECT name_key, CASE WHEN name_key = 'hall 1' THEN 'has_record' WHEN n > 1 THEN 'several_streets' WHEN m > 1 THEN 'several_cities' WHEN street_key IS NULL THEN 'no_street' WHEN NOT own THEN 'not_first_party' WHEN street_key = 's2' THEN 'street_has_record' WHEN street_key = 'shared' THEN 'street_rival' END AS reason FROM g""")
def venue_creation_plan(spark, d):
    h, k = c("c_custkey") % 60, c("c_custkey") % 120
    street = F.when(k == 7, "side").when(h.isin(8, 9), "shared").when(h != 10, F.concat(F.lit("s"), h.cast("string")))
    r = t(spark, d, "customer").select(F.concat(F.lit("Hall "), h.cast("string")).alias("name"), street.alias("street_key"), F.when(k == 11, "Novi").otherwise("Troy").alias("city"), (h != 12).alias("first_party"))
    known = spark.createDataFrame([("Hall 1", None), ("Other", "s2")], "name string, street_key string")
    return venues.creation_plan(r, known).select("name_key", "reason")


@query("SELECT o_orderpriority AS street_key, array_to_string(list_sort(list(DISTINCT lower(o_orderstatus))), ',') AS names FROM orders GROUP BY 1 HAVING count(DISTINCT lower(o_orderstatus)) > 1")
def shared_streets(spark, d):
    return venues.shared_streets(t(spark, d, "orders").select(c("o_orderpriority").alias("street_key"), c("o_orderstatus").alias("name"))).select("street_key", F.array_join("names", ",").alias("names"))


# stored rows with gaps, and a second scan of their source
_STORED = """s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN ' ' ELSE 'text' END AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'u' || o_orderkey END AS event_url, CASE WHEN o_orderkey % 7 = 0 THEN 'OWNER-CORRECTION a' END AS internal_note, o_orderpriority AS source, 'Show ' || o_custkey AS title FROM orders)"""


def _stored(spark, d):
    k = c("o_orderkey")
    return t(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 == 1, " ").when(k % 3 == 2, "text").alias("description"), F.when(k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("event_url"), F.when(k % 7 == 0, "OWNER-CORRECTION a").alias("internal_note"), c("o_orderpriority").alias("source"),
        F.concat(F.lit("Show "), c("o_custkey").cast("string")).alias("title"),
    )


@query(f"""WITH {_STORED} SELECT id, concat_ws(',', CASE WHEN id % 3 < 2 THEN 'description' END, CASE WHEN id % 2 = 1 AND id % 5 <> 0 THEN 'event_url' END) AS changed, CASE WHEN id % 3 < 2 THEN 'd' || id END AS description, CASE WHEN id % 2 = 1 AND id % 5 <> 0 THEN 'n' || id END AS event_url
FROM s WHERE id % 4 <> 3 AND id % 7 <> 0 AND id % 11 <> 0 AND (id % 3 < 2 OR (id % 2 = 1 AND id % 5 <> 0))""")
def rescan_backfill(spark, d):
    s = _stored(spark, d)
    k = c("id")
    found = s.where("id % 4 <> 3").select("id", F.concat(F.lit("d"), k.cast("string")).alias("description"), F.when(k % 5 != 0, F.concat(F.lit("n"), k.cast("string"))).otherwise("").alias("event_url"), F.when(k % 11 != 0, F.concat(F.lit("The "), "title")).otherwise("Other").alias("title"))
    out = repair.backfill(s, found, "id", ["description", "event_url"], repair.owner_supplied(c("source"), c("internal_note")), repair.loose_title(c("title"), c("f_title")))
    return out.select("id", F.array_join("changed", ",").alias("changed"), "description", "event_url")


@query(f"WITH {_STORED} SELECT id, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 'new' ELSE source END AS source, CASE WHEN id % 5 = 0 THEN id % 2 = 0 END AS applied FROM s")
def guarded_patch(spark, d):
    s = _stored(spark, d).select("id", "source", (c("id") % 100).alias("version"))
    patch = s.where("id % 5 = 0").select("id", (c("version") + c("id") % 2).alias("version"), F.lit("new").alias("source"))
    return repair.compare_and_set(s, patch, "id", "version").select("id", "source", "applied")


@query(f"WITH {_STORED}, g AS (SELECT id FROM s WHERE id % 3 < 2) SELECT id, (SELECT count(*) FROM g) AS total FROM g ORDER BY id LIMIT 60")
def capped_candidates(spark, d):
    return repair.candidates(_stored(spark, d).where("id % 3 < 2").select("id"), [c("id")], 60)


@query("""WITH g AS (SELECT o_orderkey AS id, o_orderkey % 20 AS img FROM orders WHERE o_orderkey % 6 = 0)
SELECT id, CASE WHEN img = 19 THEN NULL ELSE 'https://a.org/' || img END AS image_url, CASE WHEN img = 19 THEN 'no_image' WHEN img = 0 THEN 'used_by_other_title' WHEN img = 2 THEN CASE WHEN o_custkey = 4 THEN 'use' ELSE 'used_by_other_title' END ELSE 'use' END AS decision FROM g JOIN orders ON id = o_orderkey""")
def image_repair(spark, d):
    k = c("o_orderkey")
    o = t(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("Show "), c("o_custkey").cast("string")).alias("title"), F.when(k % 20 != 19, F.concat(F.lit("https://a.org/"), (k % 20).cast("string"))).alias("image_url"))
    shown = spark.createDataFrame([("https://a.org/0", "A"), ("https://a.org/0 ", "B"), ("https://a.org/2", "show 4!")], "image_url string, title string")
    gaps = o.where("id % 6 = 0")
    return repair.image_repairs(gaps.select("id", "title"), gaps.select("id", "image_url"), shown)


@query("SELECT 'https://a.org/' || (o_custkey % 9) AS image, count(DISTINCT o_orderpriority) AS titles FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def images_in_use(spark, d):
    return repair.images_in_use(t(spark, d, "orders").select(F.concat(F.lit("https://a.org/"), (c("o_custkey") % 9).cast("string")).alias("image_url"), c("o_orderpriority").alias("title")))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'n' END AS note FROM orders), p AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_orderkey % 5 = 0)
SELECT id, CASE WHEN l.t IS NULL THEN note WHEN note IS NULL THEN l.t ELSE note || chr(10) || l.t END AS internal_note FROM r LEFT JOIN (SELECT x, string_agg('DISTINCT-FROM ' || y, chr(10) ORDER BY y) AS t FROM (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p) GROUP BY 1) l ON l.x = id""")
def marked_distinct(spark, d):
    r = t(spark, d, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 4 == 0, "n").alias("internal_note"))
    return repair.mark_distinct(r, r.where("id % 5 = 0").select(c("id").alias("a"), (c("id") + 1).alias("b")))


_MERGE = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey END AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'i' || o_orderkey END AS image_url FROM orders), p AS (SELECT o_orderkey AS survivor, o_orderkey + j AS loser FROM orders, (SELECT unnest([1, 2]) AS j) WHERE o_orderkey % 10 = 0 AND o_orderkey + j IN (SELECT o_orderkey FROM orders))"""


def _merge(spark, d):
    k = c("o_orderkey")
    r = t(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("d"), k.cast("string"))).alias("description"), F.when(k % 2 == 0, F.concat(F.lit("i"), k.cast("string"))).alias("image_url"), F.lit("approved").alias("status"), F.lit(None).cast("string").alias("internal_note"))
    p = r.where("id % 10 = 0").select(c("id").alias("survivor"), F.explode(F.array(c("id") + 1, c("id") + 2)).alias("loser"), F.lit("x").alias("rule"))
    return r, p.join(r.select(c("id").alias("loser")), "loser", "left_semi")


@query(f"""WITH {_MERGE}, g AS (SELECT survivor, min_by(description, loser) FILTER (description IS NOT NULL) AS gd, min_by(image_url, loser) FILTER (image_url IS NOT NULL) AS gi FROM p JOIN r ON r.id = loser GROUP BY 1)
SELECT id, CASE WHEN l.loser IS NULL THEN coalesce(description, gd) ELSE description END AS description, CASE WHEN l.loser IS NULL THEN coalesce(image_url, gi) ELSE image_url END AS image_url, CASE WHEN l.loser IS NULL THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN l.loser IS NOT NULL THEN 'MERGED-INTO ' || l.survivor || ' (x)' END AS internal_note
FROM r LEFT JOIN g ON g.survivor = id LEFT JOIN p l ON l.loser = id""")
def merge_applied(spark, d):
    r, p = _merge(spark, d)
    return repair.merged(r, p)


@query(f"WITH {_MERGE} SELECT DISTINCT l_suppkey AS article_id, coalesce(p.survivor, l_orderkey) AS event_id FROM lineitem LEFT JOIN p ON p.loser = l_orderkey")
def links_moved(spark, d):
    _, p = _merge(spark, d)
    return repair.moved_links(t(spark, d, "lineitem").select(c("l_suppkey").alias("article_id"), c("l_orderkey").alias("event_id")), p)


@query("SELECT o_orderpriority AS source, o_orderkey AS id, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5")
def samples_per_source(spark, d):
    return repair.per_source(t(spark, d, "orders").select(c("o_orderpriority").alias("source"), c("o_orderkey").alias("id"), "o_totalprice"), "source", [F.desc("o_totalprice"), c("id")]).select("source", "id", "rank")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'https://x.org/3' ELSE 'https://x.org/any' END AS event_url FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 7 <> 0 AND (o_custkey % 3 = 0 OR o_custkey % 5 = 0)")
def patterns_into_blanks(spark, d):
    tag = F.concat(F.when(c("o_custkey") % 3 == 0, "three ").otherwise(""), F.when(c("o_custkey") % 5 == 0, "five").otherwise(""))
    s = _stored(spark, d).join(t(spark, d, "orders").select(c("o_orderkey").alias("id"), tag.alias("tag")), "id")
    return repair.patterns_into_blanks(s, "event_url", c("tag"), [("(?i)THREE", "https://x.org/3"), ("five|three", "https://x.org/any")])


@query("""WITH e AS (SELECT event_type || (user_id % 3) AS feed, CASE event_id % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'blocked_persistent' WHEN 2 THEN 'deferred' WHEN 3 THEN 'empty_unexpected' ELSE 'ok' END AS kind, event_id % 11 AS days FROM events),
a AS (SELECT unnest(list_filter([CASE kind WHEN 'blocked' THEN 'blocked' WHEN 'empty_unexpected' THEN 'unexpected_empty' END, CASE WHEN kind IN ('blocked', 'blocked_persistent') AND days IN (3, 7) THEN 'blocked_long' END, CASE WHEN kind = 'deferred' THEN 'budget_exhausted' END], lambda x: x IS NOT NULL)) AS type, feed FROM e)
SELECT type, CASE WHEN type <> 'budget_exhausted' THEN feed END AS feed, count(*) AS n FROM a GROUP BY 1, 2""")
def run_alerts(spark, d):
    k = c("event_id")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("blocked", "blocked_persistent", "deferred", "empty_unexpected", "ok"))), (k % 5 + 1).cast("int"))
    since = F.date_sub(F.lit(date(2024, 1, 30)), (k % 11).cast("int")).cast("string")
    e = t(spark, d, "events").select(F.concat("event_type", (c("user_id") % 3).cast("string")).alias("feed"), kind.alias("kind"), F.concat(F.lit("Fetch failed: HTTP 403 [first seen "), since, F.lit("]")).alias("result"))
    return health.run_alerts(e, F.lit(date(2024, 1, 30)))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 THEN 'unknown' WHEN event_id % 3 = 0 THEN 'current' ELSE 'stale' END AS currency FROM events")
def event_currency(spark, d):
    k, now = c("event_id"), F.lit(NOW).cast("timestamp")
    cutoff = F.when(k % 7 != 0, now - F.expr("INTERVAL 1 DAY"))
    return t(spark, d, "events").select("event_id", health.event_currency(F.when(k % 3 == 0, now).otherwise(now - F.expr("INTERVAL 2 DAYS")), F.lit(24), cutoff, k % 2 != 0, k % 5 != 0).alias("currency"))


# counts in several dimensions, and orders of rows
@query("""WITH x AS (SELECT o_orderstatus AS state, o_orderpriority AS source, o_orderkey % 3 = 0 AS usable FROM orders) SELECT source, count(*) AS n, count(*) FILTER (usable) AS usable, GROUPING(source) = 1 AS total FROM x GROUP BY GROUPING SETS ((), (source))""")
def usability_by_source(spark, d):
    o = t(spark, d, "orders").select(c("o_orderpriority").alias("source"), (c("o_orderkey") % 3 == 0).alias("usable"))
    return paging.total_and_by(o, "source", n=F.count("*"), usable=F.count_if("usable"))


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderpriority AS code, o_orderstatus AS source, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 ELSE 1 END AS rank FROM orders),
n AS (SELECT code, max(rank) AS rank, count(*) AS n FROM x GROUP BY 1), b AS (SELECT code, string_agg(source || '=' || k, ',' ORDER BY k DESC, source) AS by_source FROM (SELECT code, source, count(*) AS k FROM x GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT code, array_to_string(list_sort(list(id) FILTER (r <= 5)), ',') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id) AS r FROM x) GROUP BY 1)
SELECT code, n, by_source, samples, CAST(row_number() OVER (ORDER BY rank DESC, n DESC, code) AS INT) AS place FROM n JOIN b USING (code) JOIN s USING (code)""")
def finding_classes(spark, d):
    rank = F.when(c("o_orderpriority") == "1-URGENT", 4).when(c("o_orderpriority") == "2-HIGH", 3).otherwise(1)
    return paging.classes(t(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("code"), c("o_orderstatus").alias("source"), rank.alias("rank")))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority DESC, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END ASC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def page_of_rows(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(c("o_orderkey") % 3 == 0, c("o_totalprice")).alias("price"))
    return paging.page(o, "o_orderpriority.desc,price.asc.nullslast,o_orderkey", unique="o_orderkey", offset=100, limit=50).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderpriority || ' ' || o_orderstatus) LIKE '%urgent f%' OR CAST(o_orderkey AS VARCHAR) LIKE '%77%' ORDER BY o_orderkey LIMIT 50")
def admin_search(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"), c("o_orderkey").cast("string").alias("external_id"))
    a, b = (paging.found(o, x, cols) for x, cols in (("URGENT F", ["title"]), ("77", ["external_id"])))
    return paging.page(a.union(b).distinct(), "o_orderkey", unique="o_orderkey", limit=50).select("o_orderkey")


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_name <> 'NATION_7', n_name) AS INT) AS place FROM nation")
def pinned_directory(spark, d):
    return paging.pinned_first(t(spark, d, "nation").select("n_name"), "n_name", "NATION_7")


from .operators import areas  # noqa: E402
from .sources import apis  # noqa: E402
from .streaming import runs as R  # noqa: E402


@query("""WITH p AS (SELECT c_custkey AS id, -83.5 + (c_custkey % 50) * 0.02 AS lng, 42.0 + (c_custkey % 37) * 0.02 AS lat FROM customer),
a AS (SELECT * FROM (VALUES ('west', -83.5, 42.0, -83.1, 42.5), ('east', -83.1, 42.0, -82.6, 42.8)) v(name, w, s, e, n))
SELECT id, name FROM p JOIN a ON lng >= w - 1e-9 AND lng < e - 1e-9 AND lat >= s - 1e-9 AND lat < n - 1e-9 WHERE NOT (name = 'west' AND lng >= -83.41 AND lng < -83.31 AND lat >= 42.11 AND lat < 42.21)""")
def polygon_areas(spark, d):
    box = lambda w, s, e, n: f"[[{w},{s}],[{e},{s}],[{e},{n}],[{w},{n}],[{w},{s}]]"
    west = f'{{"properties":{{"name":"west"}},"geometry":{{"type":"Polygon","coordinates":[{box(-83.505, 41.995, -83.105, 42.495)},{box(-83.41, 42.11, -83.31, 42.21)}]}}}}'
    east = f'{{"properties":{{"name":"east"}},"geometry":{{"type":"MultiPolygon","coordinates":[[{box(-83.105, 41.995, -82.805, 42.795)}],[{box(-82.805, 41.995, -82.605, 42.795)}]]}}}}'
    shapes = apis.polygons(spark.createDataFrame([(f'{{"features":[{west},{east}]}}',)], "json string"), "json", "name")
    k = c("c_custkey")
    points = t(spark, d, "customer").select(k.alias("id"), (F.lit(-83.5) + (k % 50) * 0.02).alias("lng"), (F.lit(42.0) + (k % 37) * 0.02).alias("lat"))
    return areas.within(points, shapes).select("id", "name")


@query("""SELECT 'tm-' || o_orderkey AS external_id, 'Show ' || o_custkey AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date, '7:30 PM' AS time, CASE o_orderkey % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'comedy' ELSE 'theater' END AS category, 'Hall' AS venue, 'Troy' AS city, o_totalprice AS price_from
FROM orders WHERE o_orderkey % 4 < 3 AND o_orderstatus <> 'P'""")
def ticket_service(spark, d):
    k = c("o_orderkey")
    pair = lambda s, g: F.struct(F.struct(F.lit(s).alias("name")).alias("segment"), F.struct(F.lit(g).alias("name")).alias("genre"))
    kinds = F.array(F.when(k % 4 == 0, pair("Music", "Rock")).when(k % 4 == 1, pair("Arts & Theatre", "Comedy")).when(k % 4 == 2, pair("Arts & Theatre", "Opera")).otherwise(pair("Film", "Any")))
    event = F.struct(
        k.cast("string").alias("id"), F.concat(F.lit(" Show "), c("o_custkey").cast("string")).alias("name"), F.struct(F.struct(c("o_orderdate").cast("date").cast("string").alias("localDate"), F.lit("19:30:00").alias("localTime")).alias("start"), F.struct(F.when(c("o_orderstatus") == "P", "cancelled").otherwise("onsale").alias("code")).alias("status")).alias("dates"),
        kinds.alias("classifications"), F.array(F.struct((c("o_totalprice") + 5).alias("min")), F.struct(c("o_totalprice").alias("min"))).alias("priceRanges"), F.struct(F.array(F.struct(F.lit("Hall").alias("name"), F.struct(F.lit("Troy").alias("name")).alias("city"))).alias("venues")).alias("_embedded"),
    )
    answers = t(spark, d, "orders").select(F.to_json(F.struct(F.struct(F.array(event).alias("events")).alias("_embedded"))).alias("json"))
    return apis.ticket_events(answers, "json").select("external_id", "title", c("start_date").cast("string").alias("start_date"), "time", "category", "venue", "city", "price_from")


@query("""SELECT 'show-' || o_orderkey || '-' || CAST(day AS VARCHAR) || 'T20:00' AS external_id, 'Improv' AS title, CAST(day AS VARCHAR) AS start_date, '8:00 PM' AS time, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 * 10.5 AS DOUBLE) END AS price_from, o_orderkey % 3 = 0 AS is_free
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(j * 7 AS INT) AS day FROM orders, (SELECT unnest([0, 1, 2]) AS j)) WHERE day >= DATE '1998-01-01'""")
def show_dates(spark, d):
    k = c("o_orderkey")
    days = F.transform(F.array(F.lit(0), F.lit(7), F.lit(14)), lambda j: F.concat(F.date_add(c("o_orderdate").cast("date"), j).cast("string"), F.lit("T20:00:00-05:00")))
    show = F.struct(k.cast("string").alias("id"), F.lit("Improv").alias("name"), F.concat(days, F.slice(days, 1, 1)).alias("dates"), F.array(F.struct(F.lit(0).alias("cost_after_fees")), F.struct((k % 3 * 1050).alias("cost_after_fees"))).alias("cost_tiers"))
    return apis.show_dates(t(spark, d, "orders").select(F.to_json(F.struct(F.array(show).alias("data"))).alias("json")), "json", F.lit(date(1998, 1, 1))).select("external_id", "title", c("start_date").cast("string").alias("start_date"), "time", "price_from", "is_free")


@query("""SELECT 'tribe-' || o_orderkey AS external_id, 'A' AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 2 AS VARCHAR) END AS end_date,
CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '6:00 PM' ELSE '6:00 PM – 9:15 PM' END AS time, 'w1200' AS image FROM orders""")
def calendar_service(spark, d):
    k, day = c("o_orderkey"), c("o_orderdate").cast("date")
    sizes = F.create_map(F.lit("a"), F.struct(F.lit("w300").alias("url"), F.lit(300).alias("width")), F.lit("b"), F.struct(F.lit("w1200").alias("url"), F.lit(1200).alias("width")), F.lit("c"), F.struct(F.lit("w3000").alias("url"), F.lit(3000).alias("width")))
    event = F.struct(
        k.alias("id"), F.lit("A").alias("title"), F.concat(day.cast("string"), F.lit(" 18:00:00")).alias("start_date"), F.concat(F.when(k % 3 == 0, F.date_add(day, 2)).otherwise(day).cast("string"), F.lit(" 21:15:00")).alias("end_date"), (k % 5 == 0).alias("all_day"),
        F.struct(F.lit("full").alias("url"), sizes.alias("sizes")).alias("image"),
    )
    out = apis.calendar_events(t(spark, d, "orders").select(F.to_json(F.struct(F.array(event).alias("events"))).alias("json")), "json")
    return out.select("external_id", "title", c("start_date").cast("string").alias("start_date"), c("end_date").cast("string").alias("end_date"), "time", "image")


@query("""SELECT 'eventbrite-' || o_orderkey AS external_id, 'Talk' AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) END AS end_date, '9:05 AM' AS time, 'https://e.org/' || o_orderkey AS url, o_orderkey % 3 = 0 AS is_free FROM orders WHERE o_orderstatus <> 'F'""")
def organiser_service(spark, d):
    k, day = c("o_orderkey"), c("o_orderdate").cast("date")
    event = F.struct(
        k.cast("string").alias("id"), F.struct(F.lit("Talk ").alias("text")).alias("name"), F.concat(F.lit("https://e.org/"), k.cast("string"), F.lit("?aff=x")).alias("url"), F.when(c("o_orderstatus") == "F", "canceled").otherwise("live").alias("status"), (k % 3 == 0).alias("is_free"),
        F.struct(F.concat(day.cast("string"), F.lit("T09:05:00")).alias("local")).alias("start"), F.struct(F.concat(F.when(k % 2 == 0, F.date_add(day, 1)).otherwise(day).cast("string"), F.lit("T17:00:00")).alias("local")).alias("end"),
    )
    out = apis.organiser_events(t(spark, d, "orders").select(F.to_json(F.struct(F.array(event).alias("events"))).alias("json")), "json")
    return out.select("external_id", "title", c("start_date").cast("string").alias("start_date"), c("end_date").cast("string").alias("end_date"), "time", "url", "is_free")


@query("SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'started' END ELSE 'failed' END AS outcome, CASE WHEN event_id % 6 = 0 THEN 7 END AS written FROM events")
def runs_finished(spark, d):
    r = t(spark, d, "events").select(c("event_id").alias("run_id"), F.when(c("event_id") % 3 == 0, "started").otherwise("failed").alias("outcome"), F.lit(None).cast("int").alias("written"))
    return R.finished(r, r.where("run_id % 2 = 0").select("run_id", F.lit("success").alias("outcome"), F.lit(7).alias("written")))


@query("SELECT event_id AS run_id FROM events WHERE event_type = 'view' AND event_id % 2 = 0 AND ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-30'")
def run_in_progress(spark, d):
    r = t(spark, d, "events").select(c("event_id").alias("run_id"), c("event_type").alias("source_slug"), F.when(c("event_id") % 2 == 0, "started").otherwise("success").alias("outcome"), F.lit(None).cast("timestamp").alias("finished_at"), c("ts").cast("timestamp").alias("started_at"))
    return R.in_progress(r, "view", F.lit(NOW).cast("timestamp"), 10 * 24 * 60).select("run_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'approved' WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 THEN 'WITHDRAWN' || chr(10) || 'RESTORED' ELSE 'WITHDRAWN' END END AS internal_note FROM orders")
def rows_restored(spark, d):
    k = c("o_orderkey")
    s = t(spark, d, "orders").select(k.alias("id"), F.when(k % 2 == 0, "approved").otherwise("rejected").alias("status"), F.when(k % 3 == 0, "WITHDRAWN").alias("internal_note"))
    return R.restored(s, s.where("id % 5 = 0"), "id")


@query("SELECT c_custkey AS id, 140 AS next_cursor, (SELECT count(*) FROM customer) <= 140 AS complete FROM customer WHERE c_custkey BETWEEN 100 AND 139")
def session_slice(spark, d):
    return R.session_slice(t(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_custkey").alias("at")), F.lit(100), 40).select("id", "next_cursor", "complete")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderdate, o_orderkey LIMIT 25")
def backlog(spark, d):
    o = t(spark, d, "orders").select(c("o_orderkey").alias("id"), "o_orderdate")
    return R.backlog(o, o.where("id % 3 = 0"), "id", [c("o_orderdate"), c("id")], 25).select("id")


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 1 AND CASE WHEN o_orderkey % 5 = 0 THEN false ELSE CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END < DATE '1998-01-01' - 1 END AS dropped FROM orders")
def past_rows(spark, d):
    k, day = c("o_orderkey"), c("o_orderdate").cast("date")
    o = t(spark, d, "orders").select(k.alias("id"), day.cast("string").alias("start_date"), F.when(k % 5 == 0, "soon").when(k % 3 == 0, F.date_add(day, 10).cast("string")).alias("end_date"))
    return R.split_past(o, o.where("id % 2 = 0"), "id", F.lit(date(1998, 1, 1))).select("id", "dropped")


from .operators import merging  # noqa: E402


@query("""WITH l AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 9 END AS e FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT k, k % 4 = 0 AS near, s, e FROM l WHERE k % 6 <> 2)
SELECT 'l' || l.k AS external_id, 'left' AS kept_from, coalesce(near, false) AND NOT (l.k % 12 = 0) AS review, CASE WHEN l.k % 5 = 0 THEN 'own' WHEN near THEN 'i' || l.k END AS image_url FROM l LEFT JOIN m ON m.k = l.k
UNION ALL SELECT 'r' || k, 'right', false, 'i' || k FROM m WHERE NOT near""")
def two_source_merge(spark, d):
    k, s = c("o_orderkey"), c("o_orderdate").cast("date")
    o = t(spark, d, "orders").where(k % 2 == 0).select(k.alias("k"), s.alias("start_date"), F.when(k % 3 == 0, F.date_add(s, 9)).alias("end_date"))
    n = c("k").cast("string")
    left = o.select(F.concat(F.lit("l"), n).alias("external_id"), F.concat(F.lit("A & B "), n, F.lit(" | Hall")).alias("title"), "start_date", "end_date", F.when(c("k") % 5 == 0, "own").alias("image_url"))
    shift = F.when(c("k") % 12 == 0, 0).when(c("k") % 4 == 0, F.when(c("k") % 3 == 0, 5).otherwise(0)).otherwise(400)
    days = F.when((c("k") % 4 == 0) & (c("k") % 12 != 0) & (c("k") % 3 != 0), F.date_add("start_date", 3)).otherwise(F.date_add("end_date", shift))
    right = o.where("k % 6 <> 2").select(F.concat(F.lit("r"), n).alias("external_id"), F.concat(F.lit("a and b "), n).alias("title"), F.date_add("start_date", shift).alias("start_date"), days.alias("end_date"), F.concat(F.lit("i"), n).alias("image_url"))
    return merging.two_sources(left, right).select("external_id", "kept_from", "review", "image_url")


@query("""WITH r AS (SELECT o_custkey AS g, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS title, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS w, o_orderkey % 50 = 0 AS f FROM orders)
SELECT g, min_by(title, k) FILTER (title IS NOT NULL) AS title, CAST(max(day) AS VARCHAR) AS day, array_to_string(list_sort(list(DISTINCT w)), ',') AS terms, bool_or(f) AS flag FROM r GROUP BY 1""")
def identities_merged(spark, d):
    r = t(spark, d, "orders").select(c("o_custkey").alias("g"), c("o_orderkey").alias("k"), F.when(c("o_orderkey") % 3 == 0, c("o_orderpriority")).alias("title"), c("o_orderdate").cast("date").alias("day"), F.array("o_orderstatus").alias("terms"), (c("o_orderkey") % 50 == 0).alias("flag"))
    return merging.one_identity(r, "g", c("k"), ("title",), ("day",), "terms", ("flag",)).select("g", "title", c("day").cast("string").alias("day"), F.array_join("terms", ",").alias("terms"), "flag")


@query("""SELECT l_orderkey AS article_id, l_linenumber AS event_id, CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 1 THEN 'pair' WHEN l_orderkey % 5 = 0 THEN 'art' WHEN l_linenumber = 3 THEN 'kind' ELSE l_returnflag END AS status,
CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 1 THEN 'pair' WHEN l_orderkey % 5 = 0 THEN 'article' WHEN l_linenumber = 3 THEN 'kind' ELSE 'default' END AS basis FROM lineitem""")
def override_precedence(spark, d):
    e = t(spark, d, "lineitem").select(c("l_orderkey").alias("article_id"), c("l_linenumber").alias("event_id"), "l_returnflag")
    o = t(spark, d, "orders").select(c("o_orderkey").alias("article_id"))
    tiers = [("pair", o.where("article_id % 7 = 0").select("article_id", F.lit(1).alias("event_id"), F.lit("pair").alias("status")), ["article_id", "event_id"]), ("article", o.where("article_id % 5 = 0").select("article_id", F.lit("art").alias("status")), ["article_id"]), ("kind", spark.createDataFrame([(3, "kind")], "event_id int, status string"), ["event_id"])]
    return merging.overrides(e, tiers, c("l_returnflag")).select("article_id", "event_id", "status", "basis")


@query("SELECT r_name AS kind, count(*) AS n, md5(string_agg(n_name || ':' || n_nationkey, chr(10) ORDER BY n_name || ':' || n_nationkey)) AS hash FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def catalog_fingerprint(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return merging.fingerprint(n.select(c("r_name").alias("kind"), F.concat("n_name", F.lit(":"), c("n_nationkey").cast("string")).alias("line")), "kind", "line")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 80 WHEN 2 THEN 80 ELSE CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 20 ELSE 0 END END AS rank FROM orders")
def evidence_ranks(spark, d):
    k = c("o_orderkey") % 5
    return t(spark, d, "orders").select("o_orderkey", merging.evidence_rank(F.when(k == 0, "owner_correction").when(k == 1, "verified").when(k == 2, "manual"), c("o_orderstatus"), {"F": 3, "O": 2}).alias("rank"))


@query("""WITH p AS (SELECT o_custkey % 40 AS place, o_orderkey % 3 AS url, o_orderkey % 7 AS day, CASE WHEN o_custkey % 40 < 5 AND o_orderkey % 11 = 0 THEN '8 PM' ELSE '7 PM' END AS hours FROM orders),
g AS (SELECT place, day, count(DISTINCT hours) AS n, min(hours) AS h, count(DISTINCT url) AS pages FROM p GROUP BY 1, 2)
SELECT place, day, CASE WHEN n = 1 THEN h END AS hours, pages, CASE WHEN n > 1 THEN 'conflict' WHEN pages >= 3 THEN 'high' WHEN pages = 2 THEN 'medium-high' ELSE 'medium' END AS status FROM g""")
def hours_agreed(spark, d):
    o = t(spark, d, "orders").select((c("o_custkey") % 40).alias("place"), (c("o_orderkey") % 3).alias("url"), (c("o_orderkey") % 7).alias("day"), F.when((c("o_custkey") % 40 < 5) & (c("o_orderkey") % 11 == 0), "8 PM").otherwise("7 PM").alias("hours"))
    return merging.agreed_hours(o, "place")


@query("""WITH x AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'troy' WHEN o_orderkey % 4 = 2 THEN 'Monroe' ELSE 'Atlantis' END AS city FROM orders)
SELECT CASE WHEN city IS NULL OR city = 'troy' THEN 'placed' ELSE 'unplaced' END AS place_status, CASE city WHEN 'Monroe' THEN 'source-not-evidence' WHEN 'Atlantis' THEN 'not-in-table' END AS place_reason, count(*) AS n, count(*) FILTER (city IS NULL) AS assumed FROM x GROUP BY 1, 2""")
def placement_counts(spark, d):
    k = c("o_orderkey") % 4
    e = t(spark, d, "orders").select(F.when(k == 1, "troy").when(k == 2, "Monroe").when(k == 3, "Atlantis").alias("city"), F.lit("blog").alias("source"), F.lit(None).cast("string").alias("venue"))
    table = spark.createDataFrame([("Detroit", "Michigan", 42.3, -83.0, None), ("Troy", "Michigan", 42.6, -83.1, None), ("Monroe", "Michigan", 41.9, -83.4, ["city feed"])], "name string, region string, lat double, lng double, sources array<string>")
    return venues.locate(e, venues.city_lookup(table, table.limit(0))).groupBy("place_status", "place_reason").agg(F.count("*").alias("n"), F.count_if("assumed").alias("assumed"))


@query("""WITH x AS (SELECT o_orderkey % 4 AS k, o_orderpriority AS source FROM orders) SELECT source, count(*) AS n, count(*) FILTER (k = 0) AS administrative, count(*) FILTER (k = 1) AS civic_public, count(*) FILTER (k = 2) AS needs_review, GROUPING(source) = 1 AS total FROM x GROUP BY GROUPING SETS ((), (source))""")
def meeting_audit(spark, d):
    from .functions.classes import meeting_class

    k = c("o_orderkey") % 4
    title = F.when(k == 0, "City Council Meeting").when(k == 1, "Public Hearing on zoning").when(k == 2, "Monthly Meeting").otherwise("Harvest Festival")
    o = t(spark, d, "orders").select(c("o_orderpriority").alias("source"), meeting_class(title, F.lit(None).cast("string"), F.lit("City of Troy"), F.lit(None).cast("string")).alias("m"))
    return paging.total_and_by(o, "source", n=F.count("*"), administrative=F.count_if(c("m.meeting_class") == "administrative"), civic_public=F.count_if(c("m.meeting_class") == "civic_public"), needs_review=F.count_if("m.needs_review"))
