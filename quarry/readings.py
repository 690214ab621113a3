"""Queries that read whole pages and texts, and those on boundaries, snapshots and chains of merges; with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cues, hours
from .lineage import read_once, shared_folder, spread
from .operators import boundary, elements, families, quality, repair, report, snapshots, venues
from .sources import calendar, feeds
from .sources import lines as L
from .sources.pages import lines
from .streaming import guard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
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


#: Blocks of a page: a short line is a heading and begins a record, long lines go on with it, words alone are a menu.
PAGE = L.Machine(
    states=("menu", "body", "end"), classes=(("rights", r"^(?:©|&copy;)"), ("word", r"^(\S+)$"), ("short", r"^(.{1,60})$")),
    moves={("menu", "short"): ("body", "start"), ("menu", "other"): ("body", "start"), ("body", "short"): ("body", "start"), ("body", "other"): ("body", "extend"), ("menu", "rights"): ("end", None), ("body", "rights"): ("end", None)},
    registers={"heading": {"short": 1}, "menu": {"word": 1}}, clears={"menu": ("rights",)},
)
_LINES = r"""l0 AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?i)</?(p|div|li|ul|ol|h[1-6]|tr|br|article|section|nav|footer)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS ls FROM pages),
l1 AS (SELECT page_id, list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> '') AS ls FROM l0), l AS (SELECT page_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM l1)"""


@query(f"""WITH RECURSIVE {_LINES}, k AS (SELECT *, CASE WHEN regexp_matches(line, '^(©|&copy;)') THEN 'rights' WHEN regexp_matches(line, '^\\S+$') THEN 'word' WHEN length(line) <= 60 THEN 'short' ELSE 'other' END AS k FROM l),
s AS (SELECT page_id, n, line, k, 'menu' AS before FROM k WHERE n = 0 UNION ALL
  SELECT k.page_id, k.n, k.line, k.k, CASE WHEN s.before = 'end' OR s.k = 'rights' THEN 'end' WHEN s.before = 'menu' AND s.k = 'word' THEN 'menu' ELSE 'body' END FROM s JOIN k ON k.page_id = s.page_id AND k.n = s.n + 1),
a AS (SELECT *, CASE WHEN before <> 'end' AND (k = 'short' OR (before = 'menu' AND k = 'other')) THEN 'start' WHEN before = 'body' AND k = 'other' THEN 'extend' END AS what FROM s),
r AS (SELECT *, sum((what IS NOT DISTINCT FROM 'start')::INT) OVER w AS record, last_value(CASE WHEN k = 'short' THEN line END IGNORE NULLS) OVER w AS heading, last_value(CASE WHEN k = 'word' THEN line END IGNORE NULLS) OVER w AS menu
  FROM a WINDOW w AS (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page_id, record::BIGINT AS record, min(n)::INT AS n, min_by(heading, n) FILTER (what = 'start') AS heading, min_by(menu, n) FILTER (what = 'start') AS menu, count(*) AS n_lines, string_agg(line, ' ' ORDER BY n) AS text FROM r WHERE what IS NOT NULL AND record > 0 GROUP BY page_id, record""")
def page_records(spark, d):
    pages = t(spark, d, "pages")
    return L.records(L.states(pages, ["page_id"], lines(c("html")), PAGE, block=16), ["page_id"], PAGE).select("page_id", "record", c("n").cast("int").alias("n"), "heading", "menu", "n_lines", "text")


_TAGS = r"""k0 AS (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>|[^<]+') AS ts FROM pages),
k1 AS (SELECT page_id, unnest(range(len(ts)))::INT AS pos, unnest(ts) AS token FROM k0),
k AS (SELECT *, nullif(lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)), '') AS tag, CASE WHEN starts_with(token, '</') THEN -1 ELSE 1 END AS kind FROM k1),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag ORDER BY pos) AS i FROM k WHERE tag IN ('nav', 'article', 'div', 'footer', 'a', 'h1')),
st AS (SELECT page_id, tag, pos, kind, i, token, CASE WHEN kind = 1 THEN [pos] ELSE []::INT[] END AS open, NULL::INT AS closed FROM o WHERE i = 1 UNION ALL
  SELECT o.page_id, o.tag, o.pos, o.kind, o.i, o.token, CASE WHEN o.kind = 1 THEN list_append(st.open, o.pos) ELSE st.open[1:len(st.open) - 1] END, CASE WHEN o.kind = -1 AND len(st.open) > 0 THEN st.open[len(st.open)] END
  FROM st JOIN o ON o.page_id = st.page_id AND o.tag = st.tag AND o.i = st.i + 1),
n1 AS (SELECT s.page_id, s.tag, s.pos AS pre, coalesce(e.pos, 2147483647) AS post, s.token FROM st s LEFT JOIN st e ON e.page_id = s.page_id AND e.tag = s.tag AND e.closed = s.pos WHERE s.kind = 1),
pp AS (SELECT page_id, tag, pos AS pre, coalesce(lead(pos) OVER (PARTITION BY page_id ORDER BY pos), 2147483647) AS post, kind, token FROM k WHERE tag = 'p'),
e AS (SELECT page_id, tag, pre, post, token FROM n1 UNION ALL SELECT page_id, tag, pre, post, token FROM pp WHERE kind = 1),
b AS (SELECT * FROM e WHERE tag IN ('nav', 'article', 'div', 'footer')), f AS (SELECT * FROM e WHERE tag IN ('a', 'h1', 'p')),
tx AS (SELECT k.page_id, k.pos, k.token, max(f.pre) AS pre FROM k JOIN f ON f.page_id = k.page_id AND k.tag IS NULL AND k.pos > f.pre AND k.pos < f.post GROUP BY ALL),
ft AS (SELECT page_id, pre, trim(regexp_replace(string_agg(token, '' ORDER BY pos), '\s+', ' ', 'g')) AS text FROM tx GROUP BY ALL),
fb AS (SELECT f.page_id, f.pre, f.tag, f.token, max(b.pre) AS card FROM f JOIN b ON b.page_id = f.page_id AND f.pre > b.pre AND f.pre < b.post GROUP BY ALL),
x AS (SELECT fb.*, coalesce(ft.text, '') AS text FROM fb LEFT JOIN ft ON ft.page_id = fb.page_id AND ft.pre = fb.pre)"""


@query(f"""WITH RECURSIVE {_TAGS} SELECT b.page_id, b.pre AS card, b.tag, nullif(regexp_extract(b.token, '(?i)\\sclass\\s*=\\s*["'']([^"'']*)', 1), '') AS class, count(x.pre) FILTER (x.tag = 'a') AS n_links, count(x.pre) FILTER (x.tag = 'p') AS n_paragraphs,
min_by(x.text, x.pre) FILTER (x.tag = 'h1') AS title, min_by(nullif(regexp_extract(x.token, '(?i)\\shref\\s*=\\s*["'']([^"'']*)', 1), ''), x.pre) FILTER (x.tag = 'a') AS first_link, coalesce(sum(length(x.text)), 0)::BIGINT AS n_chars
FROM b LEFT JOIN x ON x.page_id = b.page_id AND x.card = b.pre GROUP BY ALL""")
def page_cards(spark, d):
    out = elements.cards(t(spark, d, "pages"), "page_id", "html", ("nav", "article", "div", "footer"), ("a", "h1", "p"))
    of = lambda tag: F.filter("fields", lambda x: x["tag"] == tag)
    return out.select(
        "page_id", "card", "tag", "class", F.size(of("a")).cast("long").alias("n_links"), F.size(of("p")).cast("long").alias("n_paragraphs"), F.get(of("h1"), F.lit(0))["text"].alias("title"), F.get(of("a"), F.lit(0))["href"].alias("first_link"),
        F.aggregate("fields", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"])).alias("n_chars"),
    )


_MENTION, _CUE, _NEAR = "[0-9]{3}-[0-9]{4}|[0-9a-f]{40}", "[A-Z][a-z]{3,}|[+]1|@", 60
_BOTH = f"(?:{_MENTION})|(?:{_CUE})"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_BOTH}') AS m, string_split_regex(text, '{_BOTH}') AS g FROM documents WHERE regexp_matches(text, '{_MENTION}')),
e AS (SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS x, unnest(g[1:len(m)]) AS gap FROM d),
p AS (SELECT doc_id, i, x, regexp_full_match(x, '{_MENTION}') AS own, sum(length(gap) + length(x)) OVER (PARTITION BY doc_id ORDER BY i)::INT AS fin FROM e),
m AS (SELECT doc_id, x, fin - length(x) AS at FROM p WHERE own), q AS (SELECT doc_id, x AS cue, fin FROM p WHERE NOT own)
SELECT m.doc_id, m.at::INT AS at, m.x AS mention, q.cue, (m.at - q.fin)::INT AS gap FROM m ASOF JOIN q ON q.doc_id = m.doc_id AND m.at >= q.fin WHERE m.at - q.fin <= {_NEAR}""")
def cued_mentions(spark, d):
    return t(spark, d, "documents").select("doc_id", F.inline(cues.mentions_with_cue(c("text"), _MENTION, _CUE, _NEAR)))


#: Areas are diamonds around suppliers, points and parcels lie about customers.
_AREAS = "ar AS (SELECT 'A' || s_suppkey AS name, -83.4 + (s_suppkey % 10) * 0.06 + s_suppkey * 0.000137 AS x, 42.1 + (s_suppkey // 10) * 0.05 + s_suppkey * 0.000071 AS y, 0.01 * (1 + s_suppkey % 3) AS w, 0.008 AS h FROM supplier)"
_EDGES = f"""{_AREAS}, co AS (SELECT name, unnest([0, 1, 2, 3]) AS i, unnest([x - w, x, x + w, x]) AS ax, unnest([y, y - h, y, y + h]) AS ay, unnest([x, x + w, x, x - w]) AS ex, unnest([y - h, y, y + h, y]) AS ey FROM ar)"""


def _areas(spark, d):
    k = c("s_suppkey")
    x, y, w, h = F.lit(-83.4) + (k % 10) * 0.06 + k * 0.000137, F.lit(42.1) + F.floor(k / 10) * 0.05 + k * 0.000071, F.lit(0.01) * (1 + k % 3), F.lit(0.008)
    return t(spark, d, "supplier").select(F.concat(F.lit("A"), k.cast("string")).alias("name"), F.array(F.array(F.array(x - w, y), F.array(x, y - h), F.array(x + w, y), F.array(x, y + h), F.array(x - w, y))).alias("rings"))


@query(f"""WITH {_EDGES}, p AS (SELECT c_custkey AS id, -83.5 + (c_custkey % 97) * 0.013 AS lng, 42.0 + (c_custkey % 89) * 0.017 AS lat FROM customer),
m AS (SELECT id, name, (ax - lng) * 111320.0 * cos(radians(lat)) AS ax, (ay - lat) * 111320.0 AS ay, (ex - lng) * 111320.0 * cos(radians(lat)) AS ex, (ey - lat) * 111320.0 AS ey FROM p, co),
v AS (SELECT id, name, ax, ay, ex - ax AS dx, ey - ay AS dy FROM m), u AS (SELECT id, name, ax, ay, dx, dy, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS k FROM v),
z AS (SELECT id, name, sqrt((ax + k * dx) ** 2 + (ay + k * dy) ** 2) AS metres FROM u)
SELECT id, round(min(metres), 3) AS metres, min_by(name, metres) AS name FROM z GROUP BY id""")
def edge_metres(spark, d):
    k = c("c_custkey")
    points = spread(t(spark, d, "customer").select(k), "c_custkey").select(k.alias("id"), (F.lit(-83.5) + (k % 97) * 0.013).alias("lng"), (F.lit(42.0) + (k % 89) * 0.017).alias("lat"))
    return boundary.edge_metres(points, _areas(spark, d)).select("id", F.round("metres", 3).alias("metres"), "name")


_STEPS = "least(200, greatest(1, ceil(sqrt(((ex - ax) * 111320.0 * cos(radians(ay))) ** 2 + ((ey - ay) * 111320.0) ** 2) / 5)))::INT"


@query(f"WITH {_EDGES} SELECT name, i::INT AS i, {_STEPS} AS n, round(ax + (ex - ax) * ({_STEPS} - 1) / {_STEPS}, 9) AS last_lng FROM co")
def ring_points(spark, d):
    return boundary.ring_points(_areas(spark, d)).groupBy("name", "i").agg(F.count("*").cast("int").alias("n"), F.round(F.max_by("lng", "k"), 9).alias("last_lng"))


@query(f"""WITH {_AREAS}, q AS (SELECT c_custkey AS id, ar.x + (c_custkey % 23 - 11) * 0.0011 AS x, ar.y + (c_custkey % 19 - 9) * 0.0011 AS y, CASE WHEN c_custkey % 5 < 4 THEN ar.name ELSE 'elsewhere' END AS recorded FROM customer JOIN ar ON ar.name = 'A' || (1 + c_custkey % 10)),
co AS (SELECT id, recorded, unnest([x, x + 0.0003, x + 0.0003, x]) AS ax, unnest([y, y, y + 0.0002, y + 0.0002]) AS ay, unnest([x + 0.0003, x + 0.0003, x, x]) AS ex, unnest([y, y + 0.0002, y + 0.0002, y]) AS ey FROM q),
st AS (SELECT *, {_STEPS} AS n FROM co), pt AS (SELECT id, recorded, ax + (ex - ax) * k / n AS x, ay + (ey - ay) * k / n AS y FROM (SELECT *, unnest(range(n)) AS k FROM st)),
f AS (SELECT pt.id, pt.recorded, ar.name FROM pt LEFT JOIN ar ON abs(pt.x - ar.x) / ar.w + abs(pt.y - ar.y) / ar.h < 1),
g AS (SELECT id, recorded, min(name) AS a, max(name) AS b, count(*) FILTER (name IS NULL) AS out FROM f GROUP BY ALL),
s AS (SELECT *, CASE WHEN out > 0 AND a IS NULL THEN 'outside' WHEN out > 0 OR a <> b THEN 'crosses_boundary' WHEN lower(a) <> lower(recorded) THEN 'record_and_drawing_disagree' ELSE 'settled' END AS status FROM g)
SELECT id, recorded, status, CASE WHEN status = 'settled' THEN a END AS area FROM s""")
def parcel_areas(spark, d):
    areas = _areas(spark, d)
    at = areas.select("name", ((c("rings")[0][0][0] + c("rings")[0][2][0]) / 2).alias("x"), c("rings")[0][0][1].alias("y"))
    k = c("c_custkey")
    homes = spread(t(spark, d, "customer").select(k), "c_custkey").select(k, F.concat(F.lit("A"), (1 + k % 10).cast("string")).alias("name")).join(at, "name")
    x, y = c("x") + (k % 23 - 11) * 0.0011, c("y") + (k % 19 - 9) * 0.0011
    ring = F.array(F.array(x, y), F.array(x + 0.0003, y), F.array(x + 0.0003, y + 0.0002), F.array(x, y + 0.0002), F.array(x, y))
    parcels = homes.select(k.alias("name_"), F.array(ring).alias("rings"), F.when(k % 5 < 4, c("name")).otherwise("elsewhere").alias("recorded")).withColumnRenamed("name_", "name")
    return boundary.parcel_areas(parcels, areas).withColumnRenamed("name", "id")


def _snapshots(spark, d):
    k = c("o_orderkey")
    before = t(spark, d, "orders").select(k.alias("id"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("price"), c("o_orderpriority").alias("priority"))
    i = c("id")
    kept = before.where(i % 97 != 0).select("id", F.when(i % 89 == 0, None).otherwise(c("status")).alias("status"), F.when(i % 83 == 0, c("price") + 1).otherwise(c("price")).alias("price"), F.when(i % 79 == 0, F.concat("priority", F.lit("!"))).otherwise(c("priority")).alias("priority"))
    return before, kept.union(before.where(i % 101 == 0).select(-i, "status", "price", "priority"))


_AFTER = """b AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders),
a AS (SELECT id, CASE WHEN id % 89 <> 0 THEN status END AS status, CASE WHEN id % 83 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN id % 79 = 0 THEN priority || '!' ELSE priority END AS priority FROM b WHERE id % 97 <> 0 UNION ALL SELECT -id, status, price, priority FROM b WHERE id % 101 = 0)"""


@query(f"""WITH {_AFTER}, j AS (SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
concat_ws(',', CASE WHEN b.status IS DISTINCT FROM a.status THEN 'status' END, CASE WHEN b.price IS DISTINCT FROM a.price THEN 'price' END, CASE WHEN b.priority IS DISTINCT FROM a.priority THEN 'priority' END) AS why FROM b FULL JOIN a ON a.id = b.id)
SELECT id, change, CASE WHEN change = 'changed' THEN why ELSE '' END AS reasons FROM j WHERE change <> 'changed' OR why <> ''""")
def snapshot_changes(spark, d):
    before, after = _snapshots(spark, d)
    return snapshots.changes(before, after, "id", ["status", "price", "priority"]).select("id", "change", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_AFTER} SELECT * FROM (SELECT 'same' AS pair, count(*) AS n_a, count(*) AS n_b, true AS same FROM b UNION ALL SELECT 'changed', (SELECT count(*) FROM b), (SELECT count(*) FROM a), false)")
def snapshot_parity(spark, d):
    before, after = _snapshots(spark, d)
    cs = [snapshots.checksums(x, "id", ["status", "price", "priority"]) for x in (before, before.repartition(3, "price"), after)]
    return snapshots.parity(cs[0], cs[1]).select(F.lit("same").alias("pair"), "*").union(snapshots.parity(cs[0], cs[2]).select(F.lit("changed"), "*"))


_CHAINS = """p AS (SELECT o_orderkey - 1 AS survivor, o_orderkey AS loser FROM orders WHERE o_orderkey % 21 BETWEEN 1 AND 1 + (o_orderkey // 21) % 20 AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders)),
w AS (SELECT loser, survivor, 1 AS hops FROM p UNION ALL SELECT w.loser, p.survivor, w.hops + 1 FROM w JOIN p ON p.loser = w.survivor), f AS (SELECT loser, arg_max(survivor, hops) AS survivor, max(hops)::BIGINT AS hops FROM w GROUP BY loser)"""


def _chains(spark, d):
    k = t(spark, d, "orders").select(c("o_orderkey").alias("loser"))
    p = k.where((c("loser") % 21).between(1, 1 + F.floor(c("loser") / 21) % 20)).select((c("loser") - 1).alias("survivor"), "loser", F.lit("chain").alias("rule"))
    return p.join(k.select(c("loser").alias("survivor")), "survivor", "left_semi")


@query(f"WITH RECURSIVE {_CHAINS} SELECT loser, survivor, hops FROM f")
def last_survivors(spark, d):
    return repair.last_survivors(_chains(spark, d)).select("loser", "survivor", "hops")


@query(f"WITH RECURSIVE {_CHAINS} SELECT DISTINCT l_suppkey AS article_id, coalesce(f.survivor, l_orderkey) AS event_id FROM lineitem LEFT JOIN f ON f.loser = l_orderkey")
def chained_links(spark, d):
    return repair.moved_links(t(spark, d, "lineitem").select(c("l_suppkey").alias("article_id"), c("l_orderkey").alias("event_id")), _chains(spark, d))


@query(f"""WITH RECURSIVE {_CHAINS}, r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN 'd' || o_orderkey END AS description FROM orders),
g AS (SELECT f.survivor, arg_min(r.description, f.hops) AS description FROM f JOIN r ON r.id = f.loser WHERE r.description IS NOT NULL GROUP BY 1)
SELECT r.id, CASE WHEN f.loser IS NULL THEN coalesce(r.description, g.description) ELSE r.description END AS description, CASE WHEN f.loser IS NULL THEN 'approved' ELSE 'rejected' END AS status FROM r LEFT JOIN f ON f.loser = r.id LEFT JOIN g ON g.survivor = r.id""")
def chained_merges(spark, d):
    k = c("o_orderkey")
    rows = t(spark, d, "orders").select(k.alias("id"), F.when(k % 4 == 3, F.concat(F.lit("d"), k.cast("string"))).alias("description"), F.lit("approved").alias("status"), F.lit(None).cast("string").alias("internal_note"))
    return repair.merged(rows, _chains(spark, d)).select("id", "description", "status")


@query("""WITH RECURSIVE w AS (SELECT text, source, min(doc_id) AS t0 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY ALL), f AS (SELECT text, min(t0) AS t1, arg_min(source, t0) AS original FROM w GROUP BY text),
p AS (SELECT w.source, f.original, count(*) AS n FROM w JOIN f ON f.text = w.text WHERE w.source <> f.original AND w.t0 > f.t1 GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT source AS a, original AS b FROM p UNION SELECT original, source FROM p), r AS (SELECT DISTINCT source, source AS reached FROM documents WHERE source IS NOT NULL UNION SELECT r.source, e.b FROM r JOIN e ON e.a = r.reached),
k AS (SELECT source, min(reached) AS family FROM r GROUP BY 1) SELECT k.source, k.family, (SELECT count(*) FROM p WHERE p.source = k.source) AS repeats FROM k""")
def source_families(spark, d):
    told = t(spark, d, "documents").select("source", "text", c("doc_id").alias("at"))
    pairs = families.copies(told, least=2, share=0.0)
    n = pairs.groupBy("source").agg(F.count("*").alias("repeats"))
    return families.families(told, pairs).join(n, "source", "left").select("source", "family", F.coalesce("repeats", F.lit(0)).alias("repeats"))


_TOWER = """o AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending_review' END AS status, CASE WHEN o_orderkey % 13 > 0 THEN o_orderpriority END AS source, TIMESTAMP '2024-01-29' - CAST(o_orderkey % 40 AS INT) * INTERVAL 1 HOUR AS seen, o_orderdate >= TIMESTAMP '1998-01-01' AS up FROM orders),
u AS (SELECT (['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'])[event_id % 4 + 1] AS source, max(ts) FILTER (event_type IN ('view', 'click')) - INTERVAL 1 HOUR AS cutoff FROM events GROUP BY 1),
j AS (SELECT o.*, CASE WHEN cutoff IS NULL THEN 'unknown' WHEN seen >= cutoff THEN 'current' ELSE 'stale' END AS currency FROM o LEFT JOIN u ON u.source = o.source),
f AS (SELECT *, list_filter([CASE WHEN k % 7 = 0 THEN 'title.missing' END, CASE WHEN k % 5 = 0 THEN 'time.missing' END, CASE WHEN k % 11 = 0 THEN 'link.relative' END, CASE WHEN currency = 'stale' THEN 'currency.not_reseen' END], lambda x: x IS NOT NULL) AS codes, coalesce(source, 'unattributed') AS name FROM j),
s AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'blocked' WHEN k % 11 = 0 THEN 'repairable' WHEN len(codes) > 0 THEN 'advisory' ELSE 'cleared' END AS state FROM f), a AS (SELECT * FROM s WHERE status = 'approved'),
x AS (SELECT 'status' AS section, status AS key, up FROM s UNION ALL SELECT 'state', state, up FROM a UNION ALL SELECT 'currency', currency, up FROM a UNION ALL SELECT 'code', unnest(codes), up FROM a UNION ALL SELECT 'source', name, up FROM a
  UNION ALL SELECT 'code_source', unnest(codes) || '|' || name, up FROM a UNION ALL SELECT 'source_currency', name || '|' || currency, up FROM a)"""


def _tower(spark, d):
    k, ts = c("o_orderkey"), c("ts").cast("timestamp")
    rows = t(spark, d, "orders").select(
        k.alias("id"), F.when(c("o_orderstatus") == "F", "approved").otherwise("pending_review").alias("status"), F.when(k % 13 > 0, c("o_orderpriority")).alias("source"), c("o_orderdate").cast("timestamp").alias("start_date"),
        F.timestamp_add("HOUR", -(k % 40), F.lit("2024-01-29 00:00:00").cast("timestamp")).alias("seen_at"), quality.codes([("title.missing", "blocked", k % 7 == 0), ("time.missing", "advisory", k % 5 == 0), ("link.relative", "repairable", k % 11 == 0)]).alias("codes"),
    )
    name = F.element_at(F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))), (c("event_id") % 4).cast("int") + 1)
    runs = t(spark, d, "events").groupBy(name.alias("source")).agg((F.max(F.when(c("event_type").isin("view", "click"), ts)) - F.make_dt_interval(hours=F.lit(1))).alias("cutoff"))
    return report.inventory(rows.withColumn("upcoming", c("start_date") >= F.lit("1998-01-01").cast("timestamp")), runs)


@query(f"WITH {_TOWER} SELECT section, key, count(*) AS n FROM x GROUP BY ALL")
def control_tower(spark, d):
    return _tower(spark, d).select("section", "key", "n")


@query(f"WITH {_TOWER}, g AS (SELECT key, count(*) AS n FROM x WHERE section = 'code_source' GROUP BY 1), w AS (SELECT split_part(key, '|', 1) AS \"group\", split_part(key, '|', 2) AS member, n FROM g) SELECT * FROM (SELECT \"group\", row_number() OVER (PARTITION BY \"group\" ORDER BY n DESC, member)::INT AS rank, member, n FROM w) WHERE rank <= 3")
def code_sources(spark, d):
    return report.first_keys(_tower(spark, d), "code_source", 3)


@query("""WITH f AS (SELECT l_returnflag AS code, l_linestatus || (l_suppkey % 5) AS key, unnest(list_distinct([l_orderkey, l_partkey])) AS id FROM lineitem), g AS (SELECT id, code, list_sort(list_distinct(list(key))) AS keys FROM f GROUP BY ALL)
SELECT id, string_agg(code || '=' || array_to_string(keys, '+'), ',' ORDER BY code) AS codes FROM g GROUP BY id""")
def row_findings(spark, d):
    found = t(spark, d, "lineitem").select(F.concat("l_linestatus", (c("l_suppkey") % 5).cast("string")).alias("key"), c("l_returnflag").alias("code"), F.array("l_orderkey", "l_partkey").alias("ids"))
    return report.findings_by_row(found).select("id", F.array_join(F.transform("codes", lambda x: F.concat(x["code"], F.lit("="), F.array_join(x["keys"], "+"))), ",").alias("codes"))


_WEEK = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS a, (o_orderkey + 2 + o_custkey % 3) % 7 AS b, 7 + o_custkey % 4 AS h, 1 + o_orderkey % 5 AS e FROM orders),
d AS (SELECT k, a, b, h, e, unnest(range(7)) AS day FROM o), s AS (SELECT *, CASE k % 3 WHEN 0 THEN (day - a + 7) % 7 <= (b - a + 7) % 7 WHEN 1 THEN day IN (a, b) ELSE day = a END AS on_ FROM d)
SELECT k AS id, string_agg(day || '=' || h || ':30 AM-' || e || ':00 PM', ',' ORDER BY day) AS hours FROM s WHERE on_ GROUP BY k""")
def order_hours(spark, d):
    k, u = c("o_orderkey"), c("o_custkey")
    day = lambda x: F.element_at(F.array(*(F.lit(w) for w in _WEEK)), x.cast("int") + 1)
    a, b = day(k % 7), day((k + 2 + u % 3) % 7)
    spec = F.when(k % 3 == 0, F.concat(a, F.lit(" – "), b, F.lit(": "))).when(k % 3 == 1, F.concat(F.substring(a, 1, 3), F.lit(". & "), b, F.lit("s, open from "))).otherwise(F.concat(a, F.lit("s at ")))
    text = F.concat(F.lit("Seats for 12. "), spec, (7 + u % 4).cast("string"), F.lit(":30 AM to "), (1 + k % 5).cast("string"), F.lit(" p.m., later by call"))
    rows = read_once(t(spark, d, "orders").select(k.alias("id"), text.alias("text")), "text", "h", hours.weekly_hours)
    return rows.select("id", F.array_join(F.transform(F.array_sort(F.map_keys("h")), lambda x: F.concat(x.cast("string"), F.lit("="), F.element_at(c("h"), x))), ",").alias("hours"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS u, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT 'feed-' || (u % 5) || '-' || k AS external_id, CASE WHEN k % 3 = 0 THEN 'Concert ' || k ELSE 'Talk ' || k END AS title, CASE WHEN k % 3 = 0 THEN 'music' ELSE 'community' END AS category,
CASE WHEN u % 5 = 4 THEN 'House' WHEN k % 4 = 0 THEN 'Hall ' || (u % 9) WHEN k % 4 = 1 THEN 'Room ' || (u % 9) WHEN k % 4 = 2 THEN 'Venue TBA' ELSE 'behind the barn, side ' || u END AS venue_name_raw,
CASE WHEN u % 5 < 4 AND k % 4 = 0 THEN u || ' Main St' END AS venue_address_raw, CASE WHEN u % 5 < 4 AND k % 4 < 2 THEN 'Troy' END AS venue_city_raw, CAST(day AS VARCHAR) AS start_date, CASE WHEN k % 5 > 0 THEN (1 + k % 9) || ':15 PM' || CASE WHEN k % 5 = 1 THEN ' – 10:45 PM' ELSE '' END END AS time_display,
CASE WHEN k % 6 <> 1 THEN 'https://f' || (u % 5) || '.org/e/' || k END AS ticket_url FROM o WHERE k % 10 <> 9""")
def feed_rows(spark, d):
    k, u = c("o_orderkey"), c("o_custkey")
    s = lambda x: x.cast("string")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    place = F.when(k % 4 == 0, F.concat(F.lit("Hall "), s(u % 9), F.lit("\\, "), s(u), F.lit(" Main St\\, Troy\\, MI\\, 48083"))).when(k % 4 == 1, F.concat(F.lit("Room "), s(u % 9), F.lit(" - Troy MI 48083"))).when(k % 4 == 2, "-").otherwise(F.concat(F.lit("behind the barn\\, side "), s(u)))
    clock = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("T"), F.lpad(s(13 + k % 9), 2, "0"), F.lit("1500")))
    end = F.when(k % 5 == 1, F.concat(F.lit("\r\nDTEND:"), day, F.lit("T224500"))).when(k % 5 == 2, F.concat(F.lit("\r\nDTEND:"), day, F.lit("T235900"))).otherwise("")
    title = F.when(k % 10 == 9, "Library Closed").when(k % 3 == 0, F.concat(F.lit("Concert "), s(k))).otherwise(F.concat(F.lit("Talk "), s(k)))
    event = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), s(k), F.lit("\r\nSUMMARY:"), title, F.lit("\r\nDTSTART:"), day, clock, end, F.lit("\r\nLOCATION:"), place, F.when(k % 6 == 1, "\r\nURL:no link").otherwise(F.concat(F.lit("\r\nURL:/e/"), s(k))), F.lit("\r\nEND:VEVENT"))
    files = t(spark, d, "orders").select((u % 5).alias("feed_id"), u.alias("part"), event.alias("e")).groupBy("feed_id", "part").agg(F.array_join(F.collect_list("e"), "\r\n").alias("ics"))  # a file a customer
    table = spark.createDataFrame([(i, "House", f"https://f{i}.org/feed.ics", None, "community", i < 4) for i in range(5)], "id long, venue_name string, feed_url string, website string, default_category string, location_per_event boolean")
    out = feeds.calendar_rows(calendar.vevents(files.drop("part"), "ics"), table)
    return out.select("external_id", "title", "category", "venue_name_raw", "venue_address_raw", "venue_city_raw", c("start_date").cast("string").alias("start_date"), "time_display", "ticket_url")


@query("""WITH e AS (SELECT event_id AS id, event_type || (user_id % 30) AS key, event_type || ' ' || (user_id % 12) AS title, 'Hall ' || (user_id % 60) AS venue, CAST(ts AS DATE) AS day, ts AS t0 FROM events),
n AS (SELECT *, row_number() OVER (ORDER BY t0, id) AS r FROM e), k AS (SELECT *, first_value(id) OVER w AS first, row_number() OVER w AS nth FROM n WINDOW w AS (PARTITION BY key, day ORDER BY r)),
ft AS (SELECT title, day, min(r) AS r, arg_min(id, r) AS id FROM n GROUP BY ALL), fv AS (SELECT venue, day, min(r) AS r, arg_min(id, r) AS id FROM n GROUP BY ALL),
m AS (SELECT n.id, ft.id AS other FROM n JOIN ft ON ft.day IN (n.day, n.day + 1) AND ft.r < n.r AND (contains(ft.title, n.title) OR contains(n.title, ft.title)) UNION SELECT n.id, fv.id FROM n JOIN fv ON fv.day = n.day AND fv.venue = n.venue AND fv.r < n.r),
g AS (SELECT id, string_agg(other, ',' ORDER BY other) AS others FROM m GROUP BY id)
SELECT k.id, CASE WHEN nth > 1 THEN 'already_exists' WHEN g.id IS NOT NULL THEN 'possible_duplicate' ELSE 'created' END AS outcome, CASE WHEN nth > 1 THEN CAST(first AS VARCHAR) ELSE coalesce(g.others, '') END AS matches FROM k LEFT JOIN g ON g.id = k.id""")
def create_guard(spark, d):
    """The events as a stream of listings, read to its end."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    u = c("user_id")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    listings = stream.select(
        c("event_id").alias("id"), F.concat("event_type", (u % 30).cast("string")).alias("key"), F.concat("event_type", F.lit(" "), (u % 12).cast("string")).alias("title"), F.concat(F.lit("Hall "), (u % 60).cast("string")).alias("venue"), c("ts").cast("date").alias("day"), F.unix_micros(c("ts").cast("timestamp")).alias("at"),
    )
    to = f"{shared_folder(spark)}/guard-{uuid.uuid4().hex}"
    was = {k: spark.conf.get(k) for k in guard.SETTINGS}
    try:
        for k, v in guard.SETTINGS.items():
            spark.conf.set(k, v)
        q = guard.guarded(listings).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    return spark.read.schema(guard.RESULT).parquet(f"{to}/out").select("id", "outcome", F.array_join(F.transform("matches", lambda m: m.cast("string")), ",").alias("matches"))


@query("""WITH RECURSIVE s AS (SELECT 'hall ' || (o_custkey % 40) AS name_key, CASE WHEN o_custkey % 40 < 6 AND o_orderkey % 50 = 0 THEN 'oak' ELSE 'main' END AS street, o_orderpriority AS source, o_custkey || CASE WHEN o_orderpriority >= '4' THEN '1' ELSE left(o_orderpriority, 1) END AS text, CASE WHEN o_orderpriority < '2' THEN 0 ELSE 1 END AS t0 FROM orders),
w AS (SELECT text, source, min(t0) AS t0 FROM s GROUP BY ALL), f AS (SELECT text, min(t0) AS t1, min(source) FILTER (t0 = (SELECT min(t0) FROM w v WHERE v.text = w.text)) AS original FROM w GROUP BY text),
n AS (SELECT source, count(*) AS said FROM w GROUP BY 1), p AS (SELECT w.source, f.original, count(*) AS n FROM w JOIN f ON f.text = w.text WHERE w.source <> f.original AND w.t0 > f.t1 GROUP BY ALL),
e0 AS (SELECT p.source, p.original FROM p JOIN n ON n.source = p.source WHERE p.n >= 2 AND p.n >= 0.25 * said), e AS (SELECT source AS a, original AS b FROM e0 UNION SELECT original, source FROM e0),
r AS (SELECT DISTINCT source, source AS reached FROM s UNION SELECT r.source, e.b FROM r JOIN e ON e.a = r.reached), k AS (SELECT source, min(reached) AS family FROM r GROUP BY 1),
g AS (SELECT name_key, count(DISTINCT street) AS streets, min(street) AS st, count(DISTINCT family) AS families FROM s JOIN k ON k.source = s.source GROUP BY 1)
SELECT name_key, CASE WHEN streets > 1 THEN 'conflict' WHEN families >= 2 THEN 'learned' ELSE 'single_source' END AS status, CASE WHEN streets = 1 THEN st END AS address, families FROM g""")
def venue_families(spark, d):
    u, p = c("o_custkey"), c("o_orderpriority")
    street = F.when((u % 40 < 6) & (c("o_orderkey") % 50 == 0), "oak").otherwise("main")
    told = t(spark, d, "orders").select(
        F.concat(F.lit("Hall "), (u % 40).cast("string")).alias("name"), street.alias("street_key"), street.alias("address"), F.lit("Troy").alias("city"), p.alias("source"), F.concat(u.cast("string"), F.when(p >= "4", "1").otherwise(F.left(p, F.lit(1)))).alias("text"),
        F.when(p < "2", 0).otherwise(1).alias("at"), F.lit(False).alias("first_party"), c("o_orderdate").cast("date").alias("day"),
    )
    none = spark.createDataFrame([], "name string, street_key string, city string")
    return venues.learn_from_sources(told, none, least=2, share=0.25).select("name_key", "status", "address", "families")
