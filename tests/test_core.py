"""Rules of the core operators on small tables, and every query against its SQL twin on the smallest tables."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.functions import dates as D
from quarry.functions import addresses, geo, text, titles, urls
from quarry.operators import articles, duplicates, lookup, merge, quality, series
from quarry.plans import discovery
from quarry.plans.discovery import State, window
from quarry.sources import calendar, pages
from quarry.streaming import batches

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def normal(rows, names):
    def f(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for n in TABLES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


#: Queries whose rules SQL doesn't hold; other tests do.
WITHOUT_SQL = {"consolidation_plan"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert (name in queries.ORACLE) != (name in WITHOUT_SQL)
    if name in queries.ORACLE:
        cur = duck.execute(queries.ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert normal(got, df.columns) == normal(cur.fetchall(), names)


def test_state_round_trip():
    s = State(mode="dates", first=date(2026, 5, 9), last=date(2026, 5, 1), categories=("b", "a", "b"), search="  two  words ", free=True, origin=(42.0, -83.0), radius=10).canonical()
    assert (s.first, s.last, s.categories, s.search) == (date(2026, 5, 1), date(2026, 5, 9), ("a", "b"), "two words")
    assert State.parse(s.query()) == s and s.canonical() == s
    assert State.parse("when=today&when=week&within=x&q=%FF").mode == "today"
    assert State(categories=("a", "b")).canonical(("a", "b")).categories == ()


def test_window():
    sunday, wednesday = date(2026, 10, 4), date(2026, 10, 7)
    assert window(State("weekend"), sunday)[:2] == (sunday, sunday)
    assert window(State("weekend"), wednesday)[:2] == (date(2026, 10, 9), date(2026, 10, 11))
    assert window(State("week"), wednesday)[:2] == (wednesday, date(2026, 10, 11))
    assert window(State("all"), wednesday) == (wednesday, None, False, True)
    assert window(State("dates", date(2020, 1, 1), date(2020, 1, 2)), wednesday)[:2] == (date(2020, 1, 1), date(2020, 1, 2))


def test_facet_sum_and_disjoint_lists(spark):
    e = queries.listing(spark, SF)
    s = State(mode="next7")
    total = discovery.count(e, s, queries.TODAY).first()["n"]
    assert sum(r["n"] for r in discovery.facet(e, s, queries.TODAY, "category").collect()) == total
    hit = discovery.prepare(e).where(discovery.predicate(s, queries.TODAY)).select("id")
    assert hit.join(discovery.unconfirmed(e, s, queries.TODAY).select("id"), "id").count() == 0


def test_times(spark):
    r = lambda t: tuple(one(spark, D.time_range(F.lit(t)))[0])
    assert r("7:00 - 9:30 PM") == (19 * 60, 21 * 60 + 30) and r("noon - 2:00 PM") == (720, 840) and r("doors open") == (None, None) and r("11:00 AM to midnight") == (660, 0)
    assert one(spark, D.evening(F.lit("7:00 PM")), D.evening(F.lit("Evening show")), D.evening(F.lit("10:00 AM")), D.evening(F.lit(None).cast("string"))) == (True, True, False, False)
    assert one(spark, D.ended(F.lit("8:00 PM - 8:00 PM"), F.lit(1400)), D.ended(F.lit("1:00 PM - 2:00 PM"), F.lit(900)), D.ended(F.lit("10:00 PM - 2:00 AM"), F.lit(1430))) == (False, True, False)
    d = lambda x: F.to_date(F.lit(x))
    assert one(spark, D.overnight(d("2026-05-01"), d("2026-05-02"), F.lit("9 PM - 2 AM"), F.lit(False)), D.overnight(d("2026-05-01"), d("2026-05-03"), F.lit("9 PM - 2 AM"), F.lit(False))) == (True, False)
    assert one(spark, D.iso_date(F.lit("2026-02-30")), D.iso_date(F.lit("2026-2-3")), D.iso_date(F.lit("2026-02-03"))) == (None, None, date(2026, 2, 3))
    assert one(spark, D.infer_year(F.lit(1), F.lit(5), d("2026-12-20")), D.infer_year(F.lit(12), F.lit(1), d("2026-12-20"))) == (date(2027, 1, 5), date(2026, 12, 1))
    assert one(spark, D.nth_weekday(d("2026-02-10"), "Sat", 3), D.nth_weekday(d("2026-02-10"), "Sat", 5), D.nth_weekday(d("2026-02-10"), "Sat", -1)) == (date(2026, 2, 21), None, date(2026, 2, 28))
    assert one(spark, D.wall_to_utc(d("2026-03-08"), F.lit(150))) == (datetime(2026, 3, 8, 7, 30),)


def test_text(spark):
    assert one(spark, text.title_key(F.lit("Rock & Roll’s Night! 2026"), F.to_date(F.lit("2026-01-01"))), text.title_key(F.lit("Праздник №1")), text.title_key(F.lit("2026"), F.to_date(F.lit("2026-01-01")))) == ("rock and rolls night", "праздник 1", "2026")
    q = lambda d, t="A Show": one(spark, text.description_quality(F.lit(d), F.lit(t)))[0]
    assert [q(" "), q("TBA"), q("https://x.org/1"), q("7 PM"), q("An evening with"), q("Open (and"), q("a show"), q("A band plays old songs.")] == ["missing", "placeholder", "bare_url", "time_only", "truncated", "truncated", "restates_title", "ok"]
    assert one(spark, text.city_name(F.lit("Clinton Twp, MI 48035")), text.city_name(F.lit("Mt. Clemens")), text.city_name(F.lit("Charter Township of Canton"))) == ("clinton township", "mount clemens", "canton township")
    assert one(spark, text.cities_conflict(F.lit("Troy, MI"), F.lit("troy")), text.cities_conflict(F.lit(None).cast("string"), F.lit("troy")), text.cities_conflict(F.lit("Novi"), F.lit("troy"))) == (False, False, True)
    assert one(spark, text.redact(F.lit("Bearer abc.def failed token=xyz")))[0] == "Bearer [REDACTED] failed token=[REDACTED]"
    assert one(spark, text.same_identity(text.tokens(F.lit("a b c d e")), text.tokens(F.lit("A b c d")), 0.8))[0]


def test_urls(spark):
    k = lambda u: one(spark, urls.link_class(F.lit(u)))[0]
    assert [k(None), k("see the page"), k("/events/1"), k("mailto:x@y.z"), k("https://localhost/x"), k("https://a.org"), k("https://a.org/feed/"), k("https://a.org/e/1")] == ["missing", "malformed", "relative", "malformed", "malformed", "homepage", "feed_export", "specific"]
    r = lambda u: one(spark, urls.resolve(F.lit(u), F.lit("https://a.org/x/y?q=1")))[0]
    assert [r("/b"), r("c"), r("//d.org/e"), r("http://f.org")] == ["https://a.org/b", "https://a.org/x/c", "https://d.org/e", "http://f.org"]


def test_geo(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    inside = lambda x, y: one(spark, geo.in_polygon(F.lit(x), F.lit(y), [ring, [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]]))[0]
    assert (inside(1.0, 1.0), inside(5.0, 5.0), inside(11.0, 1.0), inside(0.0, 5.0), inside(10.0, 5.0)) == (True, False, False, True, False)
    assert abs(one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0] - math.pi * geo.RADIUS) < 1e-6
    edge = [(geo.LNG0, geo.LAT0), (geo.LNG0 + 1, geo.LAT0)]
    assert abs(one(spark, geo.border_miles(F.lit(geo.LNG0), F.lit(geo.LAT0 + 1), edge))[0] - 69.0) < 1e-9


def test_upsert(spark):
    stored = spark.createDataFrame([(1, "a", "x", None), (2, "b", "y", ["name"])], "id long, name string, note string, locked array<string>")
    patch = spark.createDataFrame([(1, None, None, ["note"]), (2, "B", "Y", ["name", "note"]), (3, "c", None, ["name"])], "id long, name string, note string, present array<string>")
    want = {(1, "a", None), (2, "b", "Y"), (3, "c", None)}
    once = merge.upsert(stored, patch, "id", "locked")
    assert {tuple(r)[:3] for r in once.collect()} == want
    assert {tuple(r)[:3] for r in merge.upsert(once, patch, "id", "locked").collect()} == want
    with pytest.raises(Exception, match="repeated key"):
        merge.upsert(stored, patch.union(patch), "id").collect()


def test_series(spark):
    days = spark.createDataFrame([("a", date(2026, 1, d)) for d in (1, 2, 3, 5, 6, 9)], "k string, day date")
    assert sorted((r["first_day"].day, r["last_day"].day, r["days"]) for r in series.fold_days(days, ["k"], "day").collect()) == [(1, 3, 3), (5, 5, 1), (6, 6, 1), (9, 9, 1)]
    runs = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 0, 0])] + [("b", 0, 0), ("c", 0, None)], "k string, at int, v int")
    assert {r["k"]: r["streak"] for r in series.streak(runs, "k", ["at"], F.col("v") == 0).collect()} == {"a": 2, "b": 1, "c": 0}


def test_quality(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id long, v int")
    found = df.withColumn("f", quality.codes([("big", "blocked", F.col("v") > 10), ("some", "advisory", F.col("v") > 1)]))
    assert {r["id"]: r["s"] for r in found.select("id", quality.worst(F.col("f")).alias("s")).collect()} == {1: "advisory", 2: "cleared", 3: "blocked"}
    assert {tuple(r) for r in quality.summary(found, "f", "id").collect()} == {("big", 1, "blocked", "3"), ("some", 2, "advisory", "1,3")}


def test_plan_keeps_performances_apart(spark):
    rows = [(i, "show", date(2026, 1, 1), "hall", s, t) for i, s, t in ((1, "x", None), (2, "y", "7:00 pm"), (3, "z", "9:00 pm"), (4, "x", "9:00 pm"))] + [(5, "show", date(2026, 1, 1), None, "x", None)]
    got = {tuple(r) for r in duplicates.plan(spark.createDataFrame(rows, "id long, title_key string, start_date date, place string, source string, clock string"), [F.col("id")]).collect()}
    assert got == {(1, 2, "two_sources_one_place"), (3, 4, "two_sources_one_place")}
    assert not {s for s, _, _ in got} & {x for _, x, _ in got}


def test_decisions(spark):
    """Runs of other lengths and unstated times of one source go to review; stated ones and one night told two ways merge."""
    day = lambda k: date(2026, 1, k)
    rows = [
        (1, "run", "x", "7:00 pm", None, False, None), (2, "run", "y", "7:00 pm", day(9), False, None), (3, "run", "z", None, day(2), False, None),
        (4, "unknown", "x", None, None, False, None), (5, "unknown", "x", None, None, False, None), (6, "unknown", "x", "8:00 pm", None, False, None),
        (7, "days", "x", None, None, True, "A  b https://a.org/1"), (8, "days", "x", None, None, True, "a b https://a.org/2"), (9, "days", "x", None, None, True, "c"),
        (10, "twice", "x", "7:00 pm", None, False, None), (11, "twice", "x", "7:00 pm", None, False, None), (12, "twice", "y", "9:00 pm", None, False, None),
        (13, "late", "x", None, None, False, None), (14, "late", "y", "7:00 pm", None, False, None), (15, "late", "z", "9:00 pm", None, False, None), (16, "alone", "x", None, None, False, None),
    ]
    df = spark.createDataFrame([(i, t, day(1), "hall", s, c, e, a, d) for i, t, s, c, e, a, d in rows], "id long, title_key string, start_date date, place string, source string, clock string, end_date date, all_day boolean, description string")
    want = {
        (1, 2, "review", "end_dates_differ"), (1, 3, "merge", "two_sources_one_place"), (4, 5, "review", "same_source_time_unknown"),
        (7, 8, "merge", "same_source_twice"), (7, 9, "review", "same_source_time_unknown"), (10, 11, "merge", "same_source_twice"), (10, 12, "review", "two_sources_same_place_time_conflict"),
        (13, 14, "merge", "two_sources_one_place"), (13, 15, "review", "one_listing_two_performances"),
    }
    assert sorted(map(tuple, duplicates.decisions(df, [F.col("id")]).collect())) == sorted(want)
    assert {tuple(r) for r in duplicates.plan(df, [F.col("id")]).collect()} == {(s, x, r) for s, x, k, r in want if k == "merge"}


def test_lookup(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 3), ("", 4), (None, 5)], "k string, v long")
    assert {tuple(r) for r in lookup.unique_map(df, F.col("k"), "v").collect()} == {("a", 1)}
    assert lookup.keep_first(df, ["k"], F.col("v")).count() == 4
    pairs = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (4, 5), (6, 5)], "a long, b long")
    assert [tuple(r) for r in lookup.one_to_one(pairs, "a", "b").collect()] == [(1, 1)]


def test_calendar(spark, tmp_path):
    ics = "BEGIN:VEVENT\r\nUID:1\r\nSUMMARY:A\\, b\\nc\r\nDTSTART:20260702T230000Z\r\nDTEND:20260703T010000Z\r\nLOCATION:Long\r\n er place\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20260701\r\nDTEND;VALUE=DATE:20260703\r\nSTATUS:CANCELLED\r\nEND:VEVENT\r\n"
    (tmp_path / "a.ics").write_bytes(ics.encode())
    a, b = calendar.read_ics(spark, str(tmp_path)).orderBy("uid").collect()
    assert (a["summary"], a["location"], a["start_date"], a["start_at"], a["all_day"]) == ("A, b\nc", "Longer place", date(2026, 7, 2), datetime(2026, 7, 2, 19, 0), False)
    assert (b["start_date"], b["end_date"], b["all_day"], b["status"]) == (date(2026, 7, 1), date(2026, 7, 2), True, "CANCELLED")
    rows = [(1, "x, y", date(2026, 1, 2), None, None, "Hall; 2"), (3, "é" * 60, date(2026, 1, 2), 1170, None, None), (2, None, date(2026, 1, 1), None, date(2026, 1, 3), None), (4, "z", None, None, None, None)]
    out = [r[0] for r in calendar.to_ics(spark.createDataFrame(rows, "id long, title string, start_date date, start_at int, end_date date, location string")).collect()]
    assert out[0] == "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//events//EN" and out[-1] == "END:VCALENDAR" and len(out) == 5
    assert out[1] == "BEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20260101\r\nDTEND;VALUE=DATE:20260104\r\nSUMMARY:\r\nEND:VEVENT"
    assert out[2] == "BEGIN:VEVENT\r\nUID:1\r\nDTSTART;VALUE=DATE:20260102\r\nDTEND;VALUE=DATE:20260103\r\nSUMMARY:x\\, y\r\nLOCATION:Hall\\; 2\r\nEND:VEVENT"
    assert "DTSTART;TZID=America/Detroit:20260102T193000" in out[3] and all(len(x.encode()) <= 75 for x in out[3].split("\r\n"))


def test_feeds(spark):
    rss = "<rss><item><title><![CDATA[A <b>bold</b> &amp; x]]></title><link>https://a.org/1</link><pubDate>Tue, 02 Jun 2026 10:00:00 GMT</pubDate></item><item><title>B</title></item></rss>"
    atom = "<feed><entry><title>C</title><link rel='alternate' href='https://a.org/2'/><updated>2026-06-01</updated></entry></feed>"
    got = {r["title"]: r for r in pages.feed_items(spark.createDataFrame([(rss,), (atom,)], "xml string"), "xml").withColumn("at", pages.rfc822(F.col("published"))).collect()}
    assert set(got) == {"A bold & x", "B", "C"} and got["A bold & x"]["at"] == datetime(2026, 6, 2, 10) and got["C"]["link"] == "https://a.org/2" and got["B"]["link"] is None
    assert [r[0] for r in pages.locations(spark.createDataFrame([("<urlset><url><loc> https://a.org </loc></url></urlset>",)], "x string"), "x").collect()] == ["https://a.org"]


def test_sanitized(spark):
    """Cases of the reference's sanitizeText; feeds go through it."""
    cases = {
        "&copy; 2026 &middot; x &#8217;&#x2019; caf&eacute; &unknown; &amp;lt; &#0; &#xD800; &#1114112; &#x1F600; & &;": "© 2026 · x ’’ café &unknown; &lt; &#0; &#xD800; &#1114112; \U0001f600 & &;",
        "AC/DC <Live> at <b>Fox</b>": "AC/DC <Live> at Fox", "a<!-- x > y\n -->b": "a b", "one<br/>two\n \n\n\n three": "one two\n\nthree",
        ".cf0{font-family:Segoe UI;font-size:10.5pt;} James {R} Theatre": "James {R} Theatre", "<STYLE x>p{}</style >&lt;p&gt;x &#60;script>y</script>": "x",
        "<p></p>": "<p></p>", "": "", "a&nbsp; b \u2003": "a b", "<a\nhref='x'>l</a>": "l", "a&#65279;b": "a\ufeffb", "w<w:sdt x>y<bold>": "w y<bold>",
    }
    got = {r["x"]: r["y"] for r in spark.createDataFrame([(k,) for k in [*cases, None]], "x string").select("x", text.sanitized(F.col("x")).alias("y")).collect()}
    assert got == cases | {None: None}
    rss = "<rss><item><title>Caf&#233; &lt;Live&gt; &rsquo;26</title><link>https://a.org/1</link></item></rss>"
    assert [r["title"] for r in pages.feed_items(spark.createDataFrame([(rss,)], "xml string"), "xml").collect()] == ["Café <Live> ’26"]


def test_streams(spark, tmp_path):
    for k, rows in enumerate(([(1, "a"), (2, "b")], [(2, "B"), (3, "c")])):
        spark.createDataFrame(rows, "id long, name string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id long, name string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    batches.run_available(stream, batches.merge_into(f"{tmp_path}/t", "id", lambda: "2026-01-01"), f"{tmp_path}/c")
    schema = "id long, name string, last_seen timestamp"
    assert {r["id"]: r["name"] for r in batches.read_merged(spark, f"{tmp_path}/t", schema, 1).collect()} == {1: "a", 2: "B", 3: "c"}
    assert {r["id"]: r["name"] for r in batches.read_merged(spark, f"{tmp_path}/t", schema, 0).collect()} == {1: "a", 2: "b"}
    sink = batches.merge_into(f"{tmp_path}/t", "id", lambda: "2026-01-01")
    for _ in range(2):  # a batch that is repeated
        sink(spark.createDataFrame([(1, "A")], "id long, name string"), 2)
        assert {r["id"]: r["name"] for r in batches.read_merged(spark, f"{tmp_path}/t", schema, 2).collect()} == {1: "A", 2: "B", 3: "c"}
    assert len(list((tmp_path / "t/v2").glob("bucket=*"))) == 1  # only the bucket it touches
    runs = spark.createDataFrame([("started", None, datetime(2026, 1, 1)), ("started", None, datetime(2026, 1, 1, 0, 58)), ("success", datetime(2026, 1, 1), datetime(2026, 1, 1))], "outcome string, finished_at timestamp, started_at timestamp")
    assert [r["outcome"] for r in batches.close_stalled(runs, datetime(2026, 1, 1, 1)).collect()] == ["failed", "started", "success"]


TITLES = [
    ("THE NIGHT OF THE DJ AT OCTOBER'S END", "The Night of the DJ at October's End"), ("HE$H LIVE: A TRIBUTE", "HE$H Live: A Tribute"), ("KREWELLA", "KREWELLA"),
    ("W/ALAINA AND AFTER DARK/AFRO", "w/Alaina and After Dark/Afro"), ("SPKR R&B JAZZ-NIGHT O.A.R. II", "SPKR R&B Jazz-Night O.A.R. II"), ("Mixed Case HERE", "Mixed Case HERE"), (None, None), ("", ""),
    ("A DAY - THE END", "A Day - The End"), ("(SOLD OUT) 21+ MC BRNCH 3RD X", "(Sold Out) 21+ MC BRNCH 3rd X"),
]


def test_title_case(spark):
    df = spark.createDataFrame(TITLES, "t string, want string").select("want", titles.title_case(F.col("t"))["title"].alias("got"))
    assert [r["got"] for r in df.collect()] == [w for _, w in TITLES]
    assert one(spark, titles.title_case(F.lit("TWO WORDS"), F.lit("own"), ("own",))["reason"]) == ("source_keeps_caps",)


STREETS = [
    ("660 W. Baltimore Street #2", ("660", "w", "baltimore", "baltimore", "st", None)), ("Fox Theatre, 2211 Woodward Ave, Detroit", ("2211", None, "woodward", "woodward", "ave", None)),
    ("100 Jefferson Ave W", ("100", None, "jefferson", "jefferson", "ave", "w")), ("100 st n", ("100", None, "st", "st", None, "n")), ("123a Saint Aubin, Suite 200", ("123a", None, "saint aubin", "staubin", None, None)),
    ("7 pm, 100 N St", ("100", "n", "st", "st", None, None)), ("4120-4140 Woodward", None), ("7 pm", None), ("11 Mile Road", None), (None, None), ("", None),
]


def test_street(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STREETS)], "i int, t string").select("i", addresses.street(F.col("t")).alias("s"))
    assert [r["s"] and tuple(r["s"]) for r in df.orderBy("i").collect()] == [w for _, w in STREETS]
    same = lambda a, b: one(spark, addresses.same_street(addresses.street(F.lit(a)), addresses.street(F.lit(b))))[0]
    assert same("100 W Jefferson", "100 Jefferson Ave W") and same("5 St Aubin St", "5 Saint Aubin")
    assert not same("100 W Jefferson", "100 E Jefferson") and not same("5 Elm St", "5 Elm Ave") and not same("no street", "no street")


@pytest.mark.parametrize(
    "whole, want",
    [
        ("Hall, 1 Main St, Detroit, MI 48201, USA", ("Hall, 1 Main St", "Detroit", "MI", "48201", "US")), ("1 Main St, Windsor, ON N9A 1A1, Canada", ("1 Main St", "Windsor", "ON", "N9A 1A1", "Canada")),
        ("1 Main St, Detroit, MI, 48201", ("1 Main St", "Detroit", "MI", "48201", "")), ("MI 48201", ("", "", "MI", "48201", "")), ("1 Main, Detroit", ("1 Main", "Detroit", "", "", "")),
        ("5 A St, Suite 2, MI", ("5 A St, Suite 2", "", "MI", "", "")), (None, ("", "", "", "", "")),
    ],
)
def test_address(spark, whole, want):
    assert tuple(one(spark, addresses.address(F.lit(whole).cast("string"), F.lit("detroit")))[0]) == want


def test_articles(spark):
    day = date(2026, 5, 1)
    texts = ["Cart fairs come back", "The jazzfest2 opens", "At Fox Theatre tonight", "The long night market, and more", None, "", "x" * 5000]
    a = spark.createDataFrame([(i, x, day) for i, x in enumerate(texts)], "article_id long, text string, published date")
    events = [(1, "art fair", None, date(2026, 5, 3)), (2, "Jazzfest", None, date(2026, 6, 9)), (3, "Other name", "fox theatre", date(2026, 5, 22)), (4, "Other", "Fox Theatre", date(2026, 5, 23)), (5, "Long Night Market", None, None), (6, "long NIGHT market", None, day), (7, None, None, day)]
    e = spark.createDataFrame(events, "event_id long, title string, venue string, start_date date")
    got = sorted(tuple(r) for r in articles.match(a, e, day).collect())
    assert got == [(0, 1, "title", 2), (1, 2, "title", 39), (2, 3, "venue_date", 21), (3, 6, "title", 0)]
    rejected = spark.createDataFrame([(3, 6)], "article_id long, event_id long")
    assert (3, 5, "title", None) in [tuple(r) for r in articles.match(a, e, day, rejected).collect()]
    v = lambda *x: one(spark, articles.verdict(F.lit(x[0]), F.lit(x[1]), F.lit("night market"), F.lit("fox theatre"), F.lit("troy"), F.lit(x[2]), F.lit(x[3]), 60, "detroit", ["novi"]))[0]
    assert v("title", "night market at fox theatre", 1, 60) == "verified" and v("title", "night market in troy", 1, 61) == "candidate"
    assert v("title", "night market in novi", 1, 1) == "needs_follow_up" and v("title", "night market in troy", 2, 1) == "candidate" and v("venue_date", "night market in troy", 1, 1) == "candidate"
