"""Places that feeds state, and rows of calendars and RSS."""

import random

from pyspark.sql import functions as F

from quarry.functions import nonevents
from quarry.sources import calendar, feeds, pages

PLACES = [
    ("The Capitol Theatre, 121 University Ave. W., Windsor, ON, N9A 5P4, Canada", ("parsed", "The Capitol Theatre", "121 University Ave. W.", "Windsor", "ON", "N9A 5P4", "Canada")),
    ("Royal Oak Farmers Market - 316 E 11 Mile Road  Royal Oak MI 48067", ("parsed", "Royal Oak Farmers Market", "316 E 11 Mile Road", "Royal Oak", "MI", "48067", None)),
    ("<p>Meet at Pronto/Five 15: 600 S Washington Ave, Royal Oak, MI 48067</p> -   Royal Oak MI 48067", ("unparseable", None, None, "Royal Oak", None, None, None)),
    ("Windsor Public Library, 185 Ouellette Ave, Windsor, Ontario, WindN9A 5S8, Canada", ("parsed", "Windsor Public Library", "185 Ouellette Ave", "Windsor", "Ontario", "N9A 5S8", "Canada")),
    ("Cool Cities / Hope Village, 14150 Woodrow Wilson, Detroit, 48238, United States", ("parsed", "Cool Cities / Hope Village", "14150 Woodrow Wilson", "Detroit", None, "48238", "United States")),
    ("Join us downtown, near the river, after the parade, before sunset", ("unparseable", None, None, None, None, None, None)),
    ("Main Meeting Room - Mount Clemens MI 48043", ("parsed", "Main Meeting Room", None, "Mount Clemens", "MI", "48043", None)),
    ("Larry Nehasil Park (Five Mile and Farmington Roads) - Livonia MI 48154", ("parsed", "Larry Nehasil Park (Five Mile and Farmington Roads)", None, "Livonia", "MI", "48154", None)),
    ("Join us as we celebrate Founder's Day! More information to come! - Rochester MI 48307", ("unparseable", None, None, "Rochester", None, None, None)),
    ("Canton Parks > Dog Park - Denton Rd and North of Cherry Hill Rd Canton MI 48187", ("unparseable", None, None, None, None, None, None)),
    ("Downtown - A night that is free and open to all of them. - Northville MI 48167", ("unparseable", None, None, None, None, None, None)),
    ("- 12 Main St  Royal Oak MI 48067", ("parsed", None, "12 Main St", "Royal Oak", "MI", "48067", None)), ("- Rochester MI 48307", ("parsed", None, None, "Rochester", "MI", "48307", None)),
    ("ON", ("region_only", None, None, None, "ON", None, None)), ("Michigan.", ("region_only", None, None, None, "Michigan.", None, None)), ("On", ("unparseable", None, None, None, None, None, None)),
    ("-", ("blank",) + (None,) * 6), ("<p></p>", ("blank",) + (None,) * 6), ("", ("blank",) + (None,) * 6), (None, ("blank",) + (None,) * 6), ("A&nbsp;Hall", ("unparseable",) + (None,) * 6),
]


def test_places(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PLACES)]
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i int, t string").select("i", feeds.stated_place(F.col("t"), ("Rochester", "Royal Oak")).alias("p")).collect()}
    for i, (t, want) in enumerate(PLACES):
        assert tuple(got[i][k] for k in ("status", "name", "address", "city", "region", "postal", "country")) == want, (t, got[i])
    assert got[2]["raw"].startswith("Meet at Pronto") and "<" not in got[2]["raw"] and got[20]["raw"] == "A Hall"


FEEDS = "id long, venue_name string, feed_url string, website string, default_category string, location_per_event boolean"


def test_calendar_rows(spark):
    event = lambda **p: "BEGIN:VEVENT\r\n" + "".join(f"{k.replace('_', '-')}:{v}\r\n" for k, v in p.items()) + "END:VEVENT\r\n"
    ics = "".join([
        event(UID="a1", SUMMARY="Jazz concert", DTSTART="20260610T190000", DTEND="20260610T210000", URL="/e/1", LOCATION="Hall\\, 1 Main St\\, Troy\\, MI\\, 48083"), event(UID="a2", SUMMARY="Library Closed", DTSTART="20260611T090000"),
        event(UID="a3", SUMMARY="Trip", DTSTART="20260612", DTEND="20260615", LOCATION="-"), event(SUMMARY="No uid", DTSTART="20260613T100000Z", DTEND="20260613T235900", URL="not a link"), event(UID="a5", SUMMARY="No start"),
        event(UID="77", SUMMARY="Parade", DTSTART="20260614T100000", DESCRIPTION="See https://www.city.org/calendar.aspx?EID=77", LOCATION="Somewhere behind the school"),
    ])
    table = spark.createDataFrame([(1, "Troy Hall", "https://city.org/feed.ics", "https://city.org", "community", True), (2, "Own Hall", "https://own.org/f", None, "music", False)], FEEDS)
    read = calendar.vevents(spark.createDataFrame([(1, ics), (2, ics)], "feed_id long, ics string"), "ics")
    got = {r["external_id"]: r for r in feeds.calendar_rows(read, table).collect()}
    a = got["feed-1-a1"]
    assert (a["venue_name_raw"], a["venue_address_raw"], a["venue_city_raw"], a["time_display"], a["ticket_url"], a["category"], a["end_date"]) == ("Hall", "1 Main St", "Troy", "7:00 PM – 9:00 PM", "https://city.org/e/1", "music", None)
    assert not any(k.endswith(("a2", "a5")) for k in got) and len(got) == 8
    trip = got["feed-1-a3"]
    assert (trip["venue_name_raw"], str(trip["end_date"]), trip["is_all_day"], trip["time_display"], trip["category"]) == ("Venue TBA", "2026-06-14", True, None, "community")
    none = got["feed-1-2026-06-13-No uid"]
    assert none["time_display"] == "6:00 AM" and none["ticket_url"] is None and none["rejected_link"] == "not a link" and "ticket_url" not in none["present"]
    parade = got["feed-1-77"]
    assert parade["event_url"] == "https://city.org/calendar.aspx?EID=77" and parade["no_fixed_venue"] and parade["venue_name_raw"] == "Somewhere behind the school" and parade["location_status"] == "unparseable"
    assert got["feed-2-a1"]["venue_name_raw"] == "Own Hall" and got["feed-2-a1"]["venue_city_raw"] is None


def test_rss_rows(spark):
    item = lambda title, text, date, link="": f"<item><title>{title}</title><description>{text}</description><pubDate>{date}</pubDate><link>{link}</link></item>"
    xml = item("Fest", "On June 12, 2026 in the park", "Mon, 01 Jun 2026 12:00:00 GMT", "https://a.org/1") + item("Talk", "No day", "Tue, 02 Jun 2026 02:00:00 GMT") + item("City Hall Closed", "June 1, 2026", "") + item("None", "none", "") + item("", "", "Mon, 01 Jun 2026 12:00:00 GMT")
    read = pages.feed_items(spark.createDataFrame([(1, xml)], "feed_id long, xml string"), "xml").withColumn("guid", F.lit(None).cast("string"))
    got = {r["title"]: r for r in feeds.rss_rows(read, spark.createDataFrame([(1, "A", "https://a.org/rss", None, "x", False)], FEEDS)).collect()}
    assert {k: (str(r["start_date"]), r["date_confidence"], r["external_id"]) for k, r in got.items()} == {"Fest": ("2026-06-12", "extracted", "feed-1-https://a.org/1"), "Talk": ("2026-06-01", "publication", "feed-1-2026-06-01-Talk")}
    assert got["Fest"]["category"] == "fest" and got["Talk"]["category"] == "x"


def test_present_links(spark):
    rows = spark.createDataFrame([("https://a.org/x", "nope", ["id", "ticket_url", "event_url"]), ("", None, ["id"])], "ticket_url string, event_url string, present array<string>")
    assert [sorted(r["present"]) for r in feeds.present_links(rows).collect()] == [["id", "ticket_url"], ["id"]]


def test_feeds_go_to_their_rows(spark):
    """Rows are not dealt by feed, so a large feed is not one task; each line is looked for once, and steps of a place are not stated again for each use."""
    table = spark.createDataFrame([(1, "Troy Hall", "https://city.org/feed.ics", "https://city.org", "community", True)], FEEDS)
    read = calendar.vevents(spark.createDataFrame([(1, "")], "feed_id long, ics string"), "ics")
    items = spark.createDataFrame([(1, "a", "b", "c", "d", "e")], "feed_id long, title string, link string, guid string, published string, summary string")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (feeds.calendar_rows(read, table), feeds.rss_rows(items, table))]
    assert all("BroadcastHashJoin" in p and "hashpartitioning" not in p for p in plans)
    assert plans[0].count("^SUMMARY") == plans[0].count("^DTSTART") == 1
    place = str(feeds.stated_place(F.col("t"))._jc)
    assert place.count("regexp_extract(") < 40, place.count("regexp_extract(")


def test_titles_without_a_needed_word(spark, monkeypatch):
    """The words that a title must hold leave out no title that a rule holds for."""
    rng, words = random.Random(5), [*nonevents._NOTICE, *nonevents._MEETING, *nonevents.NEEDED * 5, "-", ":", "(", ")", "5pm", "12", "city hall", "Board’s", "clo'sed", "open house", "truth in taxation", "Jazz"]
    df = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))),) for _ in range(2000)], "t string")
    df = df.union(spark.createDataFrame([("Clo'sed: library clo’sed",), ("Library CLOSED",), ("Board’s meeting",)], "t string"))
    with_them = nonevents.non_event(F.col("t")).alias("a")
    monkeypatch.setattr(nonevents, "NEEDED", ("",))
    got = df.select(with_them, nonevents.non_event(F.col("t")).alias("b")).cache()
    assert got.where("not a <=> b").count() == 0 and got.where("b is not null").count() > 20
