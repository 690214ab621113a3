"""Queries that put every order through a table of worked cases; their SQL holds the answers, worked out by hand."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classes as K
from .functions import clocktext as T
from .functions import hours as H
from .functions.tokens import bound
from .lineage import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def _sql(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def cases(name: str, inputs: str, kinds: dict[str, str], rows: list[tuple], outputs: Callable[[], dict[str, Column]], once: Callable[[], dict[str, Column]] | None = None, before: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register a query: order k goes through case k modulo their number. A case is its inputs, then its expected outputs (of DuckDB types kinds).

    Columns of `once` are worked out before the outputs, which may name them several times; `before` adds columns in several steps.
    Orders are dealt over all tasks first: their file is small and is read as one.
    """
    n, width = len(rows), len(rows[0]) - len(kinds)

    def run(spark, d):
        table = spark.createDataFrame([(i, *r[:width]) for i, r in enumerate(rows)], f"case_ int, {inputs}")  # as many rows as cases
        orders = dealt(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey").withColumn("case_", F.pmod("o_orderkey", F.lit(n)).cast("int"))
        rows_ = orders.join(F.broadcast(table), "case_")
        return (before(rows_) if before else rows_).withColumns(once() if once else {}).select("o_orderkey", *(v.alias(k) for k, v in outputs().items()))

    run.__name__ = name
    QUERIES[name] = run
    lists = ", ".join(f"CAST([{', '.join(_sql(r[width + j]) for r in rows)}][o_orderkey % {n} + 1] AS {kind}) AS {k}" for j, (k, kind) in enumerate(kinds.items()))
    ORACLE[name] = f"SELECT o_orderkey, {lists} FROM orders"


S, B, I, D = "VARCHAR", "BOOLEAN", "INTEGER", "DOUBLE"
text = lambda x: x.cast("string")
listed = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), "|")

DEARBORN = "City of Dearborn"
cases(
    "pending_class", "title string, source string, category string, venue string", {"kind": S, "gone": B},
    [
        ("City Council Meeting", DEARBORN, None, None, "civic_meeting", False), ("CANCELLED - Zoning Board", DEARBORN, None, None, "civic_meeting", True), ("Board Game Night Market", DEARBORN, None, None, "public_event", False),
        ("Daylight Saving Time Ends", DEARBORN, None, None, "observance", False), ("Food Pantry", DEARBORN, None, None, "service", False), ("Pavilion Reservations Open", DEARBORN, None, None, "ambiguous", False),
        ("Something", DEARBORN, "Music", None, "public_event", False), ("Something", DEARBORN, None, "Hall", "public_event", False), ("Something", DEARBORN, None, "Venue TBA", "ambiguous", False), ("Something", DEARBORN, None, None, "ambiguous", False),
        ("City Council Meeting", "City of Dearborn Heights", None, None, "public_event", False), ("City Council Meeting", None, None, None, "public_event", False), (None, DEARBORN, None, None, "ambiguous", False), ("Tree lighting postponed", DEARBORN, "fest", None, "public_event", True),
    ],
    lambda: {"kind": (x := K.pending_class(c("title"), c("source"), c("category"), c("venue")))["class"], "gone": x["cancelled"]},
)
cases(
    "meeting_class", "title string, description string, source string, venue string", {"kind": S, "rule": S, "review": B},
    [
        ("", None, None, None, "event", "no-title", False), ("Public Hearing on the Master Plan", None, None, None, "civic_public", "public-engagement-allowlist", False), ("Pottery Workshop", None, None, None, "event", "engagement-format-without-civic-cue", False),
        ("Harvest Festival", None, None, None, "event", "event-wording", False), ("Historic Commission Tour", None, None, None, "event", "event-wording-with-body-name", False), ("City Council Regular Meeting", None, "City of Dearborn", None, "administrative", "named-body-government-host", False),
        ("Planning Commission", None, None, "City Hall", "administrative", "named-body-government-host", False), ("Library Board Meeting", None, "Meetup", "Cafe", "event", "named-body-unknown-host", True),
        ("Neighbors Meeting", "All are welcome", None, None, "civic_public", "open-community-meeting", False), ("Merchants Meeting", "Open to the public, RSVP required", None, None, "event", "meeting-word-unclassified", True), ("Monthly Meeting", None, None, None, "event", "meeting-word-unclassified", True),
        ("Sunset Yoga", None, None, None, "event", "not-a-meeting", False), ("Hearing Officer", None, "City of Ferndale", None, "administrative", "named-body-government-host", False), ("Cancelled: Harvest Festival", None, None, None, "event", "event-wording", False),
    ],
    lambda: {"kind": (x := K.meeting_class(c("title"), c("description"), c("source"), c("venue")))["meeting_class"], "rule": x["rule"], "review": x["needs_review"]},
)
cases(
    "nightlife_class", "title string, description string, venue string, time string, sure boolean", {"decision": S, "reason": S, "evidence": S},
    [
        ("Warehouse Rave", None, "Warehouse 12", "10:00 PM – 4:00 AM", False, "nightlife", "explicit_type_plus_corroboration", "title_type:rave|late_hours|nightlife_venue"), ("Rave", None, None, "7:00 PM", False, "hold", "type_word_without_corroboration", "title_type:rave"),
        ("Kids Dance Party", None, None, None, False, "no_opinion", "family_or_institutional_context", "veto:kids"), ("Dance Party", None, "Public Library", None, False, "no_opinion", "family_or_institutional_context", "veto:library"),
        ("Comedy Rave", None, None, None, False, "no_opinion", "comedy_or_theatre_context", "veto:comedy"), ("Saturday", "A techno night with DJ set", "The Lounge", "9:30 PM", False, "nightlife", "description_type_plus_two_corroborators", "desc_type:techno night|late_hours|nightlife_venue|dj_lineup"),
        ("Saturday", "A techno night", None, "9:30 PM", False, "hold", "description_type_without_enough_corroboration", "desc_type:techno night|late_hours"), ("Fall Fair", "DJ and food trucks", None, None, False, "no_opinion", "dj_is_amenity", ""),
        ("DJ Minx", None, None, None, False, "hold", "dj_headliner_or_lineup_music_vs_nightlife", "dj_in_text_only"), ("Book Talk", None, None, None, False, "no_opinion", "no_signal", ""), ("Warehouse Rave", None, None, "10:00 PM", True, "no_opinion", "source_category_confident", ""),
        ("Club Night", None, None, "8:00 PM – 2:00 AM", False, "nightlife", "explicit_type_plus_corroboration", "title_type:club night|late_hours"), ("Club Night", None, None, "8:00 PM – 8:00 AM", False, "hold", "type_word_without_corroboration", "title_type:club night"),
    ],
    lambda: {"decision": (x := K.nightlife(c("title"), c("description"), c("venue"), c("time"), c("sure")))["decision"], "reason": x["reason"], "evidence": F.array_join(x["evidence"], "|")},
)
cases(
    "feed_result_kind", "result string, previous string", {"kind": S, "days": I},
    [
        ("12 events found", None, "ok", None), ("Fetched OK — 0 events found", "3 events found", "empty_unexpected", None), ("Fetched OK — 0 events found", None, "empty", None), ("Fetch failed: HTTP 403 [server=x; first seen 1997-06-01]", "Fetch failed: HTTP 403 [first seen 1997-06-01]", "blocked_persistent", 10),
        ("Fetch failed: HTTP 401", "Fetch failed: HTTP 403", "blocked", None), ("Fetch failed: timed out", None, "timeout", None), ("Fetch failed: timed out", "Fetch failed: timed out", "timeout_persistent", None), ("Fetch failed: HTTP 500", "Fetch failed: HTTP 502", "failed_persistent", None),
        ("Fetch failed: HTTP 500", "9 events found", "failed", None), ("Error: x", None, "failed", None), ("Deferred: run time budget reached, will be polled first next run", None, "deferred", None), ("Not polled automatically", None, "manual", None), ("Skipped (resume)", None, "skipped_resume", None),
        ("Parsed 3 events but Supabase upsert failed", None, "failed", None), ("Fetch failed: HTTP 403 [first seen 1997-07-01]", None, "blocked", None), (None, None, "ok", None),
    ],
    lambda: {"kind": K.feed_result(c("result"), c("previous")), "days": K.blocked_days(c("result"), F.lit(date(1997, 6, 11)))},
)
cases(
    "run_outcome", "status int, error string, written int, errors int, failed int, attempted int, deferred int", {"outcome": S},
    [
        (200, None, 5, 0, None, None, None, "success"), (500, "HTTP 403", 0, 0, None, None, None, "blocked"), (500, "HTTP 500", 3, 0, None, None, None, "partial"), (500, None, 0, 0, None, None, None, "failed"), (200, "x", None, 0, None, None, None, "failed"), (200, None, 2, 1, None, None, None, "partial"),
        (200, None, 0, 1, None, None, None, "failed"), (200, None, 0, 0, 3, 3, 0, "failed"), (200, None, 4, 0, 3, 3, 0, "partial"), (200, None, 4, 0, 1, 3, 0, "partial"), (200, None, 4, 0, 0, 3, 2, "partial"), (200, None, 4, 0, 0, 3, 0, "success"), (200, "upstream HTTP 401", 7, 0, None, None, None, "blocked"),
    ],
    lambda: {"outcome": K.run_outcome(c("status"), c("error"), c("written"), c("errors"), c("failed"), c("attempted"), c("deferred"))},
)
_now = datetime(1997, 6, 11, 12)
cases(
    "run_health", "outcome string, started timestamp, finished timestamp, written int", {"health": S},
    [
        ("started", datetime(1997, 6, 11, 11), None, None, "abandoned"), ("started", datetime(1997, 6, 11, 11, 44), None, None, "abandoned"), ("started", datetime(1997, 6, 11, 11, 45), None, None, "in_progress"), ("started", datetime(1997, 6, 11, 11, 50), None, None, "in_progress"), ("failed", datetime(1997, 6, 11, 11), datetime(1997, 6, 11, 11), 0, "failed"), ("blocked", datetime(1997, 6, 1), datetime(1997, 6, 1), 0, "blocked"),
        ("partial", datetime(1997, 6, 11), datetime(1997, 6, 11), 0, "no_progress"), ("partial", datetime(1997, 6, 11), datetime(1997, 6, 11), 3, "ok"), ("success", datetime(1997, 6, 9), datetime(1997, 6, 9), 3, "ok"), ("success", datetime(1997, 6, 7), datetime(1997, 6, 7), 3, "stale"),
    ],
    lambda: {"health": K.run_health(c("outcome"), c("started"), c("finished"), c("written"), F.lit(_now).cast("timestamp"), 3)},
)
cases(
    "resume_skip", "polled timestamp, result string, format string", {"skip": B},
    [(datetime(1997, 6, 11, 11), "3 events found", "ics", True), (datetime(1997, 6, 11, 11), "3 events found", "manual", False), (datetime(1997, 6, 11, 8), "3 events found", "ics", False), (datetime(1997, 6, 11, 13), "3 events found", "ics", False), (None, None, "ics", False), (datetime(1997, 6, 11, 11), "Error: x", "ics", False), (datetime(1997, 6, 11, 11), "Fetched OK — 0 events found", "rss", True)],
    lambda: {"skip": K.resume_skip(c("polled"), c("result"), c("format"), F.lit(_now).cast("timestamp"), 2 * 3600)},
)
cases(
    "publication_state", "title string, s timestamp, e timestamp, venue_id long, venue string, address string, held boolean", {"state": S},
    [
        (None, None, None, 1, None, None, False, "conflicting"), ("Untitled event", None, None, 1, None, None, False, "conflicting"), ("A", datetime(1997, 1, 2), datetime(1997, 1, 1), 1, None, None, False, "conflicting"), ("A", datetime(1997, 1, 1), datetime(1997, 1, 2), None, "Hall", None, True, "needs_review"),
        ("A", None, None, None, "Venue TBA", None, False, "needs_location"), ("A", None, None, None, None, "1 Main St", False, "verified"), ("A", datetime(1997, 1, 1), None, 3, None, " ", False, "verified"),
    ],
    lambda: {"state": K.publication_state(c("title"), c("s"), c("e"), c("venue_id"), c("venue"), c("address"), c("held"))},
)
cases("url_check", "status int", {"kind": S}, [(200, "ok"), (301, "ok"), (404, "dead"), (410, "dead"), (403, "inconclusive"), (429, "inconclusive"), (503, "inconclusive"), (None, "inconclusive"), (100, "inconclusive")], lambda: {"kind": K.url_check(c("status"))})
cases(
    "no_fixed_venue", "title string, kinds array<string>", {"moves": B},
    [("Haunted Bus Tour", None, True), ("Tour de France film", None, False), ("Parade", ["x"], True), ("Old houses", ["Walking Tours "], True), ("Old houses", ["Music"], False), (None, None, False)],
    lambda: {"moves": K.no_fixed_venue(c("title"), c("kinds"))},
)
cases(
    "placeholder_venue", "name string", {"unset": B},
    [("Venue TBA", True), ("TBD", True), ("Location to be announced", True), ("Secret Location", True), ("Various Venues", True), ("Online", True), ("Online Shop Cafe", False), ("See website for details", True), ("The Majestic", False), (None, False), ("Walk, route to be announced", True)],
    lambda: {"unset": K.placeholder_venue(c("name"))},
)
cases(
    "owner_supplied", "source string, note string", {"own": B, "noted": B},
    [("Manual", None, True, False), (" manual ", None, True, False), ("Feed", "x OWNER-CORRECTION y", True, True), ("Feed", "EDITORIAL_HOLD", True, True), ("Feed", "nothing", False, False), (None, None, False, False)],
    lambda: {"own": K.owner_supplied(c("source"), c("note")), "noted": K.owner_supplied(c("source"), c("note"), False)},
)
cases(
    "press_link", "status string, s string, e string, miles double, open boolean, verdict string", {"hidden": S},
    [
        ("rejected", "1997-07-01", None, 0.0, True, None, "removed"), ("approved", "1997-06-10", None, 0.0, True, None, "ended"), ("approved", "1997-06-10", "1997-06-11", 0.0, True, None, None), ("approved", "1997-06-10", None, 0.0, True, "verified", None), ("approved", "1997-06-10", None, 0.0, False, "verified", "ended"),
        ("approved", "1997-07-01", None, 80.0, True, None, "outside_orbit"), ("approved", "1997-07-01", None, None, True, None, None), ("approved", "1997-06-10", "soon", 1.0, True, None, None),
    ],
    lambda: {"hidden": K.press_link(c("status"), c("s"), c("e"), c("miles"), F.lit(date(1997, 6, 11)), c("open"), c("verdict"))},
)
cases(
    "provenance", "source string, submitter string, feed long, slug string, format string, way string", {"origin": S, "method": S},
    [
        ("Venue Submission", None, None, None, None, None, "human", "form"), ("X", "a@b.c", None, None, None, None, "human", "form"), ("Manual", None, None, None, None, None, "admin", "manual"), ("Editorial Review (automated)", None, None, None, None, None, "admin", "manual"),
        ("Feed", None, 3, None, "ics", None, "automated", "ics"), ("Feed", None, 3, None, "manual", None, "automated", "unknown"), ("RA", None, None, "ra", None, "api", "automated", "api"), ("Blog", None, None, None, None, None, "unknown", "unknown"),
    ],
    lambda: {"origin": (o := K.origin(c("source"), c("submitter"), c("feed"), c("slug"))), "method": K.method(o, c("format"), c("way"))},
)
cases(
    "queue_reasons", "link string, time string, day boolean, venue string, city string, moves boolean", {"codes": S},
    [("dead", None, False, None, None, False, "dead_link|missing_start_time|missing_location"), ("ok", "7 PM", False, "Hall", None, False, "missing_city"), (None, None, True, "Hall", "Troy", None, ""), (None, "7 PM", False, None, None, True, "")],
    lambda: {"codes": F.array_join(K.field_reasons(c("link"), c("time"), c("day"), c("venue"), c("city"), c("moves")), "|")},
)
cases(
    "location_gate", "source string, venue long, city string, moves boolean, stated string, seen boolean", {"ok": B, "filled": S},
    [("Feed", None, None, False, None, False, True, None), ("Venue Submission", 1, None, False, "Troy", False, True, None), ("Venue Submission", None, None, False, "Troy", False, True, "Troy"), ("Venue Submission", None, None, False, None, False, False, None), ("Venue Submission", None, None, False, None, True, True, None), ("Venue Submission", None, None, True, None, False, True, None)],
    lambda: {"ok": (x := K.location_gate(c("source"), c("venue"), c("city"), c("moves"), c("stated"), c("seen")))["ok"], "filled": x["city"]},
)
cases(
    "queue_lane", "failing boolean, problem string, held boolean", {"lane": S, "kind": S},
    [(True, None, False, "blocked", "technical"), (False, "Last poll: x", True, "blocked", "technical"), (None, None, True, "blocked", "policy_hold"), (False, None, False, "person", None)],
    lambda: {"lane": (x := K.queue_lane(c("failing"), c("problem"), c("held")))["lane"], "kind": x["kind"]},
)
cases(
    "zero_write_unexplained", "fetched int, counts map<string,int>", {"n": I},
    [(10, {"past_date": 4, "dedup": 3, "other": 9, "error": -2}, 3), (5, {"past_date": 9}, 0), (5, {}, 5), (None, {"past_date": 1}, None)],
    lambda: {"n": K.unexplained(c("fetched"), c("counts")).cast("int")},
)

cases(
    "explicit_date", "t string", {"day": S},
    [("Opens June 5th, 1997 at noon", "1997-06-05"), ("on 6/15/1997", "1997-06-15"), ("at 1997-06-05, 10:00", "1997-06-05"), ("at 1997-06-05T10:00", None), ("Sept. 9, 1997 or 1/2/1998", "1997-09-09"), ("June 31, 1997", None), ("June 5", None), (None, None), ("13/40/1997", None)],
    lambda: {"day": text(T.explicit_date(c("t")))},
)
cases(
    "date_range_text", "t string", {"first": S, "last": S},
    [
        ("June 5, 1997 - July 2, 1997", "1997-06-05", "1997-07-02"), ("December 5 – January 3, 1998", "1997-12-05", "1998-01-03"), ("June 5 - 9, 1997", "1997-06-05", "1997-06-09"), ("June 5, 1997", "1997-06-05", None), ("June 9 - 5, 1997", None, None),
        ("from June 5, 1997", None, None), (None, None, None), ("June 5 - 5, 1997", "1997-06-05", None),
    ],
    lambda: {"first": text(c("x")["start"]), "last": text(c("x")["end"])}, lambda: {"x": T.date_range(c("t"))},
)
cases(
    "dates_in_text", "t string", {"days": S},
    [("See it June 20 and Jan. 3", "1997-06-20|1998-01-03"), ("May 15 was fun, May 1 too", "1997-05-15|1998-05-01"), ("July 4, 1999; July 4, 1999", "1999-07-04"), ("Feb 30", ""), (None, "")],
    lambda: {"days": listed(T.dates_in_text(c("t"), F.lit(date(1997, 6, 11))))},
)
cases(
    "listing_date", "t string", {"day": S, "next": S},
    [("5 Jun", "1997-06-05", "1998-06-05"), ("Sat, 3 June", "1998-06-03", "1998-06-03"), ("1997-06-02T22:00", "1997-06-02", None), ("9 June", "1997-06-09", "1997-06-09"), ("31 Feb", None, None), ("", None, None)],
    lambda: {"day": text(T.listing_date(c("t"), F.lit(date(1997, 6, 11)))), "next": text(T.next_occurrence(T.month_number(F.regexp_extract(c("t"), r"(\d+) ([A-Za-z]+)", 2)), F.regexp_extract(c("t"), r"(\d+) ([A-Za-z]+)", 1), F.lit(date(1997, 6, 11))))},
)
cases(
    "date_mentions", "t string, s date, e date", {"found": S, "agree": B},
    [
        ("June 5 and 7 July 1997", date(1997, 6, 5), None, "6-5-|7-7-1997", False), ("Sat June 5, 1997", date(1997, 6, 5), None, "6-5-1997", True), ("June 5 1998", date(1997, 6, 5), None, "6-5-1998", False), ("doors June 5 pm", date(1997, 1, 1), None, "", True),
        ("June 10", date(1997, 6, 5), date(1997, 6, 12), "6-10-", True), ("nothing", date(1997, 6, 5), None, "", True),
    ],
    lambda: {"found": F.array_join(F.transform(T.date_mentions(c("t")), lambda m: F.concat(text(m["month"]), F.lit("-"), text(m["day"]), F.lit("-"), F.coalesce(text(m["year"]), F.lit("")))), "|"), "agree": T.mentions_agree(c("t"), c("s"), c("e"))},
)
cases(
    "time_minutes", "t string", {"first": I, "last": I, "shown": S},
    [("7:30 PM – 9 PM", 1170, 1260, "7:30 PM – 9 PM"), ("12 a.m. to 1:15 a.m.", 0, 75, "12 a.m. to 1:15 a.m."), ("noon", None, None, "noon"), ("doors 7 PM", None, None, "doors 7 PM"), ("7 PM – 11:59 PM", 1140, 1439, "7 PM"), ("13 PM", None, None, "13 PM"), (None, None, None, None), ("All day – 11:59 PM", None, None, "All day – 11:59 PM")],
    lambda: {"first": (x := T.start_and_end(c("t")))["start"], "last": x["end"], "shown": T.without_placeholder_end(c("t"))},
)
cases(
    "clock_format", "hm string", {"t": S},
    [("19:05", "7:05 PM"), ("00:00", "12:00 AM"), ("12:30", "12:30 PM"), ("9:15:00", "9:15 AM"), ("x", None), (None, None)],
    lambda: {"t": T.clock_of(c("hm"))},
)
cases(
    "stated_span", "s timestamp, e timestamp, day boolean", {"last": S, "t": S, "same": S},
    [
        (datetime(1997, 6, 5, 22), datetime(1997, 6, 6, 3), False, "1997-06-06", "10:00 PM–3:00 AM", "10:00 PM"), (datetime(1997, 6, 5, 19), datetime(1997, 6, 5, 23, 59), False, None, "7:00 PM", "7:00 PM"), (datetime(1997, 6, 5, 19), datetime(1997, 6, 5, 21, 30), False, None, "7:00 PM–9:30 PM", "7:00 PM – 9:30 PM"),
        (datetime(1997, 6, 5, 19), None, False, None, "7:00 PM", "7:00 PM"), (datetime(1997, 6, 5), datetime(1997, 6, 7), True, "1997-06-07", "12:00 AM–12:00 AM", None),
    ],
    lambda: {"last": text((x := T.stated_span(c("s"), c("e")))["end_date"]), "t": x["time"], "same": T.stated_span(c("s"), c("e"), c("day"), True)["time"]},
)
cases(
    "instance_normalised", "s string, e string, day boolean", {"last": S, "whole": B, "t": S, "signature": S},
    [
        ("1997-06-05T19:00:00-05:00", "1997-06-05T21:00:00-05:00", False, None, False, "7:00 PM – 9:00 PM", "19:00-21:00"), ("1997-06-05T00:00:00", "1997-06-06T00:00:00", False, None, True, None, "all-day"), ("1997-06-05T00:00:00", "1997-06-07T23:59:00", False, "1997-06-07", True, None, "all-day"),
        ("1997-06-05T22:00:00", "1997-06-06T02:00:00", False, None, False, "10:00 PM – 2:00 AM", "22:00-02:00"), ("1997-06-05T10:00:00", "1997-06-08T17:00:00", False, "1997-06-08", False, "10:00 AM", "10:00-17:00"), ("1997-06-05T10:00:00", None, False, None, False, "10:00 AM", "10:00-"),
        ("1997-06-05T00:00:00", "1997-06-08T00:00:00", True, "1997-06-07", True, None, "all-day"),
    ],
    lambda: {"last": text((x := T.instance(c("s"), c("e"), c("day")))["end_date"]), "whole": x["all_day"], "t": x["time"], "signature": x["signature"]},
)
cases(
    "season_range", "t string", {"first": S, "last": S},
    [("Open September 5th through November 2nd", "1997-09-05", "1997-11-02"), ("Sept. 26 - Nov. 1, 1997", "1997-09-26", "1997-11-01"), ("Opens on October 3. Every weekend until October 31", "1997-10-03", "1997-10-31"), ("November 5 to June 1", None, None), ("Open all year", None, None), (None, None, None)],
    lambda: {"first": text((x := H.season(c("t"), 1997))["start"]), "last": text(x["end"])},
)
_map = lambda m: bound(m, lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(text(k), F.lit("="), F.element_at(m, k))), "|"))
cases(
    "weekly_hours", "t string", {"hours": S},
    [
        ("Monday - Wednesday 9am-5pm, Saturday: 10 a.m. to 2 p.m.", "1=9:00 AM-5:00 PM|2=9:00 AM-5:00 PM|3=9:00 AM-5:00 PM|6=10:00 AM-2:00 PM"), ("Fridays 8-11 PM", "5=8:00 PM-11:00 PM"), ("Fri & Sat 11-2 AM", "5=11:00 PM-2:00 AM|6=11:00 PM-2:00 AM"),
        ("Weekends noon-5 PM", "0=12:00 PM-5:00 PM|6=12:00 PM-5:00 PM"), ("Sunday 1-4 PM. Sunday 2-5 PM", ""), ("Tuesday 11-2 PM", ""), ("Daily 5-9", ""), ("Fri-Sun 7 PM-midnight", "0=7:00 PM-12:00 AM|5=7:00 PM-12:00 AM|6=7:00 PM-12:00 AM"), (None, ""),
    ],
    lambda: {"hours": _map(H.weekly_hours(c("t")))},
)
cases(
    "closed_dates", "t string", {"days": S},
    [("Open daily. Closed October 12-14 and November 2. Closed July 4.", "1997-10-12|1997-10-13|1997-10-14|1997-11-02"), ("No performances Oct. 31", "1997-10-31"), ("Closed Mondays", ""), (None, "")],
    lambda: {"days": listed(H.closed_dates(c("t"), 1997))},
)
cases(
    "season_calendar", "t string", {"rows": S},
    [("October 1 - October 5. Wed-Sat 7-9 PM. Closed October 3.", "1997-10-01 true 7:00 PM-9:00 PM|1997-10-02 true 7:00 PM-9:00 PM|1997-10-03 false -|1997-10-04 true 7:00 PM-9:00 PM"), ("October 1 - October 2", "")],
    lambda: {"rows": F.coalesce(F.array_join(F.transform(H.season_calendar(H.season(c("t"), 1997), H.weekly_hours(c("t")), H.closed_dates(c("t"), 1997)), lambda r: F.concat_ws(" ", text(r["date"]), text(r["open"]), F.coalesce(r["hours"], F.lit("-")))), "|"), F.lit(""))},
)
cases(
    "cron_cadence", "e string", {"hours": I, "slots": S},
    [
        ("0 6 * * *", 24, "1997-06-11 06:00:00|1997-06-10 06:00:00|1997-06-09 06:00:00"), ("30 6 * * 1", 168, "1997-06-09 06:30:00"), ("15 */8 * * *", 8, "1997-06-11 08:15:00|1997-06-11 00:15:00|1997-06-10 16:15:00"), ("0 * * * *", 1, "1997-06-11 12:00:00|1997-06-11 11:00:00|1997-06-11 10:00:00"),
        ("0 6 1 * *", None, None), ("x", None, None), (None, None, None), ("0 6 * * 7", None, "1997-06-08 06:00:00"),
    ],
    lambda: {"hours": F.when(c("e") == "0 6 * * 7", F.lit(None)).otherwise(T.cron_hours(c("e"))).cast("int"), "slots": F.array_join(F.transform(T.cron_slots(c("e"), F.lit(_now).cast("timestamp"), 7, 3), lambda s: F.date_format(s, "yyyy-MM-dd HH:mm:ss")), "|")},
)
cases(
    "free_admission", "cost string, flag boolean, t string", {"free": B, "said": B},
    [
        (None, False, "Free admission!", True, True), (None, False, "Free admission for members", False, False), (None, False, "There is no free admission", False, False), (None, False, "Free entry is not available", False, False), ("$5", True, "Free admission", False, True), ("Free", False, None, True, False),
        (None, True, None, True, False), ("$0", False, "Free admission", False, True), (None, False, "Admission is free, not to be missed", True, True), (None, False, "Free admission has ended. Now free to the public.", True, True), (None, None, None, False, False),
    ],
    lambda: {"free": T.is_free(c("cost"), c("flag"), c("t")), "said": T.says_free(c("t"))},
)
cases(
    "admission_price", "lines array<string>, cents array<int>", {"free": B, "price": D, "least": D},
    [(["$12.50", "at the door"], [0, 3285, 3810], False, 12.5, 32.85), (["Free"], [0, 0], True, None, 0.0), ([], [], False, None, None), (["call"], [-5], False, None, None)],
    lambda: {"free": (x := T.admission(c("lines")))["is_free"], "price": x["price_from"], "least": T.least_paid(c("cents"))},
)
cases(
    "best_time", "t array<struct<time:string,score:int,at:int>>", {"time": S},
    [([("7 PM", 2, 1), ("8 PM", 3, 5), ("9 PM", 3, 9)], "9 PM"), ([("7 PM", 2, 1)], "7 PM"), ([], None)],
    lambda: {"time": T.best_time(c("t"))},
)
cases(
    "rotated", "items array<string>, seed int", {"out": S},
    [(["a", "b", "c"], 1, "b|c|a"), (["a", "b", "c"], 5, "c|a|b"), (["a", "b", "c"], 0, "a|b|c"), ([], 3, ""), (["a", "b", "c"], -1, "c|a|b")],
    lambda: {"out": F.array_join(T.rotated(c("items"), c("seed")), "|")},
)
cases("epoch_day", "t string, anchor date", {"n": I, "days": S}, [("1997-06-11", date(1997, 6, 2), 10023, "1997-06-02|1997-06-09|1997-06-16"), ("1997-6-11", date(1997, 6, 2), None, "1997-06-02|1997-06-09|1997-06-16"), (None, date(1997, 6, 2), None, "1997-06-02|1997-06-09|1997-06-16")], lambda: {"n": T.epoch_day(c("t")), "days": listed(T.weekly(c("anchor"), 14))})

from .functions import text as X  # noqa: E402
from .functions import urls as U  # noqa: E402

cases(
    "description_quality", "d string, title string", {"quality": S},
    [
        (" ", "A", "missing"), (None, "A", "missing"), ("deets coming soon", "A", "placeholder"), ("Coming soon", "A", "placeholder"), ("ALL DAY :: List Coming Soon", "A", "placeholder"), ("More info to be announced.", "A", "placeholder"), ("TBA", "A", "placeholder"), ("www.example.com", "A", "bare_url"),
        ("https://x.org/1", "A", "bare_url"), ("7 PM", "A", "time_only"), ("Doors: 7 - 9 pm", "A", "time_only"), ("An evening with", "A", "truncated"), ("Open (and", "A", "truncated"), ("Music, food &", "A", "truncated"), ("The special night event", "A", "restates_title"), ("Jazz night", "The Jazz", "restates_title"),
        ("Mario Kart Monthly", "Hi-Fight Circuit #15", "unrelated_to_title"), ("Circuit finals", "Hi-Fight Circuit #15", "ok"), ("A band plays old songs.", "A Show", "ok"), ("Doors open at 8 with three bands, details TBA later tonight", "A", "ok"),
    ],
    lambda: {"quality": X.description_quality(c("d"), c("title"))},
)
cases(
    "link_classes", "u string, own string, many boolean", {"kind": S},
    [
        (None, None, False, "missing"), ("come see us", None, False, "malformed"), ("/calendar.aspx?EID=3", None, False, "relative"), ("ftp://a.b/c", None, False, "malformed"), ("https://localhost/x", None, False, "malformed"), ("https://a.org/common/modules/iCalendar/iCalendar.aspx?f=1", None, False, "feed_export"),
        ("https://a.org/x.ics", None, False, "feed_export"), ("https://a.org/feed/", None, False, "feed_export"), ("https://a.org/e?output=rss", None, False, "feed_export"), ("https://ra.co/events/12", "13", False, "wrong_event"), ("https://ra.co/events/12", "12", False, "specific"),
        ("https://a.org/calendar", None, True, "shared_generic"), ("https://www.motorcitywine.com/calendar/", None, False, "shared_generic"), ("https://a.org/index.html", None, False, "homepage"), ("https://a.org", None, False, "homepage"), ("https://a.org/?id=3", None, False, "specific"), ("https://a.org/en/", None, False, "homepage"),
    ],
    lambda: {"kind": U.link_class(c("u"), c("many"), c("own"), ("motorcitywine.com/calendar",))},
)
cases(
    "redacted", "t string", {"t": S},
    [
        ("Authorization: Bearer abc.def", "authorization=[REDACTED] [REDACTED]"), ("apikey=xyz failed", "apikey=[REDACTED] failed"), ("SUPABASE_SERVICE_KEY=1 x", "[REDACTED_KEY_NAME] x"), ("eyJhbGci.eyJzdWIi.c2ln", "[REDACTED_JWT]"), ("password: hunter2", "password=[REDACTED]"), ("plain", "plain"), (None, None),
        ("x" * 501, "x" * 500 + "…[truncated]"),
    ],
    lambda: {"t": X.redact(c("t"))},
)

from .functions import integrity as N  # noqa: E402

_GOOD = {"title": "Jazz Night", "start_date": "1997-06-20", "time": "7 PM", "raw_name": "Hall", "raw_city": "Troy", "event_url": "https://a.org/e/1", "description": "A trio plays old songs.", "source": "Feed", "external_id": "x-1"}
_FIELDS = tuple(f for f in N.FIELDS)


def _event(**change):
    return tuple({**dict.fromkeys(_FIELDS), **_GOOD, **change}[f] for f in _FIELDS)


cases(
    "integrity_verdict", ", ".join(f"{f} {'boolean' if f in ('all_day', 'no_fixed_venue', 'event_url_shared', 'ticket_url_shared') else 'string'}" for f in _FIELDS), {"state": S, "codes": S},
    [
        (*_event(), "cleared", ""), (*_event(title=None), "blocked", "title.missing"), (*_event(start_date="soon"), "blocked", "date.malformed_start"), (*_event(end_date="1997-06-31"), "needs_decision", "date.malformed_end"), (*_event(end_date="1997-06-19"), "blocked", "date.end_before_start"),
        (*_event(end_date="1998-07-20"), "needs_decision", "date.range_over_year"), (*_event(end_date="1997-09-20"), "advisory", "date.long_range"), (*_event(time="Invalid Date PM"), "needs_decision", "time.malformed"), (*_event(time="TBA"), "advisory", "time.placeholder"), (*_event(time=None), "advisory", "time.missing"),
        (*_event(time=None, all_day=True), "cleared", ""), (*_event(raw_name=None), "needs_decision", "venue.missing"), (*_event(raw_name="Venue TBA"), "advisory", "venue.placeholder"), (*_event(raw_name="Venue TBA", venue_city="Novi"), "needs_decision", "place.placeholder_asserts_city"), (*_event(raw_name="Michigan"), "needs_decision", "venue.not_a_place"),
        (*_event(raw_name="Troy"), "advisory", "venue.name_is_city"), (*_event(raw_city=None), "advisory", "place.address_missing"), (*_event(venue_city="Novi"), "needs_decision", "place.city_conflict"), (*_event(raw_city="Troy, MI 48084"), "repairable", "place.city_state_zip"), (*_event(event_url="/icalendar.aspx"), "repairable", "link.relative_feed"),
        (*_event(event_url="/e/1"), "repairable", "link.relative"), (*_event(event_url="https://a.org/x.ics"), "repairable", "link.feed_export"), (*_event(event_url="see the page"), "needs_decision", "link.malformed"), (*_event(event_url="https://ra.co/events/12", own_id="13"), "repairable", "link.wrong_event"), (*_event(ticket_url="https://a.org"), "advisory", "link.homepage"),
        (*_event(event_url_shared=True), "advisory", "link.shared_generic"), (*_event(event_url=None), "advisory", "link.none"), (*_event(event_url=None, ticket_status="door"), "cleared", ""), (*_event(ticket_status="onsale"), "advisory", "link.ticket_missing_onsale"), (*_event(description=None), "advisory", "description.missing"),
        (*_event(description="Subscribe to our newsletter now."), "repairable", "description.publisher_boilerplate"), (*_event(description="jazz night"), "advisory", "description.placeholder"), (*_event(description="coming soon"), "advisory", "description.placeholder"), (*_event(description="www.a.org"), "advisory", "description.not_descriptive"),
        (*_event(description="A trio plays with"), "advisory", "description.truncated"), (*_event(title="Circuit #15", description="Kart monthly"), "advisory", "description.unrelated_to_title"), (*_event(description="The jazz event"), "advisory", "description.restates_title"), (*_event(description_source="generated"), "advisory", "description.generated"),
        (*_event(source=None), "needs_decision", "provenance.no_source"), (*_event(external_id=None), "advisory", "provenance.no_source_record_id"), (*_event(duplicate="review"), "needs_decision", "duplicate.needs_review"), (*_event(duplicate="merge"), "advisory", "duplicate.pending_merge"), (*_event(currency="stale"), "advisory", "currency.not_reseen"),
        (*_event(title=None, time=None, source=None), "blocked", "title.missing|time.missing|provenance.no_source"),
    ],
    lambda: {"state": c("verdict")["state"], "codes": F.array_join(c("verdict")["codes"]["code"], "|")},
    before=lambda rows: N.with_integrity(rows, {f: c(f) for f in _FIELDS}, "verdict"),
)
_GATE = ("title", "external_id", "source", "category", "start_date", "end_date", "time", "raw_city", "raw_name", "venue_id", "description", "description_source", "rule")


def _row(**change):
    return tuple({**dict.fromkeys(_GATE), "title": "Jazz", "external_id": "x", "source": "Feed", "category": "music", "start_date": "1997-06-20", "raw_city": "Troy", **change}[f] for f in _GATE)


cases(
    "publication_gate", ", ".join(f"{f} string" for f in _GATE) + ", inside boolean", {"decision": S, "issues": S},
    [
        (*_row(), True, "publish", ""), (*_row(title=None), True, "skip", "TITLE_MISSING"), (*_row(title="TBA"), True, "hold", "TITLE_PLACEHOLDER"), (*_row(external_id=" "), True, "skip", "IDENTITY_MISSING"), (*_row(source=None, category=None), True, "skip", "SOURCE_MISSING|CATEGORY_MISSING"), (*_row(start_date="x"), True, "skip", "START_DATE_INVALID"),
        (*_row(start_date="2003-01-01"), True, "hold", "START_DATE_IMPLAUSIBLE"), (*_row(end_date="x"), True, "hold", "END_DATE_INVALID"), (*_row(end_date="1997-06-01"), True, "hold", "END_BEFORE_START"), (*_row(end_date="1999-06-01"), True, "hold", "SPAN_IMPLAUSIBLE"), (*_row(time="varies"), True, "publish", "TIME_PLACEHOLDER"),
        (*_row(raw_city="12 Main St"), True, "hold", "ADDRESS_IN_CITY"), (*_row(raw_city="Troy, MI"), True, "hold", "CITY_HAS_REGION"), (*_row(raw_city="TBD"), True, "hold", "CITY_PLACEHOLDER"), (*_row(raw_city="Atlantis"), True, "publish", "CITY_UNRECOGNIZED"), (*_row(), False, "hold", "OUTSIDE_ORBIT"), (*_row(), None, "hold", "ORBIT_UNKNOWN"),
        (*_row(raw_name="Hall"), True, "publish", "VENUE_UNLINKED"), (*_row(rule="closure_notice"), True, "reject", "NOT_AN_EVENT:closure_notice"), (*_row(rule="closure_notice", title=None), True, "skip", "TITLE_MISSING|NOT_AN_EVENT:closure_notice"), (*_row(description="<b>x</b> R&amp;B"), True, "publish", ""), (*_row(description="x < Style y"), True, "hold", "MARKUP_IN_TEXT"), (*_row(raw_city="<script>"), True, "hold", "CITY_UNRECOGNIZED|MARKUP_IN_TEXT"), (*_row(title="Event"), True, "hold", "TITLE_PLACEHOLDER"), (*_row(title="unknown"), True, "publish", ""),
        (*_row(start_date="1996-06-10"), True, "publish", ""), (*_row(start_date="1996-06-09"), True, "hold", "START_DATE_IMPLAUSIBLE"), (*_row(start_date="1999-06-11"), True, "publish", ""), (*_row(start_date="1999-06-12"), True, "hold", "START_DATE_IMPLAUSIBLE"), (*_row(title="Consultation by appointment"), True, "hold", "ELIGIBILITY_UNCERTAIN"),
        (*_row(title="By appointment", rule="closure_notice"), True, "reject", "NOT_AN_EVENT:closure_notice"), (*_row(description="TODO: ask", raw_name="Hall, spot-check"), True, "hold", "VENUE_UNLINKED|INTERNAL_COMMENTARY_IN_PUBLIC_FIELD|INTERNAL_COMMENTARY_IN_PUBLIC_FIELD"), (*_row(description="Researched 2019-05"), True, "hold", "INTERNAL_COMMENTARY_IN_PUBLIC_FIELD"),
        (*_row(description="A talk", description_source="authoritative"), True, "publish", "PROVENANCE_CLAIM_UNSUPPORTED"), (*_row(description_source="generated"), True, "publish", "PROVENANCE_WITHOUT_DESCRIPTION"),
    ],
    lambda: {"decision": (x := N.gate({f: c(f) for f in _GATE}, F.lit(date(1997, 6, 11)), c("raw_city").isin("Troy", "Novi"), c("rule"), c("inside")))["decision"], "issues": F.array_join(x["issues"], "|")},
)
_CHECKS = ("required_facts", "venue_linked", "venue", "freshness", "date_time", "pair_scan", "description_time", "stored_link", "image_presence")
cases(
    "coverage_checks", "found array<string>, title string, description string, time string, all_day boolean, venue_id long, venue_verified boolean, compared boolean, event_url string, ticket_url string, link_status string, checked_at date, image_url string, locked array<string>, currency string, seen boolean", {"outcomes": S},
    [
        ([], "Jazz", "A trio plays old songs.", "7 PM", False, 1, True, True, "https://a.org/e", None, "ok", date(1997, 6, 10), "https://a.org/i.png", [], "current", True, "pass|pass|pass|pass|pass|pass|pass|pass|pass"),
        (["venue_placeholder", "required_fact_missing"], "Jazz", None, None, False, None, False, False, None, None, None, None, None, [], "stale", True, "fail|fail|fail|review|unchecked|unchecked|fail|fail|fail"),
        (["start_time_unconfirmed", "same_event_link_collision"], "Jazz", "A trio plays old songs.", None, False, None, None, True, "https://a.org/e", None, "inconclusive", None, "/assets/placeholders/a.png", ["start_date"], "stale", False, "pass|unchecked|unchecked|unchecked|review|review|review|review|fail"),
        (["venue_resolution_review"], "Jazz", "A trio plays old songs.", "7 PM", False, 4, True, True, "https://a.org/e", None, "ok", date(1997, 5, 27), "x", ["time_display"], "current", True, "pass|pass|review|pass|unchecked|pass|pass|unchecked|pass"),
        (["venue_resolution_review"], "Jazz", "A trio plays old songs.", "7 PM", False, 4, True, True, "https://a.org/e", None, "ok", date(1997, 5, 28), "x", ["time_display"], "current", True, "pass|pass|review|pass|unchecked|pass|pass|pass|pass"),
        ([], "Jazz", "A trio plays old songs.", None, True, None, None, None, "x", "https://t.org/e", "dead", None, "x", [], None, None, "pass|unchecked|unchecked|unchecked|unchecked|unchecked|pass|fail|pass"),
    ],
    lambda: {"outcomes": (lambda x: F.concat_ws("|", *(x[k] for k in _CHECKS)))(N.coverage(c("found"), {f: c(f) for f in ("title", "description", "time", "all_day", "venue_id", "venue_verified", "compared", "event_url", "ticket_url", "link_status", "checked_at", "image_url")}, c("locked"), c("currency"), c("seen"), F.lit(date(1997, 6, 11))))},
)
cases(
    "replace_description", "stored string, origin string, incoming string, title string", {"write": B, "reason": S},
    [
        (None, None, "A trio plays.", "Jazz", True, "fill_blank"), ("Old text here.", None, " ", "Jazz", False, "incoming_blank_never_replaces"), ("TBA", None, "A trio plays.", "Jazz", True, "outranks_stored"), ("Old text here.", None, "A trio plays.", "Jazz", True, "source_refresh"), ("Old text.", "manual", "A trio plays.", "Jazz", False, "stored_is_stronger_or_equal"),
        ("Old text.", "generated", "A trio plays.", "Jazz", True, "outranks_stored"), ("Old text.", "generated", "TBA", "Jazz", False, "stored_is_stronger_or_equal"), ("Old text here.", None, "TBA", "Jazz", False, "stored_is_stronger_or_equal"), (" ", "manual", "TBA", "Jazz", True, "fill_blank"),
    ],
    lambda: {"write": (x := N.replace_description(c("stored"), c("origin"), c("incoming"), c("title")))["write"], "reason": x["reason"]},
)
cases(
    "display_links", "ticket string, page string", {"url": S, "label": S, "info": S, "venue": S},
    [
        ("https://ra.co/events/1", "https://a.org/e", "https://ra.co/events/1", "Get tickets", "https://a.org/e", None), ("https://a.org/e", None, "https://a.org/e", "Event details", None, None), ("https://a.org/", "https://b.org/e", "https://b.org/e", "Event details", None, "https://a.org/"), (None, "https://www.a.org", None, None, None, "https://www.a.org"),
        ("https://x.eventbrite.com/e/1", None, "https://x.eventbrite.com/e/1", "Get tickets", None, None), ("https://www.thehalodetroit.com/currentevents", "https://thehalodetroit.com/event/1", "https://thehalodetroit.com/event/1", "Event information", None, "https://www.thehalodetroit.com/currentevents"), ("x", " ", None, None, None, None), (None, None, None, None, None, None),
    ],
    lambda: {k: N.display_links(c("ticket"), c("page"))[k] for k in ("url", "label", "info", "venue")},
)
cases(
    "merge_link", "stored string, incoming string, generic boolean, other boolean", {"action": S},
    [("https://ra.co/events/1", None, False, False, "keep"), (None, "https://ra.co/events/1", None, False, "fill"), ("ra", "https://ra.co/events/1", False, False, "flag"), ("https://ra.co", "https://ra.co/events/1", True, False, "replace_generic"), ("https://www.ra.co/events/1/", "https://ra.co/events/1?x=1", False, False, "keep"), ("https://ra.co/events/2", "https://ra.co/events/1", False, False, "flag"), (None, "https://ra.co", False, True, "keep")],
    lambda: {"action": N.merge_link(c("stored"), c("incoming"), c("generic"), c("other"))},
)
cases(
    "title_evidence", "title string, t string, url string, name string, kind string", {"share": D, "owned": B, "tier": S},
    [("The Big Jazz Night", "a night of jazz", "https://www.bigjazz.org/x", "The Big Jazz", "venue", 0.5, True, "primary_authoritative"), ("A B", "a b", "https://facebook.com/x", "fb", "venue", 0.0, False, "discovery_only"), (None, None, None, None, None, 0.0, False, "discovery_only"), ("Jazz", "JAZZ!", "https://band.com", "Band", "artist", 1.0, True, "secondary_corroborating")],
    lambda: {"share": N.title_evidence(c("title"), c("t")), "owned": N.owned_by(c("url"), c("name")), "tier": N.source_tier(c("url"), c("kind"), ("facebook.com",))},
)
cases(
    "sentence_trim", "t string", {"t": S},
    [("Short  text.", "Short text."), ("A" * 60 + ". " + "b" * 500, "A" * 60 + "."), ("A. " + "b" * 500, "A. " + "b" * 397 + "…"), (None, None)],
    lambda: {"t": N.sentence_trim(c("t"))},
)

from .operators import repair as R  # noqa: E402
from .operators import venues as V  # noqa: E402


def frames(name: str, inputs: str, kinds: dict[str, str], rows: list[tuple], apply: Callable[[SparkSession, DataFrame], DataFrame]) -> None:
    """The same for an operator on tables: apply gets the orders as o_orderkey and the inputs, and returns o_orderkey and the outputs."""
    cases(name, inputs, kinds, rows, dict)
    table = QUERIES[name]
    width = len(rows[0]) - len(kinds)

    def run(spark, d):
        given = spark.createDataFrame([(i, *r[:width]) for i, r in enumerate(rows)], f"case_ int, {inputs}")
        orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.pmod("o_orderkey", F.lit(len(rows))).cast("int").alias("case_"))
        return apply(spark, orders.join(F.broadcast(given), "case_").drop("case_")).select("o_orderkey", *kinds)

    run.__name__ = table.__name__
    QUERIES[name] = run


_PLACES = [("Detroit", "Michigan", 42.33, -83.05, None), ("Troy", "Michigan", 42.6, -83.1, None), ("Grosse Pointe", "Michigan", 42.4, -82.9, None), ("Kingsville", "Ontario", 42.0, -82.7, None), ("Canton Township", "Michigan", 42.3, -83.5, None)]
_SECOND = [("Troy", "Ohio", 1.0, 1.0, None), ("Monroe", "Michigan", 41.9, -83.4, ["city feed"])]
frames(
    "city_located", "city string, source string, venue string", {"place_status": S, "place_reason": S, "place_key": S, "assumed": B, "lat": D},
    [
        (None, None, None, "placed", None, "detroit", True, 42.33), ("Troy", None, None, "placed", None, "troy", False, 42.6), ("  troy, MI 48084", None, None, "placed", None, "troy", False, 42.6), ("Troy, OH", None, None, "unplaced", "not-in-table", None, False, None), ("Grosse Pointe Park", None, None, "placed", None, "grosse pointe", False, 42.4),
        ("Ontario", None, "Town of Kingsville", "placed", None, "kingsville", False, 42.0), ("Ontario", None, "Hall", "unplaced", "not-in-table", None, False, None), ("Charter Twp of Canton", None, None, "placed", None, "canton township", False, 42.3), ("Charter Township of Canton", None, None, "placed", None, "canton township", False, 42.3),
        ("Canton Twp.", None, None, "placed", None, "canton township", False, 42.3), ("Monroe", "City Feed", None, "placed", None, "monroe", False, 41.9), ("Monroe", "Blog", None, "unplaced", "source-not-evidence", None, False, None), ("Monroe, MI", "Blog", None, "placed", None, "monroe", False, 41.9), ("Atlantis", None, None, "unplaced", "not-in-table", None, False, None),
    ],
    lambda spark, df: V.locate(df, V.city_lookup(*(spark.createDataFrame(x, "name string, region string, lat double, lng double, sources array<string>") for x in (_PLACES, _SECOND)))),
)
cases(
    "city_compared", "a string, b string", {"key": S, "differ": B},
    [
        ("Mt. Clemens, MI 48043", "Mount Clemens", "mount clemens", False), ("Charter Township of Canton", "Canton Twp", "canton", False), ("City of Troy", "Troy, Michigan, USA", "troy", False), ("Novi", "Troy", "novi", True), (None, "Troy", "", False), ("Sterling Hts", "Sterling Heights", "sterling heights", False), ("MI", "Troy", "mi", True),
        ("Isle of Palms", "Palms", "isle of palms", True),
    ],
    lambda: {"key": V.compare_city(c("a")), "differ": V.cities_differ(c("a"), c("b"))},
)
cases(
    "eligible_place", "status string, reason string, border double, miles double", {"why": S},
    [("placed", None, 10.0, 3.0, None), ("unplaced", "not-in-table", None, None, "not-in-table"), ("placed", None, 80.0, 3.0, "outside-orbit"), ("placed", None, 10.0, 30.0, "too-far")],
    lambda: {"why": V.eligible(c("status"), c("reason"), c("border"), c("miles"), 25.0)},
)
_VENUES = [(1, "The Majestic", "4140 Woodward Ave", "Detroit"), (2, "Hall", "1 Main St", "Troy"), (3, "Hall", "2 Main St", "Novi"), (4, "Bob’s Bar", None, "Troy"), (5, "Annex", "9 Oak St", "Troy"), (6, "Loft", "9 Oak St", "Troy"), (7, "Garden", "5 Elm St", "Novi")]
_KNOWN = [(1, True, "a"), (7, False, "a"), (7, False, "b"), (4, False, "a")]
frames(
    "venue_resolved", "venue_id long, name string, address string, city string, note string, source string", {"status": S, "reason": S, "venue": I, "tier": S},
    [
        (None, "The Majestic", None, None, "OWNER-CORRECTION x", None, "preserved", "OWNER_LOCKED", None, None), (None, "The Majestic", None, None, None, "Manual", "preserved", "OWNER_LOCKED", None, None), (None, "Online", None, None, None, None, "preserved", "ONLINE", None, None),
        (None, "Taco Food Truck", None, None, None, None, "preserved", "MOBILE", None, None), (None, "Multiple venues", None, None, None, None, "preserved", "MULTISITE", None, None), (None, "TBA", None, None, None, None, "preserved", "TBA", None, None), (99, "The Majestic", None, None, None, None, "conflict", "IDENTITY_CONFLICT", None, None),
        (2, "The Majestic", None, None, None, None, "conflict", "IDENTITY_CONFLICT", None, None), (2, "HALL", None, None, None, None, "verified", "VERIFIED_LINKED", 2, "linked"), (None, "the  majestic", None, "Detroit, MI", None, None, "verified", "VERIFIED_NAME", 1, "name"), (None, "Hall", None, None, None, None, "ambiguous", "AMBIGUOUS_NAME", None, None),
        (None, "Bob's Bar", None, None, None, None, "proposed", "SINGLE_SOURCE", 4, "name"), (None, "Garden", None, None, None, None, "verified", "VERIFIED_NAME", 7, "name"), (None, "Garden", None, "Troy", None, None, "conflict", "CITY_CONFLICT", None, None), (None, "Garden", "77 Elm St", "Novi", None, None, "conflict", "IDENTITY_CONFLICT", None, None),
        (None, "Somewhere", "9 Oak St", "Troy", None, None, "ambiguous", "AMBIGUOUS_ADDRESS", None, None), (None, "Somewhere", "5 Elm St", "Novi", None, None, "verified", "VERIFIED_ADDRESS", 7, "address"), (None, "Somewhere", "8 Elm St", "Novi", None, None, "unresolved", "NO_MATCH", None, None),
    ],
    lambda spark, df: df.join(
        V.resolve(df.withColumnRenamed("o_orderkey", "id"), spark.createDataFrame(_VENUES, "id long, name string, address string, city string"), spark.createDataFrame(_KNOWN, "venue_id long, canonical boolean, source string")).select(
            F.col("id").alias("o_orderkey"), "status", "reason", F.col("venue_id").cast("int").alias("venue"), "tier"), "o_orderkey"),
)
_LEARNED = [("the majestic", "canonical", "4140 Woodward Ave", "Detroit"), ("hall", "ambiguous", None, None), ("bob's bar", "single_source", "3 Oak St", "Troy"), ("garden", "conflict", None, None), ("loft", "learned", "9 Oak St", "Troy")]
frames(
    "gap_fill", "name string, address string, city string", {"action": S, "new_address": S, "new_city": S},
    [
        ("The Majestic", None, None, "fill", "4140 Woodward Ave", "Detroit"), ("Loft", None, "Troy, MI", "fill", "9 Oak St", None), ("Loft", None, "Novi", "conflict", None, None), ("Hall", None, None, "excluded", None, None), ("Bob’s Bar", None, None, "confirm", None, None), ("Garden", None, "Troy", "conflict", None, None),
        ("Nowhere", None, None, "unknown", None, None), ("Loft", "10 Oak St", None, "conflict", None, None), ("Loft", "9 Oak St", " ", "fill", None, "Troy"),
    ],
    lambda spark, df: V.fill_gaps(df.withColumnRenamed("o_orderkey", "id"), spark.createDataFrame(_LEARNED, "name_key string, status string, address string, city string")).select(F.col("id").alias("o_orderkey"), "action", F.col("address").alias("new_address"), F.col("city").alias("new_city")),
)
cases(
    "loose_title", "a string, b string", {"same": B},
    [("The Big Show!", "the big show", True), ("Big Show", "The Big Show 2026", True), ("Show", "Concert", False), (None, "x", False), ("", "", False)],
    lambda: {"same": R.loose_title(c("a"), c("b"))},
)
cases(
    "canonical_listing", "u string", {"url": S},
    [("/event/Big-Show/123/", "https://visit.org/event/big-show/123/"), ("https://visit.org/event/big-show/123?x=1", "https://visit.org/event/big-show/123/"), ("/events/123", None), (None, None)],
    lambda: {"url": R.canonical_listing(c("u"), "https://visit.org", "event")},
)
cases(
    "organizer_links", "title string, organizer string", {"url": S},
    [("Shake Some Action WFMU live", None, "https://x.org/1"), ("Party", "@shakesomeactionwfmu", "https://x.org/1"), ("Jazz at Bob's", None, "https://x.org/2"), ("Other", None, None)],
    lambda: {"url": R.by_pattern(F.concat_ws(" ", "title", "organizer"), [(r"(?i)shake\s+some\s+action\s+wfmu|@?shakesomeactionwfmu", "https://x.org/1"), ("(?i)jazz", "https://x.org/2")])},
)
cases(
    "calendar_page", "host string, source string, page string, feed boolean", {"url": S},
    [
        ("redfordtwp.gov", "x", None, True, "https://www.redfordtwp.gov/calendar.aspx"), ("redfordtwp.gov", "x", None, False, None), ("a.org", "HALO Detroit", None, False, "https://www.thehalodetroit.com/currentevents"), ("a.org", "x", "https://a.org/events/", True, "https://a.org/events/"), ("a.org", "x", "https://a.org/news", True, None),
        ("a.org", "x", "https://a.org/Calendar.aspx?m=1", True, "https://a.org/Calendar.aspx?m=1"),
    ],
    lambda: {"url": R.calendar_page(c("host"), c("source"), c("page"), c("feed"), {"redfordtwp.gov": "https://www.redfordtwp.gov/calendar.aspx"}, {"HALO Detroit": "https://www.thehalodetroit.com/currentevents"})},
)
cases(
    "description_tiers", "own string, page string, made string", {"value": S, "tier": S},
    [("A text", "B", "C", "A text", "stored"), (" ", "B ", "C", "B", "page"), (None, None, "C", "C", "generated"), (None, "", None, None, None)],
    lambda: {"value": (x := R.precedence(("stored", c("own")), ("page", c("page")), ("generated", c("made"))))["value"], "tier": x["tier"]},
)
_EDIT = 'note\nOWNER-CORRECTION 2026-01-02 e1 fields=title,city | {"actor":"a","changes":[{"f":"title","b":"x","a":"y"},{"f":"city","b":null,"a":"Troy"}]}\nOWNER-CORRECTION 2026-01-03 e2 fields=city | broken'
cases(
    "owner_corrections", "note string", {"fields": S, "edits": S},
    [(_EDIT, "city|title", "e1 title x y|e1 city - Troy"), ("nothing", "", ""), (None, "", "")],
    lambda: {"fields": F.array_join(R.owner_fields(c("note")), "|"), "edits": F.array_join(F.transform(R.owner_edits(c("note")), lambda e: F.concat_ws(" ", e["edit_id"], e["field"], F.coalesce(e["before"], F.lit("-")), e["after"])), "|")},
)
cases(
    "note_values", "note string", {"values": S, "line": S},
    [("ra_id=12 ¦ url = https://a.b/?x=1 ¦ free text ¦ ra_id=13", "ra_id=12|url=https://a.b/?x=1", "ra_id=12 ¦ url = https://a.b/?x=1 ¦ free text ¦ ra_id=13\nnew"), ("", "", "new"), (None, "", "new"), ("a  ", "", "a\nnew"), ("0n=10", "0n=10", "0n=10\nnew")],
    lambda: {"values": F.array_join(F.transform(F.map_entries(R.note_values(c("note"))), lambda e: F.concat_ws("=", e["key"], e["value"])), "|"), "line": R.note_line(c("note"), F.lit("new"))},
)
cases(
    "capped_json", "t string", {"t": S},
    [('{"a":1}', '{"a":1}'), ('{"a":1,"sample":["xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx"]}', '{"a":1}'), ('{"a":"' + "y" * 60 + '"}', None), (None, None)],
    lambda: {"t": R.capped_json(c("t"), 40)},
)

from .functions import describe as P  # noqa: E402
from .operators import areas as A  # noqa: E402

cases(
    "factual_description", "title string, venue string, day date, time string, whole boolean, free boolean, price double, said string", {"made": S, "only": B},
    [
        ("Jazz", "Hall", date(1997, 6, 5), "7 PM – 11:59 PM", False, False, 12.5, "Jazz takes place at Hall on June 5 at 7 PM.", "Jazz takes place at Hall on June 5 at 7 PM. Tickets from $12.5.", True),
        ("Jazz", "Venue TBA", date(1997, 6, 5), "7 PM", True, True, None, "Jazz takes place on June 5. Free admission.", "Jazz takes place on June 5. Free admission.", True), ("Jazz", None, None, None, False, False, None, "Jazz", None, False), (" ", "Hall", None, None, False, False, None, None, None, False),
        ("Jazz", "Hall", None, None, None, None, 10.0, "Jazz takes place at Hall. It is good.", "Jazz takes place at Hall. Tickets from $10.", False),
    ],
    lambda: {"made": P.factual(*(c(x) for x in ("title", "venue", "day", "time", "whole", "free", "price"))), "only": P.is_factual(c("said"), *(c(x) for x in ("title", "venue", "day", "time", "whole", "free", "price")))},
)
cases(
    "description_blocks", "t string", {"blocks": S},
    [("One\ntwo\n\n- a\n- b\nthree", "p:One/two|ul:a/b|p:three"), ("  \n\nx  \n\n\ny", "p:x|p:y"), ("1. a\n2) b", "ul:a/b"), (None, "")],
    lambda: {"blocks": F.array_join(F.transform(P.blocks(c("t")), lambda b: F.concat(b["kind"], F.lit(":"), F.array_join(b["lines"], "/"))), "|")},
)
cases(
    "covers_event", "title string, excerpt string", {"may": B},
    [("Jazz festival returns", None, True), ("Council votes", "On the budget", False), ("Opinion: the festival", None, False), ("A night out", "Tickets: $5, ticket office", True), (None, None, False)],
    lambda: {"may": P.covers_event(c("title"), c("excerpt"), ("opinion:",))},
)
cases(
    "city_in_address", "t string", {"street": S, "city": S, "state": S, "zip": S},
    [
        ("123 Main St Troy, MI 48084", "123 Main St", "Troy", "MI", "48084"), ("5 Oak Ave, Grosse Pointe Park Michigan", "5 Oak Ave", "Grosse Pointe Park", "MI", None), ("Main St Troy, MI", None, None, None, None), ("1 Elm St, Toledo, Ohio 43604-1234", "1 Elm St", "Toledo", "OH", "43604"), ("1 Elm St Toledo", None, None, None, None), (None, None, None, None, None),
        ("12 Troy, MI", None, None, None, None),
    ],
    lambda: {"street": (x := P.city_in_address(c("t"), {"MI": ("Troy", "Pointe Park", "Grosse Pointe Park"), "OH": ("Toledo",)}))["street"], "city": x["city"], "state": x["state"], "zip": P.zip_code(c("t"))},
)
cases(
    "feed_city", "city string, towns array<string>, tier string, place boolean, inside boolean", {"status": S, "evidence": S},
    [
        ("Troy", ["Troy", "Clawson"], "strong", False, None, "stored", "municipality"), ("Canton Twp", ["Canton Township"], "weak", False, None, "stored_compatible", "census_supported"), ("Place", ["Place"], "strong", True, None, "stored_compatible", "cdp_compatible"), ("Novi", ["Troy"], None, False, None, "stored_unverified", "none"),
        ("Detroit", ["Redford"], None, False, False, "needs_follow_up", "none"), ("Detroit", None, None, False, True, "stored", "boundary"), ("Detroit", ["Redford"], None, False, None, "needs_follow_up", "none"), ("Troy", None, None, False, None, "stored_unverified", "none"), (" ", ["Troy"], None, False, None, "no_city", "none"),
    ],
    lambda: {"status": (x := P.feed_city(c("city"), c("towns"), c("tier"), c("place"), c("inside")))["status"], "evidence": x["evidence"]},
)
cases(
    "geocode_answer", "found array<struct<lat:double,lng:double,state:string>>", {"status": S, "lat": D},
    [([(42.0, -83.0, "MI")], "ok", 42.0), ([(42.0, -83.0, "MI"), (42.0002, -83.0, "MI")], "ok", 42.0), ([(42.0, -83.0, "MI"), (42.0003, -83.0, "MI")], "ambiguous", None), ([(42.0, -83.0, "MI"), (42.5, -83.0, "MI")], "ambiguous", None), ([(42.0, -83.0, "OH")], "other_state", None), ([], "no_match", None), (None, "no_match", None)],
    lambda: {"status": (x := A.geocode_answer(c("found"), F.lit("MI")))["status"], "lat": x["lat"]},
)

from .functions import nonevents as Q  # noqa: E402
from .sources import calendar as C  # noqa: E402

cases(
    "non_event_rule", "t string", {"rule": S},
    [
        ("Closed for a private event", "closed_for_private_event"), ("CLOSED FOR PRIVATE EVENTS tonight at 6", "closed_for_private_event"), ("Big Game - VIP Suite Rental", "suite_rental"), ("Private Event", "private_event_label"), ("DIA: Private Party!", "private_event_label"), ("THE Private Party", None),
        ("Library Closed", "closure_notice"), ("City Offices Closed for Labor Day", "closure_notice"), ("Labor Day - Library Closed", "closure_notice"), ("Why the library closed", None), ("Library closed but our hearts open", None), ("City Council Meeting", "governance_meeting"), ("Planning Commission", "governance_meeting"),
        ("Regular Meeting of the Village Council", "governance_meeting"), ("CANCELLED: Zoning Board of Appeals - Agenda", "governance_meeting"), ("Public Hearing on the budget", "governance_meeting"), ("Garden Club General Meeting 7 PM", "governance_meeting"), ("Meet the City Council", None), ("City Council Holiday Party", None), ("Jazz Night", None), (None, None),
        ("x" * 201, None),
    ],
    lambda: {"rule": Q.non_event(c("t"))},
)
cases(
    "folded_lines", "t string", {"folded": S, "octets": I},
    [("short", "short", 5), ("a" * 75, "a" * 75, 75), ("a" * 76, "a" * 75 + "\r\n a", 75), ("a" * 150, "a" * 75 + "\r\n " + "a" * 74 + "\r\n a", 75), ("é" * 40, "é" * 37 + "\r\n " + "é" * 3, 74), (None, None, None)],
    lambda: {"folded": C.fold(c("t")), "octets": F.array_max(F.transform(F.split(C.fold(c("t")), "\r\n"), F.octet_length))},
)
cases(
    "run_together", "t string", {"t": S},
    [("Ends at 8:50 p.m.Saturdays too", "Ends at 8:50 p.m. Saturdays too"), ("Music Hall!Our mission", "Music Hall! Our mission"), ("See a.org.The end", "See a.org.The end"), ("J.R.Smith", "J.R.Smith"), (None, None)],
    lambda: {"t": X.parted(c("t"))},
)
cases(
    "names_overlap", "a string, b string", {"same": B, "words": S},
    [("The Majestic Theatre", "Majestic", True, "majestic|theatre"), ("Hall", "Hall’s", True, "hall"), ("", "Hall", False, ""), ("Café Zoë", "café", True, "café|zoë"), ("A B", "A C", False, "a|b")],
    lambda: {"same": X.names_overlap(c("a"), c("b")), "words": F.array_join(X.name_words(c("a")), "|")},
)
_READY = ("official", "relevant", "identified", "acquired", "rights", "image_started", "approved", "ended", "excluded")
cases(
    "readiness", ", ".join(f"{x} boolean" for x in _READY), {"state": S},
    [
        (True, True, True, True, True, True, True, False, False, "PUBLISHED"), (True, True, True, True, True, True, True, True, False, "ENDED"), (True, True, True, True, True, True, False, False, False, "READY_FOR_REVIEW"), (True, True, True, True, False, True, True, False, False, "IMAGE_PENDING"),
        (True, True, True, False, False, False, True, False, False, "CONTENT_VERIFIED"), (True, False, True, True, True, True, True, False, False, "HOLD_UNVERIFIED"), (True, True, True, True, True, True, True, False, True, "HOLD_UNVERIFIED"), (None, True, True, True, True, True, True, False, False, "HOLD_UNVERIFIED"),
    ],
    lambda: {"state": K.readiness({x: c(x) for x in _READY})},
)
cases(
    "season_expiration", "last string, evidence string, review string, action string", {"states": S, "failing": B},
    [
        ("1997-06-01", "site", None, None, "SEASON_ENDED", True), ("1997-06-01", "site", "1997-06-11", "keep", "SEASON_ENDED|REVIEW_DUE", False), ("1997-06-01", "site", None, "unpublish", "SEASON_ENDED", True), ("1997-06-30", "site", None, None, "", False), ("1997-06-01", None, None, None, "INSUFFICIENT_EVIDENCE", False),
        ("soon", "site", "1998-01-01", None, "INSUFFICIENT_EVIDENCE", False), (None, None, "1997-01-01", None, "REVIEW_DUE|INSUFFICIENT_EVIDENCE", False),
    ],
    lambda: {"states": F.array_join((x := K.expiration(c("last"), c("evidence"), c("review"), c("action"), F.lit(date(1997, 6, 11))))["states"], "|"), "failing": x["failing"]},
)
