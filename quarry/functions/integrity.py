"""What is wrong with an event: integrity codes, the publication gate, coverage checks, and which text or link may replace another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quality import codes, first_reason, worst
from . import urls
from .classes import placeholder_venue, says
from .text import blank, description_quality, plain, present
from .tokens import bound

#: Limits and the patterns that mark placeholders.
LONG_RUN, LONGEST_RUN = 30, 366
SET_TIMES = r"(?i)^(?:tba|tbd|time tba|to be announced|see (?:website|description)|n/?a|none|null|undefined|-+)$"
BROKEN_TIMES = ("nan", "undefined", "invalid date", "null")
REGIONS = r"(?i)^(?:mi|michigan|on|ontario|oh|ohio|usa|us|canada|united states)\.?$"
CITY_TAIL = r"(?i)(?:,\s*|\s+)(?:mi|michigan|on|ontario)\.?\s*(?:\d{5}(?:-\d{4})?)?\s*$|\b\d{5}(?:-\d{4})?\b"
BOILERPLATE = (
    r"(?i)\bfacebook\s+instagram\s+(?:linkedin|twitter|x|youtube|tiktok)\b|(?:\bcopyright\b|©)[^\n]{0,80}?\ball rights reserved\b|\bthis (?:website|site) uses cookies\b|\bsubscribe to (?:our|the) newsletter\b|"
    r"\bsign up for (?:our|the) newsletter\b|\blorem ipsum\b|\bjavascript (?:is )?(?:required|disabled)\b|\benable javascript\b"
)
NO_TICKET = ("door", "rsvp_no_advance_sale", "free", "registration_required")
GENERIC_PAGES = ("motorcitywine.com/calendar",)
#: Days a listing may lie in the past or future, and may run, at the gate; days a checked link is fresh.
PAST_DAYS, FUTURE_DAYS, SPAN_DAYS, FRESH_DAYS = 366, 730, 400, 14
#: Titles and cities that say nothing, staff's words that no visitor may read, markup, and titles that leave open whether all may come.
NO_TITLES = r"(?i)^(?:untitled(?: event)?|tbd|tba|n/?a|none|null|undefined|event|test|no title)$"
STAFF_WORDS = ("jody", "spot-check", "spotcheck", "before approving", "machine-guessed", "internal note", "included per", "dup_merged_into", "ra_enrichment")
STAFF_FORMS = r"(?i)\b(?:todo|follow-?up):|\bresearched 20\d\d-\d\d|\bgate v\d"
MARKUP_TAGS = ("style", "script")
UNCERTAIN_TITLES = ("by appointment", "appointment only", "appointments only", "private tour", "private session", "private lesson", "consultation", "closed to the public")
#: Columns that visitors read, by their names here.
PUBLIC_TEXT = ("title", "description", "raw_name", "raw_address", "raw_city")


#: What a text is trimmed of.
WHITE = " \t\n\x0b\f\r\u00a0"


def _text(x: Column) -> Column:
    return F.coalesce(F.trim(x, F.lit(WHITE)), F.lit(""))


def plain_city(x: Column) -> Column:
    """A city for comparison: no state or ZIP, St is saint, no township, letters only."""
    t = F.regexp_replace(F.lower(_text(x)), CITY_TAIL, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\bst\.?\s", "saint "), r"\btwp\.?(?=\s|$)|\btownship\b|\bcity of\b", "")
    return F.trim(F.regexp_replace(t, "[^a-z]+", " "))


def _dates(start: Column, end: Column) -> list[tuple[str, str, Column]]:
    s, e = start.try_cast("date"), end.try_cast("date")
    run = F.datediff(e, s)
    return [
        ("date.malformed_start", "blocked", s.isNull()), ("date.malformed_end", "needs_decision", (end != "") & e.isNull()), ("date.end_before_start", "blocked", run < 0),
        ("date.range_over_year", "needs_decision", run > LONGEST_RUN), ("date.long_range", "advisory", run.between(LONG_RUN + 1, LONGEST_RUN)),
    ]


def _times(t: Column, all_day: Column) -> list[tuple[str, str, Column]]:
    broken = says(t, BROKEN_TIMES) & (t != "")
    return [("time.malformed", "needs_decision", broken), ("time.placeholder", "advisory", t.rlike(SET_TIMES) & ~broken), ("time.missing", "advisory", (t == "") & ~F.coalesce(all_day, F.lit(False)))]


def _places(e: dict[str, Column]) -> list[tuple[str, str, Column]]:
    raw, linked, shown = e["raw_city"], e["venue_city"], e["shown"]
    free, unset = F.coalesce(e["no_fixed_venue"], F.lit(False)), e["unset"]
    apart = e["linked_plain"] != e["raw_plain"]
    region = ~unset & shown.rlike(REGIONS)
    named = (shown != "") & ~unset & ~region & ~free
    has_address = (e["raw_address"] != "") | (raw != "") | (e["venue_address"] != "")
    both = (e["linked_plain"] != "") & (e["raw_plain"] != "")
    return [
        ("venue.missing", "needs_decision", (shown == "") & ~free), ("place.placeholder_asserts_city", "needs_decision", unset & (linked != "") & apart), ("venue.placeholder", "advisory", unset & ~((linked != "") & apart)),
        ("venue.not_a_place", "needs_decision", region), ("venue.name_is_city", "advisory", named & (raw != "") & (e["shown_plain"] != "") & (e["shown_plain"] == e["raw_plain"])), ("place.address_missing", "advisory", named & ~has_address),
        ("place.city_conflict", "needs_decision", ~unset & both & apart), ("place.city_state_zip", "repairable", raw.rlike(CITY_TAIL) | linked.rlike(CITY_TAIL)),
    ]


#: What a link of each class means, for either field of a row.
LINK_CODES = {"feed_export": ("link.feed_export", "repairable"), "malformed": ("link.malformed", "needs_decision"), "wrong_event": ("link.wrong_event", "repairable"), "homepage": ("link.homepage", "advisory"), "shared_generic": ("link.shared_generic", "advisory")}


def _links(e: dict[str, Column]) -> list[tuple[str, str, Column]]:
    kinds = [e[f"{f}_kind"] for f in ("event_url", "ticket_url")]
    feeds = [urls.is_export(F.split_part(e[f], F.lit("?"), F.lit(1)), F.split_part(F.concat(e[f], F.lit("?")), F.lit("?"), F.lit(2))) for f in ("event_url", "ticket_url")]
    none = (kinds[0] == "missing") & (kinds[1] == "missing")
    each = [(code, state, (kinds[0] == kind) | (kinds[1] == kind)) for kind, (code, state) in LINK_CODES.items()]
    relative = [(k == "relative", f) for k, f in zip(kinds, feeds, strict=True)]
    return [
        ("link.relative_feed", "repairable", (relative[0][0] & relative[0][1]) | (relative[1][0] & relative[1][1])), ("link.relative", "repairable", (relative[0][0] & ~relative[0][1]) | (relative[1][0] & ~relative[1][1])), *each,
        ("link.none", "advisory", none & ~F.coalesce(e["ticket_status"].isin(*NO_TICKET), F.lit(False))), ("link.ticket_missing_onsale", "advisory", (e["ticket_status"] == "onsale") & (kinds[1] == "missing")),
    ]


#: Codes of what description_quality says.
TEXT_CODES = {"placeholder": "description.placeholder", "bare_url": "description.not_descriptive", "time_only": "description.not_descriptive", "truncated": "description.truncated", "unrelated_to_title": "description.unrelated_to_title", "restates_title": "description.restates_title"}


def _descriptions(e: dict[str, Column]) -> list[tuple[str, str, Column]]:
    d, page, quality = e["description"], e["page"], e["quality"]
    same = (d != "") & (F.lower(d) == F.lower(e["title"]))
    found = {code: F.lit(False) for code in TEXT_CODES.values()}
    for q, code in TEXT_CODES.items():
        found[code] = found[code] | (quality == q)
    found["description.placeholder"] = found["description.placeholder"] | same
    others = [(code, "advisory", ~page & (d != "") & hit & (~same if code != "description.placeholder" else F.lit(True))) for code, hit in found.items()]
    return [("description.missing", "advisory", d == ""), ("description.publisher_boilerplate", "repairable", page), *others, ("description.generated", "advisory", e["description_source"] == "generated")]


def _standing(e: dict[str, Column]) -> list[tuple[str, str, Column]]:
    source, record = e["source"] == "", e["external_id"] == ""
    return [
        ("provenance.no_source", "needs_decision", source), ("provenance.no_source_record_id", "advisory", ~source & record), ("duplicate.needs_review", "needs_decision", e["duplicate"] == "review"),
        ("duplicate.pending_merge", "advisory", e["duplicate"] == "merge"), ("currency.not_reseen", "advisory", e["currency"] == "stale"),
    ]


#: Columns that the codes are read from; one that a table lacks counts as null.
FIELDS = (
    "title", "start_date", "end_date", "time", "all_day", "raw_name", "raw_city", "raw_address", "venue_name", "venue_city", "venue_address", "no_fixed_venue", "event_url", "ticket_url", "event_url_shared", "ticket_url_shared",
    "own_id", "ticket_status", "description", "description_source", "source", "external_id", "duplicate", "currency",
)


_FLAGS = ("all_day", "no_fixed_venue", "event_url_shared", "ticket_url_shared")
_TEXTS = ("title", "start_date", "end_date", "time", "raw_name", "raw_city", "raw_address", "venue_name", "venue_city", "venue_address", "event_url", "ticket_url", "description", "source", "external_id")


def _whole(fields: dict[str, Column]) -> dict[str, Column]:
    return {f: fields.get(f, F.lit(None).cast("boolean" if f in _FLAGS else "string")) for f in FIELDS}


def _read(e: dict[str, Column], raw_title: Column) -> dict[str, Column]:
    """What many codes read, of a row whose texts are trimmed."""
    shown = F.when(e["venue_name"] != "", e["venue_name"]).otherwise(e["raw_name"])
    kinds = {f"{f}_kind": urls.link_class(e[f], F.coalesce(e[f"{f}_shared"], F.lit(False)), e["own_id"], GENERIC_PAGES) for f in ("event_url", "ticket_url")}
    cities = {"shown_plain": plain_city(shown), "raw_plain": plain_city(e["raw_city"]), "linked_plain": plain_city(e["venue_city"])}
    return {**kinds, **cities, "shown": shown, "unset": placeholder_venue(shown), "page": e["description"].rlike(BOILERPLATE), "quality": description_quality(e["description"], raw_title)}


def _found(e: dict[str, Column]) -> Column:
    return codes([("title.missing", "blocked", e["title"] == ""), *_dates(e["start_date"], e["end_date"]), *_times(e["time"], e["all_day"]), *_places(e), *_links(e), *_descriptions(e), *_standing(e)])


def integrity(fields: dict[str, Column]) -> Column:
    """struct(state, codes): every code that holds with its rank, and the worst state among them. For many rows with_integrity() is faster."""
    e = _whole(fields)
    use = lambda step, then: bound(F.struct(*(v.alias(k) for k, v in step.items())), lambda x: then({k: x[k] for k in step}))
    verdict = lambda t: bound(_found(t), lambda found: F.struct(worst(found).alias("state"), found.alias("codes")))
    return use({f: _text(e[f]) for f in _TEXTS}, lambda texts: use(_read(e | texts, e["title"]), lambda seen: verdict(e | texts | seen)))


def with_integrity(df: DataFrame, fields: dict[str, Column], name: str) -> DataFrame:
    """df with integrity(fields) as a new column. Each step is a projection of its own, so its columns are worked out once and all of it is compiled, which a lambda isn't."""
    e = _whole(fields)

    def step(d: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
        return d.select("*", *(v.alias(f"_{name}_{k}") for k, v in columns.items())), {k: F.col(f"_{name}_{k}") for k in columns}

    d, texts = step(df, {f: _text(e[f]) for f in _TEXTS})
    d, seen = step(d, _read(e | texts, e["title"]))
    d, found = step(d, {"found": _found(e | texts | seen)})
    return d.select(*df.columns, F.struct(worst(found["found"]).alias("state"), found["found"].alias("codes")).alias(name))


def gate(
    fields: dict[str, Column], today: Column, known_city: Column, non_event: Column, inside: Column | None = None, time_required: bool = False, strict_city: bool = False, authoritative: bool = False, uncertain: Column | None = None,
) -> Column:
    """struct(decision, issues, eligibility) for a row about to be written: skip, reject, hold or publish, by the gravest issue.

    non_event names the rule by which a title is no event; inside is null where the orbit is unknown; uncertain is the caller's own doubt.
    An issue of a public text comes once for each text that has it.
    """
    names = ("title", "external_id", "source", "category", "start_date", "end_date", "time", "raw_city", "raw_name", "raw_address", "venue_id", "description", "description_source")
    e = {f: fields.get(f, F.lit(None).cast("string")) for f in names}
    iso = lambda x: F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date"))
    s, f = iso(e["start_date"]), iso(e["end_date"])
    city, time, title = _text(e["raw_city"]), _text(e["time"]), F.coalesce(e["title"], F.lit(""))
    has_digit, region = city.rlike(r"\d"), city.rlike(r",|\b(?:MI|OH|Michigan|Ohio|Ontario|ON)\b\.?$")
    unset = lambda x: _text(x).rlike(NO_TITLES)
    ends = ~blank(e["end_date"]) & s.isNotNull()
    doubtful = non_event.isNull() & (says(title, UNCERTAIN_TITLES) | (F.coalesce(uncertain, F.lit(False)) if uncertain is not None else F.lit(False)))
    staff = lambda x: says(x, STAFF_WORDS) | F.coalesce(x, F.lit("")).rlike(STAFF_FORMS)
    markup = lambda x: F.exists(F.split(F.lower(F.coalesce(x, F.lit(""))), "<"), lambda p: F.regexp_extract(F.ltrim(p), r"^(\w+)", 1).isin(*MARKUP_TAGS)) & F.contains(x, F.lit("<"))
    table = [
        ("TITLE_MISSING", "skip", blank(e["title"])), ("TITLE_PLACEHOLDER", "hold", unset(e["title"])), ("IDENTITY_MISSING", "skip", blank(e["external_id"])), ("SOURCE_MISSING", "hold", blank(e["source"])), ("CATEGORY_MISSING", "skip", blank(e["category"])),
        ("START_DATE_INVALID", "skip", s.isNull()), ("START_DATE_IMPLAUSIBLE", "hold", ~F.datediff(s, today).between(-PAST_DAYS, FUTURE_DAYS)), ("END_DATE_INVALID", "hold", ends & f.isNull()), ("END_BEFORE_START", "hold", ends & (f < s)),
        ("SPAN_IMPLAUSIBLE", "hold", ends & (F.datediff(f, s) > SPAN_DAYS)), ("TIME_MISSING", "hold", F.lit(time_required) & (time == "")), ("TIME_PLACEHOLDER", "info", time.rlike(r"(?i)^(?:evening|tba|tbd|varies|see (?:lineup|site|website))$")),
        ("ADDRESS_IN_CITY", "hold", has_digit), ("CITY_HAS_REGION", "hold", ~has_digit & region), ("CITY_PLACEHOLDER", "hold", ~has_digit & ~region & unset(e["raw_city"])),
        ("CITY_UNRECOGNIZED", "hold" if strict_city else "info", (city != "") & ~has_digit & ~region & ~unset(e["raw_city"]) & ~F.coalesce(known_city, F.lit(False))), ("OUTSIDE_ORBIT", "hold", ~inside if inside is not None else F.lit(False)),
        ("ORBIT_UNKNOWN", "hold", inside.isNull() if inside is not None else F.lit(False)), ("VENUE_UNLINKED", "info", ~blank(e["raw_name"]) & blank(e["venue_id"].cast("string"))), ("NOT_AN_EVENT", "reject", non_event.isNotNull()), ("ELIGIBILITY_UNCERTAIN", "hold", doubtful),
        *((code, "hold", test(e[x])) for x in PUBLIC_TEXT for code, test in (("INTERNAL_COMMENTARY_IN_PUBLIC_FIELD", staff), ("MARKUP_IN_TEXT", markup))),
        ("PROVENANCE_CLAIM_UNSUPPORTED", "info", (e["description_source"] == "authoritative") & F.lit(not authoritative)), ("PROVENANCE_WITHOUT_DESCRIPTION", "info", F.coalesce(e["description_source"] != "", F.lit(False)) & blank(e["description"])),
    ]
    holds = [(F.concat(F.lit("NOT_AN_EVENT:"), non_event) if n == "NOT_AN_EVENT" else F.lit(n), k, F.coalesce(c, F.lit(False))) for n, k, c in table]
    found = F.array_compact(F.array(*(F.when(c, F.struct(n.alias("issue"), F.lit(k).alias("kind"))) for n, k, c in holds)))

    def verdict(x: Column) -> Column:
        decision = first_reason([(k, F.exists(x, lambda i: i["kind"] == k)) for k in ("skip", "reject", "hold")], "publish")  # noqa: B023
        return F.struct(decision.alias("decision"), F.transform(x, lambda i: i["issue"]).alias("issues"), F.when(non_event.isNotNull(), "negative").when(F.coalesce(doubtful, F.lit(False)), "uncertain").otherwise("positive").alias("eligibility"))

    return bound(found, verdict)


def coverage(found: Column, fields: dict[str, Column], locked: Column, currency: Column, row_level: Column, now: Column, fresh_days: int = FRESH_DAYS) -> Column:
    """struct of outcomes (pass, review, fail, unchecked), one for each check; found are the row's finding codes."""
    e, no = fields, F.lit(False)
    has = lambda *c: F.arrays_overlap(found, F.array(*(F.lit(x) for x in c)))
    verdict = lambda *rules: first_reason(list(rules), "unchecked")
    fresh = verdict(("pass", row_level & (currency == "current")), ("review", row_level & (currency == "stale")))
    quality = description_quality(e["description"], e["title"])
    no_time = ~F.coalesce(e["all_day"], no) & blank(e["time"])
    link = lambda x: F.coalesce(x, F.lit("")).rlike(r"(?i)^https?://[^\s]+$")
    age = F.datediff(now, e["checked_at"])
    return F.struct(
        verdict(("fail", has("required_fact_missing", "contradictory_fact")), ("pass", F.lit(True))).alias("required_facts"), verdict(("fail", has("venue_placeholder")), ("pass", e["venue_id"].isNotNull())).alias("venue_linked"),
        verdict(("fail", has("venue_placeholder")), ("review", has("venue_resolution_review")), ("pass", F.coalesce(e["venue_verified"], no))).alias("venue"), fresh.alias("freshness"),
        verdict(("review", has("start_time_unconfirmed", "occurrences_unconfirmed")), ("unchecked", F.arrays_overlap(locked, F.array(F.lit("time_display"), F.lit("start_date")))), ("pass", fresh == "pass")).alias("date_time"),
        verdict(("review", has("same_venue_same_start_review", "same_event_link_collision", "same_venue_time_unresolved", "cross_source_title_date_review")), ("pass", F.coalesce(e["compared"], no))).alias("pair_scan"),
        verdict(("fail", quality != "ok"), ("review", has("metadata_only_description_candidate") | no_time), ("pass", F.lit(True))).alias("description_time"),
        verdict(("fail", ~link(e["event_url"]) & ~link(e["ticket_url"])), ("fail", e["link_status"] == "dead"), ("review", e["link_status"] != "ok"), ("pass", (e["link_status"] == "ok") & (age <= fresh_days))).alias("stored_link"),
        verdict(("fail", blank(e["image_url"]) | F.contains(F.lower(e["image_url"]), F.lit("/assets/placeholders/"))), ("pass", F.lit(True))).alias("image_presence"),
    )


#: Ranks of texts by where they come from.
TEXT_RANKS = {"blank": 0, "source_poor": 1, "generated": 2, "source_ok": 3, "authoritative": 4, "manual": 5}


def replace_description(stored: Column, stored_source: Column, incoming: Column, title: Column) -> Column:
    """struct(write, reason): a source's text fills a blank, replaces a weaker text, and refreshes its own."""
    good = lambda x: F.when(blank(x), "blank").when(description_quality(x, title) == "ok", "source_ok").otherwise("source_poor")
    old, new = F.when(~blank(stored) & stored_source.isin("manual", "authoritative", "generated"), stored_source).otherwise(good(stored)), good(incoming)
    rank = lambda k: F.element_at(F.create_map(*(F.lit(v) for kv in TEXT_RANKS.items() for v in kv)), k)
    reason = first_reason([
        ("incoming_blank_never_replaces", new == "blank"), ("fill_blank", old == "blank"), ("outranks_stored", rank(new) > rank(old)), ("source_refresh", (new == "source_ok") & (old == "source_ok")),
    ], "stored_is_stronger_or_equal")
    return F.struct(reason.isin("fill_blank", "outranks_stored", "source_refresh").alias("write"), reason.alias("reason"))


#: Hosts that sell tickets, and pages that stand for a whole venue.
VENDORS = (
    "ra.co", "eventbrite.com", "dice.fm", "ticketmaster.com", "livenation.com", "axs.com", "seetickets.us", "ticketweb.com", "eventim.us", "showclix.com", "universe.com", "ticketleap.com", "posh.vip", "fearticket.com", "etix.com",
    "tixr.com", "crowdwork.com", "veezi.com", "spektrix.com", "evyy.net", "pxf.io", "sjv.io",
)
VENUE_PAGES = {"thehalodetroit.com": ("", "/currentevents")}


def display_links(ticket: Column, page: Column) -> Column:
    """struct(url, label, info, venue): the vendor's page first, else the page with the information; a homepage is the venue's."""
    bare = lambda u: F.regexp_replace(urls.host(u), r"^www\.|:\d+$", "")
    used = lambda u: F.when(present(u).rlike(r"(?i)^https?://[^\s/]"), present(u))
    root = lambda u: F.lower(F.rtrim(urls.path(u), F.lit("/")))
    whole = lambda u: ~F.contains(u, F.lit("#")) & (((root(u) == "") & (urls.query(u) == "")) | F.greatest(F.lit(False), *((bare(u) == h) & root(u).isin(*p) for h, p in VENUE_PAGES.items())))
    t, p = used(ticket), used(page)
    own, info = F.when(~whole(t), t), F.when(~whole(p), p)
    sells = F.greatest(F.lit(False), *((bare(own) == h) | F.endswith(bare(own), F.lit("." + h)) for h in VENDORS))
    vendor = F.when(sells, own)
    about = F.coalesce(F.when(vendor.isNull(), own), info)
    label = lambda u: F.when(bare(u).isin(*VENUE_PAGES), "Event information").otherwise("Event details")
    home = F.coalesce(F.when(own.isNull(), t), F.when(info.isNull(), p))
    return F.struct(
        F.coalesce(vendor, about).alias("url"), F.when(vendor.isNotNull(), "Get tickets").when(about.isNotNull(), label(about)).alias("label"), F.when(vendor.isNotNull() & (about != vendor), about).alias("info"), home.alias("venue"),
    )


def merge_link(stored: Column, incoming: Column, generic: Column, incoming_generic: Column) -> Column:
    """What becomes of a link that a source sends: fill, replace_generic, keep, or flag where two specific ones differ."""
    same = lambda u: F.lower(F.regexp_replace(F.regexp_replace(present(u), r"^https?://(www\.)?", ""), r"[?#].*$|/+$", ""))
    return first_reason([
        ("keep", blank(incoming) | F.coalesce(incoming_generic, F.lit(False))), ("fill", blank(stored)), ("flag", ~present(stored).rlike("(?i)^https?://")), ("replace_generic", F.coalesce(generic, F.lit(False))), ("keep", same(stored) == same(incoming)),
    ], "flag")


def title_evidence(title: Column, text: Column, least: int = 3) -> Column:
    """Share of a title's words of some length that a text holds; 0 where it has none."""
    words = lambda x: F.array_distinct(F.split(plain(x), " "))
    own = F.filter(words(title), lambda w: F.length(w) >= least)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, words(text))), F.size(own)), F.lit(0.0))


def owned_by(url: Column, name: Column) -> Column:
    """A site's host holds the letters of a name of three at least, without a leading 'the'."""
    token = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^the\s+", ""), "[^a-z0-9]", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(urls.host(url), r"^www\.", ""), r"\.[a-z]+$", ""), "[^a-z0-9]", "")
    return (F.length(token) >= 3) & F.contains(host, token)


def source_tier(url: Column, matched_on: Column, unofficial: tuple[str, ...]) -> Column:
    host = F.regexp_replace(urls.host(url), r"^www\.", "")
    official = (host != "") & ~host.isin(*unofficial)
    return first_reason([("secondary_corroborating", official & (F.lower(matched_on) == "artist")), ("primary_authoritative", official & F.lower(matched_on).isin("venue", "organizer"))], "discovery_only")


def sentence_trim(text: Column, most: int = 400) -> Column:
    """A text of at most so many characters: up to its last full sentence, else cut with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.left(t, F.lit(most))
    stop = F.length(head) - F.locate(" .", F.reverse(head))  # the last '. '
    return F.when(F.length(t) <= most, t).when((F.locate(" .", F.reverse(head)) > 0) & (stop > 41), F.left(head, stop)).otherwise(F.concat(F.trim(head), F.lit("…")))

