"""Events of approved feeds as rows: calendars and RSS, with places read from what a feed states."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import no_fixed_venue, says
from ..functions.clocktext import clock, explicit_date
from ..functions.dates import ZONE
from ..functions.nonevents import non_event
from ..functions.text import blank, decoded, present
from ..functions.tokens import bound
from ..functions.urls import is_export, resolve
from .pages import rfc822

# Regions that feeds state, and how long a name and a city may be where no street tells them from prose.
REGIONS, COUNTRIES = ("ON", "MI", "OH", "Ontario", "Michigan", "Ohio"), ("united states", "usa", "canada")
LONGEST_NAME, LONGEST_CITY, LONGEST_ID, LONGEST_DESCRIPTION = 55, 25, 250, 1000
_ZIP, _POSTAL = r"\d{5}(?:-\d{4})?", r"[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d"
#: Words of categories, in order.
CATEGORIES = {
    "fest": ("festival", "fest"), "vendor": ("market", "fair", "expo", "vendor"), "music": ("concert", "concert tour", "album", "band", "musician", "dj"), "film": ("screening", "film", "movie", "cinema"), "theatre": ("theatre", "theater", "play"),
    "dance": ("dance", "ballet"), "museum": ("museum",), "family": ("family", "kids"), "food": ("food", "tasting", "culinary"), "nightlife": ("nightlife", "club", "bingo"), "sports": ("sport", "sports", "game", "athletic"), "training": ("training", "workshop", "class", "seminar"),
}
PLACE = "struct<status:string,name:string,address:string,city:string,region:string,postal:string,country:string,raw:string>"


def category_by_words(title: Column, text: Column, table: Mapping[str, tuple[str, ...]] = CATEGORIES) -> Column:
    """The first category one of whose words a title or text has; null if none."""
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    any_word = tuple(w for words in table.values() for w in words)
    return bound(both, lambda x: F.when(says(x, any_word), F.coalesce(*(F.when(says(x, words), name) for name, words in table.items()))))


def _place(status: str, **parts: Column) -> Column:
    names = ("name", "address", "city", "region", "postal", "country", "raw")
    text = lambda x: F.nullif(F.trim(x), F.lit("")) if x is not None else F.lit(None).cast("string")
    return F.struct(F.lit(status).alias("status"), *(text(parts.get(n)).alias(n) for n in names))


def _listed(t: Column) -> Column:
    """'Name, street, city, region, postal code, country', read from its end; the region or the postal code has to be there."""

    last = lambda a, k: F.try_element_at(a, F.lit(-k))
    less = lambda a, cond: F.when(cond, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)

    def country(p: Column) -> Column:
        land = F.lower(last(p, 1)).isin(*COUNTRIES)
        return F.struct(less(p, land).alias("parts"), F.when(land, last(p, 1)).alias("country"))

    def code(x: Column) -> Column:
        found = F.regexp_extract(last(x["parts"], 1), rf"({_ZIP}|{_POSTAL})", 1)
        return bound(found, lambda k: F.struct(less(x["parts"], k != "").alias("parts"), x["country"].alias("country"), k.alias("code")))

    def region(x: Column) -> Column:
        end = last(x["parts"], 1)
        known = end.rlike("^[A-Za-z]{2}$") | end.isin(*REGIONS)
        return F.struct(x["parts"].alias("parts"), x["country"].alias("country"), x["code"].alias("code"), known.alias("known"), F.when(known, end).alias("region"))

    def place(x: Column) -> Column:
        def fit(c: Column) -> Column:
            fits = ((x["code"] != "") | x["known"]) & (F.size(c) >= 3)
            return F.when(fits, _place("parsed", name=F.array_join(F.slice(c, F.lit(1), F.size(c) - 2), ", "), address=last(c, 2), city=last(c, 1), region=x["region"], postal=x["code"], country=x["country"]))

        return bound(less(x["parts"], x["known"]), fit)

    out = F.transform(F.split(t, ","), lambda x: F.trim(x))
    for step in (country, code, region, place):
        out = bound(out, step)
    return out


def _dashed(t: Column) -> Column:
    """'Name - street  city ST 12345', with a name, a street, both or neither; two spaces part street and city."""
    tail = rf"^(.*\S)\s+([A-Z]{{2}})\s+({_ZIP})$"
    ends = F.struct(*(F.regexp_extract(t, tail, k).alias(n) for k, n in enumerate(("head", "region", "postal"), 1)))

    def split(x: Column) -> Column:
        head = x["head"]
        from_end = F.instr(F.reverse(head), " - ")  # the last dash that stands alone
        return bound(from_end, lambda n: named(x, n))

    def named(x: Column, n: Column) -> Column:
        head, dash, at = x["head"], n > 0, F.length(x["head"]) - n
        bare = F.startswith(head, F.lit("- ")) & ~dash
        name = F.when(bare, F.lit("")).when(dash, F.substr(head, F.lit(1), at - 1))
        rest = F.ltrim(F.when(bare, F.substring(head, 3, 10_000)).when(dash, F.substr(head, at + 2)))
        return bound(F.struct(name.alias("name"), rest.alias("rest")), lambda y: parted(x, y))

    def parted(x: Column, y: Column) -> Column:
        two = F.struct(*(F.regexp_extract(y["rest"], r"^(\S.*?)\s{2,}(\S.*)$", k).alias(n) for k, n in enumerate(("street", "city"), 1)))
        return bound(two, lambda z: place(x, y["name"], y["rest"], z["street"], z["city"]))

    def place(x: Column, name: Column, rest: Column, street: Column, city: Column) -> Column:
        with_street = (street != "") & street.rlike(r"\d") & (F.length(F.trim(city)) <= LONGEST_CITY)
        city_only = (street == "") & ~rest.rlike(r"\d") & (F.length(F.trim(rest)) <= LONGEST_CITY)
        fits = F.length(F.trim(name)) <= LONGEST_NAME
        return F.when(fits & with_street, _place("parsed", name=name, address=street, city=city, region=x["region"], postal=x["postal"])).when(fits & city_only, _place("parsed", name=name, city=rest, region=x["region"], postal=x["postal"]))

    return bound(ends, lambda x: F.when(x["head"] != "", split(x)))


def stated_place(text: Column, cities: tuple[str, ...] = ()) -> Column:
    """struct(status, name, address, city, region, postal, country, raw) of a feed's location.

    blank says nothing, region_only a region alone; parsed is one of the two grammars; all else is unparseable and kept as raw, with the
    city if the text ends in one that is known, a state and a postal code. Nothing is ever invented.
    """
    plain = F.trim(F.regexp_replace(decoded(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")), " ", " "))

    def read(t: Column) -> Column:
        tail = F.regexp_extract(t, rf"^(.*\S)\s+(?:MI|OH)\s+{_ZIP}$", 1)
        words = F.split(tail, r"[\s,]+")
        ends = [F.array_join(F.slice(words, F.greatest(F.size(words) - k + 1, F.lit(1)), k), " ") for k in (3, 2, 1)]
        known = F.coalesce(*(F.when(e.isin(*cities), e) for e in ends)) if cities else F.lit(None).cast("string")
        dashed = t.rlike(r"^- |\s-\s")
        return F.when(~t.rlike(r"[\p{L}\p{N}]"), _place("blank")).when(F.regexp_replace(t, r"\.$", "").isin(*REGIONS), _place("region_only", region=t)).otherwise(
            F.coalesce(_listed(t), F.when(dashed, _dashed(t)), _place("unparseable", raw=F.regexp_replace(t, r"\s+", " "), city=F.when(tail != "", known)))
        )

    return bound(plain, read)


def link_or_none(url: Column, base: Column) -> Column:
    """An absolute http(s) address of a link, or null where it is none, has blanks, or is a feed's export."""

    def usable(u: Column) -> Column:
        path, query = F.split_part(u, F.lit("?"), F.lit(1)), F.split_part(F.concat(u, F.lit("?")), F.lit("?"), F.lit(2))
        return F.when(u.rlike(r"(?i)^https?://[^\s/]+\.[^\s]+$") & ~is_export(path, query), u)

    return bound(bound(present(url), lambda u: resolve(u, base)), usable)


def present_links(row: DataFrame, fields: tuple[str, ...] = ("ticket_url", "event_url")) -> DataFrame:
    """rows with unusable links taken out of the columns that are present: a bad link never replaces a stored one."""
    good = {f: link_or_none(F.col(f), F.lit("")) for f in fields if f in row.columns}
    kept = F.filter(F.col("present"), lambda c: ~c.isin(*good)) if good else F.col("present")
    named = F.array_compact(F.array(*(F.when(F.array_contains("present", f) & g.isNotNull(), f) for f, g in good.items()))) if good else F.array().cast("array<string>")
    return row.withColumn("present", F.concat(kept, named)).withColumns(good)


def event_page(description: Column, feed_url: Column, uid: Column) -> Column:
    """The event's own page that a description prints: on the feed's site, the only one, and with the number of the event's uid."""
    site = F.lower(F.regexp_extract(feed_url, r"^https?://(?:www\.)?([^/?#]+)", 1))
    found = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(r"(?i)https?://(?:www\.)?[^\s/]+/calendar\.aspx\?eid=\d+"), F.lit(0))
    own = F.array_distinct(F.filter(F.transform(found, lambda u: F.lower(u)), lambda u: F.regexp_extract(u, r"^https?://(?:www\.)?([^/?#]+)", 1) == site))
    number = F.regexp_extract(uid, r"(\d+)", 1)
    return F.when((F.size(own) == 1) & (F.regexp_extract(own[0], r"eid=(\d+)$", 1) == number), F.concat(F.lit("https://"), site, F.lit("/calendar.aspx?EID="), number))


def _common(feed: str, title: Column, text: Column) -> dict[str, Column]:
    return {
        "title": F.coalesce(present(title), F.lit("Untitled event")), "description": F.substring(text, 1, LONGEST_DESCRIPTION), "category": F.coalesce(category_by_words(title, text), F.col(f"{feed}.default_category")),
        "no_fixed_venue": no_fixed_venue(title, F.array().cast("array<string>")), "source": F.col(f"{feed}.venue_name"), "feed_source_id": F.col(f"{feed}.id"), "calendar_url": F.col(f"{feed}.website"),
    }


def _external_id(own: Column) -> Column:
    return F.substring(F.concat(F.lit("feed-"), F.col("f.id").cast("string"), F.lit("-"), own), 1, LONGEST_ID)


def _of_feeds(rows: DataFrame, feeds: DataFrame, name: str, title: str, found: Column) -> DataFrame:
    """Rows with what is found in them and with their feeds; those where nothing is found and titles that are no events are left out.

    Both are worked out in a list of one, as a filter on them would else be pushed down to the file, where everything that they are read from is read again for each
    time it is named. Feeds are a list that people keep, so it goes to the rows: dealt by feed, all rows of a large feed would be one task.
    """
    one = F.array(F.struct(found.alias("found"), F.when(found.isNotNull(), non_event(F.col(title))).alias("rule")))
    read = rows.select("*", F.explode_outer(one).alias("_read")).where(F.col("_read.found").isNotNull() & F.col("_read.rule").isNull())
    return read.alias(name).join(F.broadcast(feeds.alias("f")), F.col(f"{name}.feed_id") == F.col("f.id"))


def calendar_rows(events: DataFrame, feeds: DataFrame, cities: tuple[str, ...] = ()) -> DataFrame:
    """Rows of events(feed_id, and the columns of calendar.vevents) of feeds(id, venue_name, feed_url, website, default_category, location_per_event).

    Events without a start and titles that are no events are left out. A feed of many places gives the stated place, with what cannot be
    parsed as the name; others give their own. An end at 23:59 or on another day is no end time; only whole days have an end date. A link that cannot be used is not among
    the columns that are present.
    """
    j = _of_feeds(events, feeds, "e", "summary", F.col("start_date"))
    j = j.withColumn("place", F.when(F.col("f.location_per_event"), stated_place(F.col("e.location"), cities)))
    minute = lambda x: F.hour(x) * 60 + F.minute(x)
    start, end, whole = F.col("e.start_at"), F.col("e.end_at"), F.col("e.all_day")
    ends = (F.to_date(end) == F.to_date(start)) & (minute(end) != 1439)
    time = F.when(~whole, F.when(ends, F.concat(clock(minute(start)), F.lit(" – "), clock(minute(end)))).otherwise(clock(minute(start))))
    link = link_or_none(F.col("e.url"), F.col("f.feed_url"))
    page = F.when(link.isNull(), event_page(F.col("e.description"), F.col("f.feed_url"), F.col("e.uid")))
    named = F.when(F.col("place.status").isin("blank", "region_only"), F.lit("Venue TBA")).otherwise(F.coalesce("place.name", "place.raw"))
    own = F.coalesce(present(F.col("e.uid")), F.concat(F.col("e.start_date").cast("string"), F.lit("-"), F.substring(F.coalesce("e.summary", F.lit("")), 1, 40)))
    cols = _common("f", F.col("e.summary"), F.col("e.description")) | {
        "external_id": _external_id(own), "venue_name_raw": F.when(F.col("f.location_per_event"), named).otherwise(F.col("f.venue_name")), "venue_address_raw": F.col("place.address"), "venue_city_raw": F.col("place.city"),
        "start_date": F.col("e.start_date"), "end_date": F.when(whole & (F.col("e.end_date") > F.col("e.start_date")), F.col("e.end_date")), "is_all_day": whole, "time_display": time, "ticket_url": link, "event_url": page,
        "rejected_link": F.when(link.isNull(), present(F.col("e.url"))), "location_status": F.col("place.status"), "date_confidence": F.lit("stated"),
    }
    return _rows(j, cols)


def rss_rows(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Rows of items(feed_id, title, link, guid, published, summary): a day that the text states, else the local day of publication, which is flagged.

    Items with neither title nor text, without any day, or that are no events are left out; no time is ever invented.
    """
    said = explicit_date(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    published = F.to_date(F.from_utc_timestamp(rfc822(F.col("published")), ZONE))
    days = bound(said, lambda x: F.struct(x.alias("said"), F.coalesce(x, published).alias("day")))
    told = ~blank(F.col("title")) | ~blank(F.col("summary"))
    j = _of_feeds(items, feeds, "i", "title", F.when(told, bound(days, lambda x: F.when(x["day"].isNotNull(), x))))
    j = j.withColumn("said", F.col("i._read.found.said")).withColumn("day", F.col("i._read.found.day"))
    link = link_or_none(F.col("i.link"), F.col("f.feed_url"))
    own = F.coalesce(present(F.col("i.guid")), present(F.col("i.link")), F.concat(F.col("day").cast("string"), F.lit("-"), F.substring(F.coalesce("i.title", F.lit("")), 1, 40)))
    none = F.lit(None).cast("string")
    cols = _common("f", F.col("i.title"), F.col("i.summary")) | {
        "external_id": _external_id(own), "venue_name_raw": F.col("f.venue_name"), "venue_address_raw": none, "venue_city_raw": none, "start_date": F.col("day"), "end_date": F.lit(None).cast("date"), "is_all_day": F.lit(True), "time_display": none,
        "ticket_url": link, "event_url": none, "rejected_link": F.when(link.isNull(), present(F.col("i.link"))), "location_status": none, "date_confidence": F.when(F.col("said").isNotNull(), "extracted").otherwise("publication"),
    }
    return _rows(j, cols)


ORDER = (
    "external_id", "title", "description", "category", "no_fixed_venue", "venue_name_raw", "venue_address_raw", "venue_city_raw", "start_date", "end_date", "is_all_day", "time_display", "ticket_url", "event_url", "source", "feed_source_id",
    "calendar_url", "rejected_link", "location_status", "date_confidence",
)


def _rows(j: DataFrame, cols: dict[str, Column]) -> DataFrame:
    out = j.select(*(cols[c].alias(c) for c in ORDER))
    always = [c for c in ORDER[:16] if c not in ("ticket_url", "event_url")]
    return out.withColumn("present", F.array_compact(F.array(*(F.lit(c) for c in always), F.when(F.col("ticket_url").isNotNull(), "ticket_url"), F.when(F.col("event_url").isNotNull(), "event_url"))))
