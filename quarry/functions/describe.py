"""Sentences made from facts, descriptions as blocks, cities and ZIPs in addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clocktext import without_placeholder_end
from .text import blank, present, squish

#: Words that tell an article on an event, and sections that never are.
COVERAGE = r"(?i)\b(festival|fest|concert|tour|screening|exhibit(ion)?|showcase|matinee|gala|expo|parade|market days?|art fair|open mic|trivia night|ticket|opening reception)\b"
BULLET = r"^\s*(?:[-*•·▪◦]|\d{1,2}[.)])\s+(.*)$"


def month_day(day: Column) -> Column:
    """'June 5' of a date."""
    return F.date_format(day, "MMMM d")


def factual(title: Column, venue: Column, day: Column, time: Column, all_day: Column, free: Column, price: Column) -> Column:
    """A sentence of what is known, or null where a title is all there is."""
    place = F.when(F.lower(present(venue)) != "venue tba", present(venue))
    clock = F.when(~F.coalesce(all_day, F.lit(False)), without_placeholder_end(present(time)))
    facts = F.concat(*(F.coalesce(F.concat(F.lit(f" {word} "), x), F.lit("")) for word, x in (("at", place), ("on", month_day(day)), ("at", clock))))
    amount = F.when(price == F.floor(price), price.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", price), "0$", ""))
    extra = F.when(F.coalesce(free, F.lit(False)), " Free admission.").when(price > 0, F.concat(F.lit(" Tickets from $"), amount, F.lit("."))).otherwise("")
    return F.when(~blank(title) & (facts != ""), F.concat(present(title), F.lit(" takes place"), facts, F.lit("."), extra))


def is_factual(description: Column, title: Column, venue: Column, day: Column, time: Column, all_day: Column, free: Column, price: Column) -> Column:
    """A description that says no more than factual() would, with or without what it costs."""
    d, no = squish(description), F.lit(False)
    none = F.lit(None).cast("double")
    bare, full = (factual(title, venue, day, time, all_day, f, p) for f, p in ((no, none), (free, price)))
    return F.coalesce(bare.isNotNull() & ((d == squish(bare)) | (d == squish(full))), no)


def blocks(text: Column) -> Column:
    """array of struct(kind, lines): paragraphs (p) and lists (ul) of a text; blank lines and bullets part them."""
    rows = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rtrim(x))
    kind = lambda x: F.when(F.trim(x) == "", "").when(x.rlike(BULLET), "ul").otherwise("p")
    said = lambda x: F.when(x.rlike(BULLET), F.trim(F.regexp_extract(x, BULLET, 1))).otherwise(F.trim(x))
    none = F.array().cast("array<struct<kind:string,lines:array<string>>>")

    def step(a: Column, x: Column) -> Column:
        done, last = a["done"], F.try_element_at(a["done"], F.lit(-1))
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["kind"].alias("kind"), F.concat(last["lines"], F.array(said(x))).alias("lines"))))
        new = F.concat(done, F.array(F.struct(kind(x).alias("kind"), F.array(said(x)).alias("lines"))))
        return F.struct(F.when(kind(x) == "", done).when(~a["gap"] & (last["kind"] == kind(x)), grown).otherwise(new).alias("done"), (kind(x) == "").alias("gap"))

    return F.aggregate(rows, F.struct(none.alias("done"), F.lit(True).alias("gap")), step)["done"]


def covers_event(title: Column, excerpt: Column, segments: tuple[str, ...] = ()) -> Column:
    """An article that may be about an event, and of no section that never is."""
    t = F.lower(F.coalesce(title, F.lit("")))
    other = F.greatest(F.lit(False), F.lit(False), *(F.startswith(t, F.lit(s)) for s in segments))
    return ~other & F.concat_ws(" ", title, excerpt).rlike(COVERAGE)


def zip_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(\d{5})(?:-\d{4})?\b", 1), F.lit(""))


def city_in_address(text: Column, known: dict[str, tuple[str, ...]]) -> Column:
    """struct(street, city, state) of 'number street city, state ZIP' without commas needed: the longest known city before the state; else null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)&[a-z]+;|&#\d+;", " "), r"\s+", " "))
    behind = r"(?i)[,\s]+(MI|Mich\.?|Michigan|OH|Ohio)\.?(?:[,\s]+\d{5}(?:-\d{4})?)?\s*$"
    state = F.when(F.regexp_extract(t, behind, 1).rlike("(?i)^o"), "OH").when(F.regexp_extract(t, behind, 1) != "", "MI")
    head = F.regexp_replace(F.regexp_replace(t, behind, ""), r"[,\s]+$", "")
    names = {s: F.array(*(F.lit(c) for c in cs)) for s, cs in known.items()}
    cities = F.coalesce(*(F.when(state == s, a) for s, a in names.items()), F.array().cast("array<string>"))
    fits = F.filter(cities, lambda c: F.endswith(F.lower(head), F.concat(F.lit(" "), F.lower(c))) | F.endswith(F.lower(head), F.concat(F.lit(","), F.lower(c))))
    best = F.array_max(F.transform(fits, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))["c"]
    street = F.regexp_replace(F.left(head, F.length(head) - F.length(best)), r"[,\s]+$", "")
    return F.when(best.isNotNull() & street.rlike(r"^\d") & street.rlike("[A-Za-z]"), F.struct(street.alias("street"), best.alias("city"), state.alias("state")))


def feed_city(city: Column, municipalities: Column, tier: Column, designated: Column, inside: Column) -> Column:
    """struct(status, evidence): how far a feed's city is borne out by its ZIP's municipalities, the strength of that, and a border test of Detroit.

    municipalities are the ZIP's (null: unknown ZIP), tier is strong or weak for the city in it, designated marks a place that is none,
    inside tells whether the coordinates lie in Detroit (null: none).
    """
    key = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\b(charter|township|twp|city|village|of)\b\.?", " "), r"[^a-z]+", " "))
    listed, home = F.exists(municipalities, lambda m: key(m) == key(city)), key(city) == "detroit"
    no = F.lit(False)
    evidence = (
        F.when(F.coalesce(listed, no), F.when(F.coalesce(designated, no), "cdp_compatible").when(tier == "strong", "municipality").otherwise("census_supported")).otherwise("none")
    )
    evidence = F.when(home & F.coalesce(inside, no) & (evidence != "municipality"), "boundary").otherwise(evidence)
    outside = home & (F.coalesce(~inside, no) | (municipalities.isNotNull() & ~F.coalesce(listed, no) & ~F.coalesce(inside, no)))
    status = (
        F.when(blank(city), "no_city").when(outside, "needs_follow_up").when(evidence.isin("municipality", "boundary"), "stored").when(evidence.isin("cdp_compatible", "census_supported"), "stored_compatible").otherwise("stored_unverified")
    )
    return F.struct(status.alias("status"), F.when(status.isin("no_city", "needs_follow_up"), "none").otherwise(evidence).alias("evidence"))
