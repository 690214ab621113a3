"""Venues and cities of events: resolution in tiers with its conflicts, what events teach about a venue, gaps that this fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import placeholder_venue, says
from ..functions.integrity import _text
from ..functions.text import blank
from ..functions.tokens import bound
from .quality import first_reason

#: Words of a city that stand for others, and what may stand behind or before its name.
CITY_WORDS = {"mt": "mount", "twp": "township", "hts": "heights"}
AFTER_CITY = ("mi", "michigan", "oh", "ohio", "on", "ontario", "usa", "us", "canada")
BEFORE_CITY = ("city", "village", "charter", "township")
REGIONS = {"MI": "Michigan", "OH": "Ohio", "ON": "Ontario"}
FULL_NAMES = {"MICHIGAN": "MI", "OHIO": "OH", "ONTARIO": "ON"}
CITY_ALIASES = {"grosse pointe farms": "grosse pointe", "grosse pointe shores": "grosse pointe", "grosse pointe park": "grosse pointe"}
#: A name that stands for a city only at one venue: name -> (city, venue).
GATED_ALIASES = {"ontario": ("kingsville", "town of kingsville")}


def _map(table: dict[str, str], x: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), x)


def name_key(name: Column) -> Column:
    """A venue's name for comparison: case, blanks and curly apostrophes do not matter."""
    return F.regexp_replace(F.translate(F.lower(_text(name)), "‘’ʼ", "'''"), r"\s+", " ")


def address_key(address: Column, city: Column) -> Column:
    """'address|city', or null without an address."""
    low = lambda x: F.regexp_replace(F.lower(_text(x)), r"\s+", " ")
    return F.when(~blank(address), F.concat(low(address), F.lit("|"), low(city)))


def compare_city(city: Column) -> Column:
    """A city for comparison: no state, country, ZIP or kind of place, abbreviations written out."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(city, F.lit(""))), "[^a-z0-9 ]", " "), r"\s+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.coalesce(_map(CITY_WORDS, w), w))
    without = lambda w, n: F.slice(w, F.lit(1), F.greatest(F.size(w) - n, F.least(F.size(w), F.lit(1))))

    def tail(words: Column, is_tail: Callable[[Column], Column]) -> Column:
        """How many words at the end are of the kind; at least one word stays."""
        step = lambda a, w: bound(a["on"] & is_tail(w), lambda on: F.struct(F.when(on, a["n"] + 1).otherwise(a["n"]).alias("n"), on.alias("on")))
        return F.aggregate(F.reverse(words), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step)["n"]

    def unkind(words: Column) -> Column:
        of = F.array_position(words, "of").cast("int")
        kind = lambda of: (of > 1) & (of < F.size(words)) & F.forall(F.slice(words, F.lit(1), F.greatest(of - 1, F.lit(0))), lambda w: w.isin(*BEFORE_CITY))
        return bound(of, lambda of: F.when(kind(of), F.slice(words, of + 1, F.size(words))).otherwise(words))

    words = bound(words, lambda w: without(w, tail(w, lambda x: x.isin(*AFTER_CITY) | x.rlike(r"^\d{4,5}$"))))
    words = bound(bound(words, unkind), lambda w: without(w, tail(w, lambda x: x.isin("township", "charter"))))
    return F.array_join(words, " ")


def cities_differ(a: Column, b: Column) -> Column:
    return bound(F.struct(compare_city(a).alias("a"), compare_city(b).alias("b")), lambda x: (x["a"] != "") & (x["b"] != "") & (x["a"] != x["b"]))


def parse_city(raw: Column) -> Column:
    """struct(name, state) of a city as written: ', MI 48084' behind it is the state; Twp, Mt and charter townships are written out."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    behind = r"(?i),\s*([a-z]{2}|michigan|ohio|ontario)(?:\s+\d{5}(?:-\d{4})?)?$"
    st = F.nullif(F.upper(F.regexp_extract(t, behind, 1)), F.lit(""))
    n = F.trim(F.regexp_replace(t, behind, ""))
    n = F.regexp_replace(F.regexp_replace(n, r"(?i)\btwp\.?(?=\s|$)", "Township"), r"(?i)^mt\.?(?=\s)", "Mount")
    charter = F.regexp_extract(n, r"(?i)^charter township of (.+)$", 1)
    return F.struct(F.lower(F.when(charter != "", F.concat(F.trim(charter), F.lit(" township"))).otherwise(n)).alias("name"), F.coalesce(_map(FULL_NAMES, st), st).alias("state"))


def city_lookup(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(key, region, lat, lng, sources) of two tables of (name, region, lat, lng, sources): where both have a name the first counts."""
    both = primary.withColumn("_r", F.lit(0)).unionByName(secondary.withColumn("_r", F.lit(1)))
    return both.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct("region", "lat", "lng", "sources"), F.struct("_r", "name")).alias("v")).select("key", "v.*")


def locate(events: DataFrame, lookup: DataFrame, home: str = "detroit") -> DataFrame:
    """events(city, source, venue, ...) with place_status, place_reason, place_key, assumed, lat, lng.

    A blank city is the home city, assumed. A stated state must be the place's; a place that only some sources may name needs one of
    these or a stated state; aliases stand for their city, gated ones only at their venue. Nothing is guessed.
    """
    low = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    p = parse_city(F.col("city"))
    gated = F.lit(None).cast("string")
    for name, (to, at) in GATED_ALIASES.items():
        gated = F.when((p["name"] == name) & p["state"].isNull(), F.when(low(F.col("venue")) == at, to).otherwise("\x00")).otherwise(gated)
    name = F.coalesce(gated, p["name"])
    key = F.when(blank(F.col("city")), home).otherwise(F.coalesce(_map(CITY_ALIASES, name), name))
    e = events.select("*", p["state"].alias("_state"), key.alias("_key"), p["name"].alias("_plain"))
    j = e.join(lookup.select(F.col("key").alias("_key"), F.struct("region", "lat", "lng", "sources").alias("_loc")), "_key", "left")
    region = _map(REGIONS, F.col("_state"))
    loc, assumed = F.col("_loc"), blank(F.col("city"))
    right = F.col("_state").isNull() | F.coalesce(region == loc["region"], F.lit(False))
    named = loc["sources"].isNull() | F.col("_state").isNotNull() | F.coalesce(F.array_contains(loc["sources"], low(F.col("source"))), F.lit(False))
    placed = loc.isNotNull() & (assumed | (right & named))
    reason = F.when(~placed, F.when(assumed, "no-home").when(loc.isNotNull() & loc["sources"].isNotNull(), "source-not-evidence").otherwise("not-in-table"))
    return j.select(
        *(F.col(c) for c in events.columns), F.when(placed, "placed").otherwise("unplaced").alias("place_status"), reason.alias("place_reason"), F.when(placed, F.col("_key")).alias("place_key"),
        (placed & assumed).alias("assumed"), F.when(placed, loc["lat"]).alias("lat"), F.when(placed, loc["lng"]).alias("lng"),
    )


def eligible(status: Column, reason: Column, border_miles: Column, miles: Column, radius: float | None = None, orbit: float = 75.0) -> Column:
    """Why a located event is out of the place asked for, or null: unplaced, outside the orbit, too far from its centre."""
    return F.when(status != "placed", reason).when(border_miles > orbit, "outside-orbit").when(F.lit(radius is not None) & (miles > (radius or 0.0)), "too-far")


#: Words of names that are no single place.
ONLINE = r"(?i)^(online|virtual|livestream|live stream|zoom|webinar)\b"
MOVING = r"food truck|mobile|bus tour|walking tour|parade route|various locations?"
MANY = r"multiple (?:venues|locations|sites)|citywide|city-wide|throughout|multiple sites"
LOCKS = r"OWNER-CORRECTION|EDITORIAL[-_ ]HOLD"


def resolve(events: DataFrame, venues: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """events(id, venue_id, name, address, city, note, source) -> (id, status, reason, venue_id, tier).

    Owned, online, moving, many-sited and unnamed rows are preserved. Else the linked venue, the only one of the name, or the only one at
    the address: venues(id, name, address, city). A link that points nowhere or to another name, another city or another address is a
    conflict; a name or address of several venues is ambiguous. A match is verified where it was linked, is canonical, or two sources
    of knowledge(venue_id, canonical, sources) know it; else proposed. Each tier is one equi-join on a key with one row.
    """
    v = venues.select(F.col("id").alias("vid"), "name", "address", "city")
    one = lambda key: v.where(F.coalesce(key != "", F.lit(False))).groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min(F.struct("vid", "name", "address", "city")).alias("v"))
    names, places = one(name_key(F.col("name"))), one(address_key(F.col("address"), F.col("city")))
    e = events.select("id", "venue_id", "name", "address", "city", "note", "source", name_key(F.col("name")).alias("nk"), address_key(F.col("address"), F.col("city")).alias("ak"))
    e = e.join(v.select(F.col("vid").alias("venue_id"), F.struct("vid", "name", "address", "city").alias("linked")), "venue_id", "left")
    e = e.join(names.select(F.col("k").alias("nk"), F.col("n").alias("n_name"), F.col("v").alias("by_name")), "nk", "left").join(places.select(F.col("k").alias("ak"), F.col("n").alias("n_place"), F.col("v").alias("by_place")), "ak", "left")
    note, name = F.coalesce("note", F.lit("")), F.coalesce("name", F.lit(""))
    preserved = first_reason([
        ("OWNER_LOCKED", note.rlike(LOCKS) | (F.col("source") == "Manual")), ("ONLINE", F.trim(name).rlike(ONLINE)), ("MOBILE", says(name, MOVING)), ("MULTISITE", says(name, MANY)), ("TBA", blank(name) | placeholder_venue(name) | name.rlike(r"(?i)^\s*tba\b")),
    ], "")
    has_link, found = F.col("venue_id").isNotNull(), F.col("linked").isNotNull()
    how = F.when(found, "linked").when(F.col("n_name") == 1, "name").when(F.col("n_name").isNull() & (F.col("n_place") == 1), "address")
    match = F.when(how == "linked", F.col("linked")).when(how == "name", F.col("by_name")).when(how == "address", F.col("by_place"))
    e = e.select("id", "nk", "address", "city", bound(preserved, lambda r: r).alias("kept"), has_link.alias("has_link"), found.alias("found"), "linked", "n_name", "n_place", how.alias("how"), match.alias("m"))
    if knowledge is None:
        e = e.withColumn("canonical", F.lit(False)).withColumn("sources", F.lit(0))
    else:
        k = knowledge.groupBy(F.col("venue_id").alias("_k")).agg(F.bool_or("canonical").alias("canonical"), F.countDistinct("source").alias("sources"))
        e = e.join(k, F.col("m.vid") == F.col("_k"), "left")
    bare = lambda a: F.regexp_replace(F.regexp_replace(F.lower(_text(a)), r"\s+", " "), "[.,]", "")
    a, b = bare(F.col("address")), bare(F.col("m.address"))
    apart = (a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a)
    reason = first_reason([
        *((code, F.col("kept") == code) for code in ("OWNER_LOCKED", "ONLINE", "MOBILE", "MULTISITE", "TBA")), ("IDENTITY_CONFLICT", F.col("has_link") & ~F.col("found")), ("IDENTITY_CONFLICT", F.col("found") & (name_key(F.col("linked.name")) != F.col("nk"))),
        ("AMBIGUOUS_NAME", F.col("how").isNull() & (F.col("n_name") > 1)), ("AMBIGUOUS_ADDRESS", F.col("how").isNull() & (F.col("n_place") > 1)), ("NO_MATCH", F.col("m").isNull()), ("CITY_CONFLICT", cities_differ(F.col("city"), F.col("m.city"))),
        ("IDENTITY_CONFLICT", apart & (F.col("how") != "address")), ("VERIFIED", (F.col("how") == "linked") | F.coalesce("canonical", F.lit(False)) | (F.col("sources") >= 2)),
    ], "SINGLE_SOURCE")
    e, reason = e.withColumn("_reason", bound(reason, lambda r: r)), F.col("_reason")  # worked out once: bound keeps it from being copied into each use
    status = first_reason([("preserved", F.col("kept") != ""), ("conflict", reason.endswith("_CONFLICT")), ("ambiguous", reason.startswith("AMBIGUOUS")), ("unresolved", reason == "NO_MATCH"), ("verified", reason == "VERIFIED")], "proposed")
    settled = reason.isin("VERIFIED", "SINGLE_SOURCE")
    out = e.select("id", status.alias("status"), F.when(reason == "VERIFIED", F.concat(F.lit("VERIFIED_"), F.upper("how"))).otherwise(reason).alias("reason"), F.when(settled, F.col("m.vid")).alias("venue_id"), F.when(settled, F.col("how")).alias("tier"))
    return out


#: Independent sources, or dates of a place's own source, that settle where it is.
INDEPENDENT, OWN_DATES = 2, 2


def learn(statements: DataFrame, canonical: DataFrame, independent: int = INDEPENDENT, first_party_dates: int = OWN_DATES) -> DataFrame:
    """(name_key, status, address, city, families) from statements(name, street_key, address, city, family, copies, first_party, day).

    A venue's record (canonical(name, street_key, city)) stands unless a statement contradicts it. Without a record: two streets or
    cities are a conflict (ambiguous where the cities differ), independent families that agree have learned it, as has the place's own
    source on enough days; else it is a single source's word. Families that copy others count for nothing.
    """
    s = statements.select(name_key(F.col("name")).alias("name_key"), "street_key", "address", "city", compare_city(F.col("city")).alias("ck"), "family", "copies", "first_party", "day")
    families = s.groupBy("name_key", "family").agg(F.bool_and("first_party").alias("own"), F.countDistinct("day").alias("days"), F.bool_or("copies").alias("copies"))
    f = families.groupBy("name_key").agg(F.count("*").alias("families"), F.count_if(~F.col("copies")).alias("agreeing"), F.max(F.when(~F.col("copies") & F.col("own"), F.col("days"))).alias("own_days"))
    texts = s.groupBy("name_key", "address", "city").agg(F.count("*").alias("n"))
    best = texts.groupBy("name_key").agg(F.min_by(F.struct("address", "city"), F.struct(-F.col("n"), F.length("address"), "address")).alias("best"))
    spread = s.groupBy("name_key").agg(F.countDistinct("street_key").alias("streets"), F.countDistinct("ck").alias("cities"), F.min("street_key").alias("street"), F.min("ck").alias("ck"))
    k = canonical.groupBy(name_key(F.col("name")).alias("name_key")).agg(F.min(F.struct("street_key", compare_city(F.col("city")).alias("ck"))).alias("rec"))
    j = spread.join(f, "name_key").join(best, "name_key").join(k, "name_key", "left")
    clash = (F.col("streets") > 1) | (F.col("cities") > 1)
    off = clash | (F.col("street") != F.col("rec.street_key")) | (F.col("ck") != F.col("rec.ck"))
    status = first_reason([
        ("canonical_conflict", F.col("rec").isNotNull() & off), ("canonical", F.col("rec").isNotNull()), ("ambiguous", F.col("cities") > 1), ("conflict", F.col("streets") > 1), ("learned", F.col("agreeing") >= independent),
        ("learned_first_party", (F.col("agreeing") == 1) & (F.col("own_days") >= first_party_dates)),
    ], "single_source")
    known = status.isin("learned", "learned_first_party", "single_source")
    return j.select("name_key", status.alias("status"), F.when(known, F.col("best.address")).alias("address"), F.when(known, F.col("best.city")).alias("city"), "families")


def learn_from_sources(statements: DataFrame, canonical: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """learn() of raw statements(name, street_key, address, city, source, text, at, first_party, day): sources that repeat one another's texts are one family and agree only once."""
    from .families import independent

    raw = independent(statements, least, share)
    return learn(raw.withColumn("copies", F.lit(False)), canonical)


def fill_gaps(events: DataFrame, learned: DataFrame) -> DataFrame:
    """(id, action, address, city) of events(id, name, address, city) that lack an address or city, by what is known of the name.

    Trusted knowledge fills blanks, unless the row's own city or address contradicts it; one source's word asks for confirmation, an
    ambiguous name is excluded, a conflict is one.
    """
    trusted = ("canonical", "learned", "learned_first_party")
    gap = events.where(blank(F.col("address")) | blank(F.col("city"))).select("id", "name", "address", "city", name_key(F.col("name")).alias("name_key"))
    k = learned.select("name_key", "status", F.col("address").alias("k_address"), F.col("city").alias("k_city"))
    j = gap.join(k, "name_key", "left")
    clash = cities_differ(F.col("city"), F.col("k_city")) | (~blank(F.col("address")) & ~blank(F.col("k_address")) & (F.lower(_text(F.col("address"))) != F.lower(_text(F.col("k_address")))))
    ok = F.col("status").isin(*trusted)
    action = first_reason([
        ("unknown", F.col("status").isNull()), ("excluded", F.col("status") == "ambiguous"), ("confirm", F.col("status") == "single_source"), ("conflict", ~ok | clash),
        ("none", ~((blank(F.col("address")) & ~blank(F.col("k_address"))) | (blank(F.col("city")) & ~blank(F.col("k_city"))))),
    ], "fill")
    j, action = j.withColumn("_action", bound(action, lambda a: a)), F.col("_action")
    fill = lambda c: F.when((action == "fill") & blank(F.col(c)), F.col(f"k_{c}"))
    return j.select("id", action.alias("action"), fill("address").alias("address"), fill("city").alias("city"))


def shared_streets(rows: DataFrame) -> DataFrame:
    """(street_key, names) of street lines, rows(street_key, name), that stand for several venue names."""
    return rows.where("street_key is not null").groupBy("street_key").agg(F.array_sort(F.collect_set(name_key(F.col("name")))).alias("names")).where("size(names) > 1")


def creation_plan(rows: DataFrame, venues: DataFrame) -> DataFrame:
    """(name_key, name, street_key, city, reason) of unlinked names, rows(name, street_key, city, first_party), that deserve a record.

    reason is null for those to create: one street, one city, from first parties only, no record of that name, and no other name or
    record on that street; else the first thing against it.
    """
    r = rows.select(name_key(F.col("name")).alias("name_key"), "name", "street_key", compare_city(F.col("city")).alias("ck"), "city", "first_party")
    g = r.groupBy("name_key").agg(F.min("name").alias("name"), F.countDistinct("street_key").alias("streets"), F.countDistinct("ck").alias("cities"), F.bool_and("first_party").alias("own"), F.min("street_key").alias("street_key"), F.min("city").alias("city"))
    rivals = r.groupBy("street_key").agg(F.countDistinct("name_key").alias("rivals"))
    known = venues.select(name_key(F.col("name")).alias("name_key")).distinct().withColumn("known", F.lit(True))
    taken = venues.where("street_key is not null").select("street_key").distinct().withColumn("taken", F.lit(True))
    j = g.join(rivals, "street_key", "left").join(known, "name_key", "left").join(taken, "street_key", "left")
    against = first_reason([
        ("has_record", F.col("known")), ("several_streets", F.col("streets") > 1), ("several_cities", F.col("cities") > 1), ("no_street", F.col("street_key").isNull()), ("not_first_party", ~F.col("own")), ("street_has_record", F.col("taken")), ("street_rival", F.col("rivals") > 1),
    ], "")
    return j.select("name_key", "name", "street_key", "city", F.nullif(against, F.lit("")).alias("reason"))
