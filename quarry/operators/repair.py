"""Repairs and backfills: select the rows with a gap, decide, patch only what nobody else has written since."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import owner_supplied
from ..functions.text import blank, plain, present
from ..lineage import cut
from .quality import first_reason

#: Columns that a survivor takes from the row merged into it.
MERGED = ("description", "image_url", "ticket_url", "event_url", "venue_id", "venue_address_raw", "venue_city_raw", "price_from", "end_date")


def _is_blank(df: DataFrame, c: str) -> Column:
    return blank(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).isNull()


def backfill(stored: DataFrame, found: DataFrame, key: str, fields: list[str], guard: Column | None = None, matches: Column | None = None) -> DataFrame:
    """(key, changed, fields...) of stored rows that get something: found values into blanks only.

    found has one row a key (a second scan of the source, knowledge, enrichment). Rows that guard marks (owned or locked ones) stay;
    matches, over the stored columns and found's as f_<field>, can refuse a row, as where the titles differ.
    """
    f = found.select(F.col(key).alias("_k"), *(F.col(c).alias(f"f_{c}") for c in found.columns if c != key))
    j = stored.join(f, F.col(key) == F.col("_k"))
    if guard is not None:
        j = j.where(~F.coalesce(guard, F.lit(False)))
    if matches is not None:
        j = j.where(F.coalesce(matches, F.lit(False)))
    takes = {c: _is_blank(stored, c) & ~(blank(F.col(f"f_{c}").cast("string"))) for c in fields}
    changed = F.array_compact(F.array(*(F.when(t, c) for c, t in takes.items())))
    return j.select(key, changed.alias("changed"), *(F.when(t, F.col(f"f_{c}")).alias(c) for c, t in takes.items())).where("size(changed) > 0")


def compare_and_set(stored: DataFrame, patch: DataFrame, key: str, version: str) -> DataFrame:
    """stored with patch(key, version, fields...) applied where the row still has the version the patch was decided on; applied tells which."""
    fields = [c for c in patch.columns if c not in (key, version)]
    p = patch.select(F.col(key).alias("_k"), F.col(version).alias("_v"), F.struct(*fields).alias("_p"))
    j = stored.join(p, F.col(key) == F.col("_k"), "left")
    ok = F.col("_k").isNotNull() & F.col(version).eqNullSafe(F.col("_v"))
    return j.select(*(F.when(ok, F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns), F.when(F.col("_k").isNotNull(), ok).alias("applied"))


def candidates(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows in order, at most so many, each with the total that there was: a cap that is never silent."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).limit(most).withColumn("total", total)


def loose_title(a: Column, b: Column) -> Column:
    """Equal plain forms, or one contained in the other."""
    x, y = plain(a), plain(b)
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x))


def images_in_use(rows: DataFrame, image: str = "image_url", title: str = "title") -> DataFrame:
    """(image, titles) of images that several titles show, in any spelling: they are nobody's own."""
    return rows.where(~blank(F.col(image))).groupBy(F.trim(image).alias("image")).agg(F.countDistinct(plain(F.col(title))).alias("titles")).where("titles > 1")


def image_repairs(gaps: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, image_url, decision) of rows without an image, found(id, image_url) on their pages: rejected where another title shows it."""
    shown = rows.where(~blank(F.col("image_url"))).select(F.trim("image_url").alias("image_url"), plain(F.col("title")).alias("t"))
    of = shown.groupBy("image_url").agg(F.countDistinct("t").alias("n"), F.min("t").alias("only"))
    j = gaps.select("id", plain(F.col("title")).alias("own")).join(found.select("id", F.trim("image_url").alias("image_url")), "id").join(of, "image_url", "left")
    other = (F.col("n") > 1) | (F.col("only") != F.col("own"))
    return j.select("id", "image_url", first_reason([("no_image", blank(F.col("image_url"))), ("placeholder", F.contains(F.lower("image_url"), F.lit("/assets/placeholders/"))), ("used_by_other_title", other)], "use").alias("decision"))


def canonical_listing(uri: Column, site: str, folder: str) -> Column:
    """The canonical address of a listing: the last two parts of any spelling of its path."""
    slug, number = (F.regexp_extract(F.coalesce(uri, F.lit("")), rf"(?i)/?{folder}/([^/?#]+)/(\d+)/?(?:[?#].*)?$", k) for k in (1, 2))
    return F.when(number != "", F.concat(F.lit(f"{site}/{folder}/"), F.lower(slug), F.lit("/"), number, F.lit("/")))


def by_pattern(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that is found in a text, in order."""
    return reduce(lambda out, p: F.when(text.rlike(p[0]), p[1]).otherwise(out), reversed(patterns), F.lit(None).cast("string"))


def calendar_page(row_host: Column, source: Column, page: Column, has_feed: Column, overrides: dict[str, str], by_source: dict[str, str]) -> Column:
    """A page to fall back on for rows without links: the host's, the source's, else the feed's own where it looks like a calendar."""
    get = lambda table, k: F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), k) if table else F.lit(None).cast("string")
    words = r"(?i)/(?:calendar|calendars|event-calendar|events-calendar|community-calendar|events?|upcoming-events|whats-on|whats-happening|happenings)(?:\.(?:aspx?|html?|php))?(?:/|$|[?#])"
    own = F.when(has_feed & page.rlike("(?i)^https?://") & F.regexp_replace(page, r"^https?://[^/]*", "").rlike(words), page)
    return F.coalesce(F.when(has_feed, get(overrides, row_host)), get(by_source, source), own)


def note_line(note: Column, line: Column) -> Column:
    """A note with a line appended; blanks at its end go."""
    return F.when(blank(note), line).otherwise(F.concat(F.regexp_replace(note, r"\s+$", ""), F.lit("\n"), line))


def mark_distinct(rows: DataFrame, pairs: DataFrame, marker: str = "DISTINCT-FROM") -> DataFrame:
    """rows(id, internal_note) with a line for every row that a reviewed pair (a, b) says it is distinct from."""
    both = pairs.select(F.col("a").alias("_id"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("_id"), F.col("a").alias("o")))
    lines = both.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("o")), lambda o: F.concat(F.lit(f"{marker} "), o.cast("string"))), "\n").alias("_lines"))
    j = rows.join(lines, F.col("id") == F.col("_id"), "left")
    return j.select(*(F.when(F.col("_lines").isNotNull(), note_line(F.col("internal_note"), F.col("_lines"))).otherwise(F.col("internal_note")).alias(c) if c == "internal_note" else F.col(c) for c in rows.columns))


def last_survivors(plan: DataFrame) -> DataFrame:
    """loser, survivor, hops, rule, n_survivors of a plan(survivor, loser, rule): the survivor is the last one of the loser's chain, hops away.

    Pointers are doubled, so a chain of n merges takes log2(n) rounds. A loser with several survivors goes to the smallest, and
    n_survivors says so; the survivor is null where the chain runs into a ring, as no row of a ring outlives the others.
    """
    one = cut(plan.where("loser is not null and survivor is not null").groupBy("loser").agg(F.min(F.struct("survivor", "rule")).alias("m"), F.count_distinct("survivor").alias("n_survivors")).select("loser", "m.survivor", F.col("m.rule"), "n_survivors"))
    now = one.select("loser", F.col("survivor").alias("to"), F.lit(1).cast("long").alias("hops"))
    for _ in range(one.count().bit_length() + 1):
        ahead = now.select(F.col("loser").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
        now = cut(now.join(ahead, "to", "left").select("loser", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_to").isNotNull().alias("open")))
        if now.where("open").isEmpty():
            break
    ring = now.select("loser", F.when(~F.col("open"), F.col("to")).alias("survivor"), F.when(~F.col("open"), F.col("hops")).alias("hops")) if "open" in now.columns else now.select("loser", F.col("to").alias("survivor"), "hops")
    return ring.join(one.select("loser", "rule", "n_survivors"), "loser")


def merged(rows: DataFrame, plan: DataFrame, fields: tuple[str, ...] = MERGED) -> DataFrame:
    """rows after the merges of plan(survivor, loser, rule): last survivors take from their losers what they lack, losers are rejected and say why.

    A survivor takes from the nearest of its losers that has the field, of equally near ones from the first by id. A loser is not deleted,
    so a merge can be undone; losers whose chain runs into a ring stay as they are.
    """
    use = [f for f in fields if f in rows.columns]
    final = cut(last_survivors(plan).where("survivor is not null"))
    from_ = rows.join(final.select("survivor", "loser", "hops"), F.col("id") == F.col("loser")).select("survivor", "hops", "id", *use)
    gifts = from_.groupBy("survivor").agg(*(F.min_by(f, F.when(~_is_blank(rows, f), F.struct("hops", "id"))).alias(f"_g_{f}") for f in use))
    lost = final.select(F.col("loser").alias("_l"), F.struct("survivor", "rule").alias("_by"))
    j = rows.join(gifts, F.col("id") == F.col("survivor"), "left").join(lost, F.col("id") == F.col("_l"), "left")
    gone = F.col("_l").isNotNull()
    said = F.concat(F.lit("MERGED-INTO "), F.col("_by.survivor").cast("string"), F.lit(" ("), F.col("_by.rule"), F.lit(")"))
    new = {f: F.when(_is_blank(rows, f) & ~gone, F.col(f"_g_{f}")).otherwise(F.col(f)) for f in use}
    new |= {"status": F.when(gone, "rejected").otherwise(F.col("status")), "internal_note": F.when(gone, note_line(F.col("internal_note"), said)).otherwise(F.col("internal_note"))}
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in rows.columns))


def moved_links(links: DataFrame, plan: DataFrame, key: str = "event_id") -> DataFrame:
    """links with those of losers moved to their last survivors; one that the survivor has already is dropped."""
    to = last_survivors(plan if "rule" in plan.columns else plan.withColumn("rule", F.lit(None).cast("string"))).where("survivor is not null").select(F.col("loser").alias("_l"), F.col("survivor").alias("_s"))
    j = links.join(to, F.col(key) == F.col("_l"), "left")
    return j.select(*(F.coalesce("_s", key).alias(key) if c == key else F.col(c) for c in links.columns)).distinct()


def retirement(rows: DataFrame, rule: Column) -> DataFrame:
    """id, rule of the rows that a rule retires: approved or pending ones, that no owner has locked."""
    kept = F.col("status").isin("approved", "pending") & ~owner_supplied(F.col("source"), F.col("internal_note"))
    return rows.where(kept).select("id", rule.alias("rule")).where("rule is not null")


def capped_merges(plan: DataFrame, order: list[Column], most: int = 60) -> DataFrame:
    """The first merges of a run, at most so many, with the number planned."""
    return candidates(plan, order, most)


def patterns_into_blanks(rows: DataFrame, field: str, text: Column, patterns: list[tuple[str, str]], source: str = "source", note: str = "internal_note") -> DataFrame:
    """(id, field) of rows whose field is blank and whose text a pattern knows; owner's rows stay."""
    value = by_pattern(text, patterns)
    return rows.where(_is_blank(rows, field) & ~owner_supplied(F.col(source), F.col(note))).select("id", value.alias(field)).where(F.col(field).isNotNull())


def per_source(rows: DataFrame, source: str, order: list[Column], most: int = 5) -> DataFrame:
    """Up to most rows of each source, the first in order: ranks are taken in slices of a source, then among what is left of them."""
    w = lambda *keys: Window.partitionBy(*keys).orderBy(*order)
    cut = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(64))).withColumn("_n", F.row_number().over(w(source, "_s"))).where(F.col("_n") <= most)
    return cut.withColumn("rank", F.row_number().over(w(source))).where(F.col("rank") <= most).drop("_s", "_n")


def precedence(*candidates_: tuple[str, Column]) -> Column:
    """struct(value, tier) of the first candidate that is not blank."""
    tier = F.coalesce(*(F.when(~blank(v), F.lit(n)) for n, v in candidates_))
    return F.struct(F.coalesce(*(present(v) for _, v in candidates_)).alias("value"), tier.alias("tier"))


def owner_fields(note: Column) -> Column:
    """Names of the fields that OWNER-CORRECTION lines of a note have set, once each, sorted."""
    lines = F.regexp_extract_all(F.coalesce(note, F.lit("")), F.lit(r"(?m)^OWNER-CORRECTION\b.*?\bfields=([a-z_,]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, ","))), lambda f: f != "")))


def owner_edits(note: Column) -> Column:
    """array of struct(at, edit_id, field, before, after) of the corrections that a note's lines record as JSON."""
    lines = F.filter(F.split(F.coalesce(note, F.lit("")), "\n"), lambda x: x.rlike(r"^OWNER-CORRECTION\s+\S+\s+\S+\s+fields=[a-z_,]+ \| "))
    part = lambda x, k: F.regexp_extract(x, r"^OWNER-CORRECTION\s+(\S+)\s+(\S+)\s+fields=[a-z_,]+ \| (.*)$", k)
    changes = lambda x: F.coalesce(F.from_json(part(x, 3), "changes array<struct<f:string,b:string,a:string>>")["changes"], F.array().cast("array<struct<f:string,b:string,a:string>>"))
    return F.flatten(F.transform(lines, lambda x: F.transform(changes(x), lambda y: F.struct(part(x, 1).alias("at"), part(x, 2).alias("edit_id"), y["f"].alias("field"), y["b"].alias("before"), y["a"].alias("after")))))


def note_values(note: Column, separator: str = "¦") -> Column:
    """map of 'key=value' parts of a note between separators; a key met twice keeps its first value."""
    pairs = F.filter(F.transform(F.split(F.coalesce(note, F.lit("")), separator), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit("=")))
    made = F.transform(pairs, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.trim(F.substr(p, F.locate("=", p) + 1)).alias("v")))
    return F.map_from_entries(F.filter(made, lambda x, i: F.size(F.filter(F.slice(made, F.lit(1), i), lambda y: y["k"] == x["k"])) == 0))


def capped_json(text: Column, most: int) -> Column:
    """A JSON text, without its sample where it is longer than most characters; null where it still is."""
    short = F.regexp_replace(text, r',?"sample":(\[[^\]]*\]|"[^"]*")', "")
    return F.when(F.length(text) <= most, text).when(F.length(short) <= most, short)
