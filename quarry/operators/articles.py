"""Articles linked with the events they name: phrase containment as an equi-join, best match, verdict."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrase_in, plain
from ..lineage import cut

#: Shortest title or venue that is sought, most days between an article and an event at a venue it names.
LEAST_CHARS, VENUE_DAYS = 6, 21
#: Phrases that are broadcast; each is one key.
FEW = 50_000


def _phrase_keys(phrases: DataFrame, words: DataFrame, m: int, near: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(phrase, key): a word that any text with the phrase has, the one in fewest texts; of short phrases a piece of a word.

    Containment is by characters, so the first and last word of a phrase may be parts of longer words. Phrases of three words or more
    are found by an inner word, those of two by how the first one ends, those of one by how it begins.
    """
    p = phrases.withColumn("t", F.split("phrase", " "))
    inner = p.where(F.size("t") > 2).select("phrase", F.explode(F.array_distinct(F.slice("t", 2, F.size("t") - 2))).alias("w"))
    texts = words.join(near(inner.select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    rarest = inner.join(texts, "w", "left").groupBy("phrase").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w"))
    first = F.get("t", F.lit(0))
    return (
        rarest.select("phrase", F.concat(F.lit("="), "w").alias("key"))
        .unionByName(p.where(F.size("t") == 2).select("phrase", F.concat(F.lit("$"), F.right(first, F.lit(m))).alias("key")))
        .unionByName(p.where(F.size("t") == 1).select("phrase", F.concat(F.lit("~"), F.left(first, F.lit(m))).alias("key")))
    )


def _text_keys(words: DataFrame, m: int) -> DataFrame:
    n = F.length("w")
    ends = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(m))), lambda k: F.concat(F.lit("$"), F.right("w", k)))
    starts = F.when(n >= m, F.transform(F.sequence(F.lit(1), n - m + 1), lambda k: F.concat(F.lit("~"), F.substr("w", k, F.lit(m))))).otherwise(F.array().cast("array<string>"))
    return words.select("article_id", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), "w")), ends, starts))).alias("key"))


def phrases_in(articles: DataFrame, phrases: DataFrame, m: int = LEAST_CHARS) -> DataFrame:
    """(article_id, phrase): the phrases, at least m characters long, that articles(article_id, hay) contain; both in plain form.

    Up to FEW phrases go to every task, so words and pieces of words that no phrase has are dropped where they are made; more are joined.
    """
    phrases = cut(phrases)
    near = F.broadcast if phrases.count() <= FEW else (lambda df: df)
    words = articles.select("article_id", F.explode(F.array_distinct(F.split("hay", " "))).alias("w")).where("w <> ''")
    keys = near(cut(_phrase_keys(phrases, words, m, near)))
    maybe = _text_keys(words, m).join(keys, "key").select("article_id", "phrase").distinct()
    return maybe.join(articles.select("article_id", "hay"), "article_id").where(F.contains("hay", F.col("phrase"))).select("article_id", "phrase")


def match(articles: DataFrame, events: DataFrame, today: date, rejected: DataFrame | None = None) -> DataFrame:
    """(article_id, event_id, match_type, day_gap): the best event of each article that has one.

    articles(article_id, text, published) and events(event_id, title, venue, start_date). A title in the text goes before a venue in it
    with at most VENUE_DAYS between the dates; then the fewest days count, then the smaller event_id. An article without a date is of
    today, a missing start date comes last. Pairs of rejected(article_id, event_id) are left out. Null texts match nothing.
    """
    a = articles.select("article_id", plain(F.col("text")).alias("hay"), F.coalesce("published", F.lit(today)).alias("published"))
    e = events.select("event_id", plain(F.col("title")).alias("title"), plain(F.col("venue")).alias("venue"), "start_date")
    phrases = e.select(F.explode(F.array("title", "venue")).alias("phrase")).where(F.length("phrase") >= LEAST_CHARS).distinct()
    found = phrases_in(a, phrases).join(a.select("article_id", "published"), "article_id")
    gap = F.abs(F.datediff("published", "start_date")).alias("day_gap")
    title = found.join(e, F.col("phrase") == F.col("title")).select("article_id", "event_id", F.lit(0).alias("kind"), gap)
    venue = found.join(e, F.col("phrase") == F.col("venue")).select("article_id", "event_id", F.lit(1).alias("kind"), gap).where(F.col("day_gap") <= VENUE_DAYS)
    links = title.unionByName(venue)
    if rejected is not None:
        links = links.join(rejected, ["article_id", "event_id"], "left_anti")
    best = links.groupBy("article_id").agg(F.min(F.struct("kind", F.col("day_gap").isNull().alias("late"), "day_gap", "event_id")).alias("b"))
    return best.select("article_id", "b.event_id", F.when(F.col("b.kind") == 0, "title").otherwise("venue_date").alias("match_type"), "b.day_gap")


def verdict(match_type: Column, hay: Column, title: Column, venue: Column, city: Column, same_titles: Column, day_gap: Column, most_days: int, home: str, other_places: list[str] = ()) -> Column:
    """verified, candidate or needs_follow_up: texts are in plain form, home is a city that every article names, other_places are in plain form."""
    at_venue = (F.length(venue) >= LEAST_CHARS) & phrase_in(hay, venue)
    in_city = (city != home) & phrase_in(hay, city)
    elsewhere = F.exists(F.array(*(F.lit(p) for p in other_places)), lambda p: (p != F.coalesce(city, F.lit(""))) & phrase_in(hay, p)) if other_places else F.lit(False)
    whole = (match_type == "title") & (F.length(title) >= LEAST_CHARS) & phrase_in(hay, title) & (F.coalesce(same_titles, F.lit(1)) <= 1)
    placed = F.coalesce(at_venue, F.lit(False)) | F.coalesce(in_city, F.lit(False))
    return (
        F.when(~F.coalesce(whole, F.lit(False)), "candidate").when(~placed & elsewhere, "needs_follow_up").when(~placed | ~F.coalesce(day_gap <= most_days, F.lit(False)), "candidate").otherwise("verified")
    )
