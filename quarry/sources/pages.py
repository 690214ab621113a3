"""Feeds, sitemaps, pages and JSON listings read with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitized, squish


def tag(xml: Column, name: str) -> Column:
    """Text of an element: CDATA is opened, markup goes."""
    raw = F.regexp_extract(xml, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.nullif(sanitized(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit(""))


def feed_items(df: DataFrame, column: str) -> DataFrame:
    """title, link, published, summary of every RSS item or Atom entry."""
    others = [c for c in df.columns if c != column]
    x = F.col("_x")
    e = df.select(*others, F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))).alias("_x"))
    href = F.nullif(F.coalesce(F.nullif(F.regexp_extract(x, r"""(?is)<link[^>]*rel=["']alternate["'][^>]*href=["']([^"']+)""", 1), F.lit("")), F.regexp_extract(x, r"""(?is)<link[^>]*href=["']([^"']+)""", 1)), F.lit(""))
    return e.select(*others, tag(x, "title").alias("title"), F.coalesce(tag(x, "link"), href).alias("link"), F.coalesce(tag(x, "pubDate"), tag(x, "published"), tag(x, "updated")).alias("published"), F.coalesce(tag(x, "description"), tag(x, "summary")).alias("summary"))


def rfc822(x: Column) -> Column:
    """Instant of an RFC 822 date; the name of the weekday is ignored."""
    t = F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UT|UTC|Z)$", "+0000")
    return F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z"))


def locations(df: DataFrame, column: str) -> DataFrame:
    """Addresses of a sitemap."""
    return df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("loc"))


def title_of(html: Column) -> Column:
    return squish(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title>(.*?)</title>", 1))


def meta(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)""", 1), F.lit(""))


def links(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, at, href) of every link of a page, in order."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("at", "href"))


def lines(html: Column) -> Column:
    """Lines of text of a page: block elements break them, blank ones go."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", ""), r"(?i)</?(p|div|li|ul|ol|h[1-6]|tr|br|article|section|nav|footer)\b[^>]*>", "\n")
    return F.filter(F.transform(F.split(F.regexp_replace(t, "<[^>]*>", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def json_ld(html: Column, schema: str) -> Column:
    return F.from_json(F.regexp_extract(html, r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>""", 1), schema)


def grouped_instances(listing: DataFrame, key: str, instances: str) -> DataFrame:
    """A listing with one row a day -> one row an event, with all its instances, once each and in order."""
    cols = [c for c in listing.columns if c not in (key, instances)]
    return listing.groupBy(key).agg(*(F.first(c, True).alias(c) for c in cols), F.array_sort(F.array_distinct(F.flatten(F.collect_list(instances)))).alias(instances))


def sitemap(static: list[str], *dynamic: DataFrame) -> DataFrame:
    """(loc) lines of a sitemap, each once: static addresses first."""
    spark = dynamic[0].sparkSession
    out = spark.createDataFrame([(0, s) for s in static], "kind int, loc string")
    for k, d in enumerate(dynamic, 1):
        out = out.unionByName(d.select(F.lit(k).alias("kind"), F.col("loc")))
    return out.groupBy("loc").agg(F.min("kind").alias("kind")).orderBy("kind", "loc").select("loc")


def write_sitemap(lines: DataFrame, path: str, most: int = 50_000) -> None:
    """Text files of at most `most` addresses each, as many as it takes."""
    lines.write.option("maxRecordsPerFile", most).text(path)
