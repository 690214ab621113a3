"""Answers of listing services, JSON texts in a column, read into event rows by a schema and a table of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clocktext import clock_of, least_paid
from ..functions.text import present

#: Schemas of the answers, as far as they are used.
DISCOVERY = "_embedded struct<events: array<struct<id: string, name: string, url: string, dates: struct<start: struct<localDate: string, localTime: string>, status: struct<code: string>>, classifications: array<struct<segment: struct<name: string>, genre: struct<name: string>>>, priceRanges: array<struct<min: double>>, _embedded: struct<venues: array<struct<name: string, city: struct<name: string>>>>>>>"
ORGANISER = "events array<struct<id: string, name: struct<text: string>, url: string, status: string, is_free: boolean, start: struct<local: string>, end: struct<local: string>, venue: struct<name: string, address: struct<city: string>>>>"
SHOWS = "data array<struct<id: string, name: string, url: string, dates: array<string>, cost_tiers: array<struct<cost_after_fees: int>>, venue: struct<name: string>>>"
CALENDAR = "events array<struct<id: long, title: string, url: string, start_date: string, end_date: string, all_day: boolean, venue: struct<venue: string, city: string>, image: struct<url: string, sizes: map<string, struct<url: string, width: int>>>>>"
#: Fixed values: (segment, genre or None for any) -> category; what is not listed is left out.
CATEGORIES = {("Music", None): "music", ("Sports", None): "sports", ("Arts & Theatre", "Comedy"): "comedy", ("Arts & Theatre", "Dance"): "dance", ("Arts & Theatre", None): "theater", ("Miscellaneous", "Fairs & Festivals"): "fest"}


def items(df: DataFrame, column: str, schema: str, path: str) -> DataFrame:
    """The other columns of df, and x: an item of the array at path; a text that is no such JSON gives no rows."""
    others = [c for c in df.columns if c != column]
    at = F.from_json(F.col(column), schema)
    for part in path.split("."):
        at = at[part]
    return df.select(*others, F.explode(at).alias("x"))


def category(segment: Column, genre: Column) -> Column:
    """The category of the most specific entry, or null where the service's pair is not mapped."""
    exact = [F.when((segment == s) & (genre == g), v) for (s, g), v in CATEGORIES.items() if g]
    return F.coalesce(*exact, *(F.when(segment == s, v) for (s, g), v in CATEGORIES.items() if g is None))


def ticket_events(df: DataFrame, column: str) -> DataFrame:
    """external_id, title, start_date, time, category, venue, city, url, price_from of events that are not cancelled and have a mapped category."""
    x, k = F.col("x"), F.col("x.classifications")[0]
    kind = category(k["segment"]["name"], k["genre"]["name"])
    e = items(df, column, DISCOVERY, "_embedded.events").where(~F.coalesce(F.lower("x.dates.status.code").isin("cancelled", "canceled"), F.lit(False)))
    v = x["_embedded"]["venues"][0]
    return e.select(
        F.concat(F.lit("tm-"), x["id"]).alias("external_id"), present(x["name"]).alias("title"), x["dates"]["start"]["localDate"].try_cast("date").alias("start_date"), clock_of(x["dates"]["start"]["localTime"]).alias("time"), kind.alias("category"),
        v["name"].alias("venue"), v["city"]["name"].alias("city"), x["url"].alias("url"), F.array_min(F.transform(x["priceRanges"], lambda p: p["min"])).alias("price_from"),
    ).where("category is not null and start_date is not null and title is not null")


def organiser_events(df: DataFrame, column: str) -> DataFrame:
    """external_id, title, start_date, end_date, time, venue, city, url, is_free of live events."""
    x = F.col("x")
    day = lambda t: F.substring(t, 1, 10).try_cast("date")
    s, e = day(x["start"]["local"]), day(x["end"]["local"])
    return items(df, column, ORGANISER, "events").where("x.status = 'live'").select(
        F.concat(F.lit("eventbrite-"), x["id"]).alias("external_id"), present(x["name"]["text"]).alias("title"), s.alias("start_date"), F.when(e > s, e).alias("end_date"), clock_of(F.substring(x["start"]["local"], 12, 5)).alias("time"),
        x["venue"]["name"].alias("venue"), x["venue"]["address"]["city"].alias("city"), F.regexp_replace(x["url"], r"\?.*$", "").alias("url"), F.coalesce(x["is_free"], F.lit(False)).alias("is_free"),
    )


def show_dates(df: DataFrame, column: str, today: Column) -> DataFrame:
    """One row for each coming date of a show: external_id, title, start_date, time, price_from, is_free, url."""
    x = F.col("x")
    d = items(df, column, SHOWS, "data").where("x.name is not null").withColumn("at", F.explode("x.dates"))
    paid = least_paid(F.transform(x["cost_tiers"], lambda c: c["cost_after_fees"]))
    return d.select(
        F.concat(F.lit("show-"), x["id"], F.lit("-"), F.substring("at", 1, 16)).alias("external_id"), present(x["name"]).alias("title"), F.substring("at", 1, 10).try_cast("date").alias("start_date"), clock_of(F.substring("at", 12, 5)).alias("time"),
        F.when(paid > 0, paid).alias("price_from"), F.coalesce(paid == 0, F.lit(False)).alias("is_free"), x["url"].alias("url"),
    ).where(F.col("start_date") >= today).dropDuplicates(["external_id"])


def calendar_events(df: DataFrame, column: str) -> DataFrame:
    """external_id, title, start_date, end_date, time, venue, city, url, image of a calendar plugin's events; the image is the widest of at most 1,200."""
    x = F.col("x")
    s, e = F.substring(x["start_date"], 1, 10).try_cast("date"), F.substring(x["end_date"], 1, 10).try_cast("date")
    hm = lambda t: clock_of(F.substring(t, 12, 5))
    range_ = F.when(hm(x["end_date"]).isNull() | (x["end_date"] == x["start_date"]) | (e > s), hm(x["start_date"])).otherwise(F.concat(hm(x["start_date"]), F.lit(" – "), hm(x["end_date"])))
    sizes = F.filter(F.transform(F.map_values(x["image"]["sizes"]), lambda z: F.struct(z["width"].alias("width"), z["url"].alias("url"))), lambda z: z["width"] <= 1200)
    return items(df, column, CALENDAR, "events").select(
        F.concat(F.lit("tribe-"), x["id"].cast("string")).alias("external_id"), present(x["title"]).alias("title"), s.alias("start_date"), F.when(e > s, e).alias("end_date"), F.when(~F.coalesce(x["all_day"], F.lit(False)), range_).alias("time"),
        x["venue"]["venue"].alias("venue"), x["venue"]["city"].alias("city"), x["url"].alias("url"), F.coalesce(F.array_max(sizes)["url"], x["image"]["url"]).alias("image"),
    )


def polygons(df: DataFrame, column: str, name: str) -> DataFrame:
    """(name, part, rings) of the areas of GeoJSON feature collections: a multipolygon's parts are rows of one name."""
    kinds = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}
    f = df.select(F.explode(F.from_json(F.col(column), f"features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>")["features"]).alias("f"))
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", kinds["Polygon"]))).otherwise(F.from_json("f.geometry.coordinates", kinds["MultiPolygon"]))
    return f.select(F.col("f.properties")[name].alias("name"), F.posexplode(parts).alias("part", "rings"))
