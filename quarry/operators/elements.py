"""Elements of pages as intervals of tokens, and the innermost container of each: windows and equi-joins, no products.

Start and end tags are matched by name: an end tag closes the last open element of its name. An element that the page never closes ends
with the next one of its name where HTML allows that (paragraphs, items, cells), else with the page. Containers of one call are expected to
be nested in one another; where pages cross them, the one opened last at that depth counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements that may go without an end tag, and those that have no content.
OPEN_ENDED = ("p", "li", "td", "th", "tr", "dt", "dd", "option")
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, token, tag (null for text), kind: 1 start, -1 end, 0 text and elements without content."""
    parts = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), _HIDDEN, ""), F.lit(r"<[^>]*>|[^<]+"), F.lit(0))
    rows = pages.select(key, F.posexplode(parts).alias("pos", "token"))
    tag = F.nullif(F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)), F.lit(""))
    rows = rows.withColumn("tag", tag)
    return rows.withColumn("kind", F.when(F.col("tag").isNull() | F.col("tag").isin(*EMPTY), 0).when(F.startswith("token", F.lit("</")), -1).otherwise(1))


def elements(tags: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """key, tag, pre, post, token of every element of these names: its content lies between the positions pre and post."""
    own = tags.where(F.col("tag").isin(*names) & (F.col("kind") != 0))
    order = Window.partitionBy(key, "tag").orderBy("pos")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # an open-ended element's own start closes the last one; end tags too many don't go below zero
    flat = F.col("tag").isin(*OPEN_ENDED)
    level = F.sum("kind").over(run)
    lowest = F.min("sum").over(run)
    own = own.withColumn("sum", level).withColumn("depth", F.col("sum") - F.least(F.lit(0), lowest) - F.when(F.col("kind") == 1, 1).otherwise(0))
    own = own.withColumn("depth", F.when(flat, 0).otherwise(F.col("depth")))
    following = Window.partitionBy(key, "tag", "depth").orderBy("pos")
    end = F.lead("pos").over(following)
    out = own.withColumn("post", F.coalesce(end, F.lit(2**31 - 1))).where("kind = 1")
    return out.select(key, "tag", F.col("pos").alias("pre"), "post", "token")


def innermost(points: DataFrame, containers: DataFrame, key: str, at: str = "pre") -> DataFrame:
    """points with pre of the innermost container that holds them as `container`; those in none are left out.

    Starts, ends and points stand in one order; a point's depth is the number of containers open there, and its container the last one
    opened at that depth.
    """
    marks = containers.select(key, F.col("pre").alias("_p"), F.lit(1).alias("_k")).union(containers.select(key, "post", F.lit(-1)))
    rows = marks.select(key, "_p", "_k", F.lit(None).cast(_kind(points)).alias("_row")).union(points.select(key, F.col(at), F.lit(0), F.struct(*points.columns)))
    order = Window.partitionBy(key).orderBy("_p", "_k")  # at one position: ends, points, starts
    deep = rows.withColumn("_d", F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.when(F.col("_k") == -1, 1).otherwise(0))
    last = F.last(F.when(F.col("_k") == 1, F.col("_p")), True).over(Window.partitionBy(key, "_d").orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return deep.withColumn("container", last).where("_k = 0 and _d > 0").select("_row.*", "container")


def _kind(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema) + ">"


def attribute(token: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(token, rf"""(?i)\s{name}\s*=\s*["']([^"']*)""", 1), F.lit(""))


def cards(pages: DataFrame, key: str, html: str, containers: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """key, card (its position), tag, class, fields: array of struct(pre, tag, href, text) in page order, of every container of a page."""
    rows = tokens(pages, key, html)
    boxes = elements(rows, key, containers)
    inner = elements(rows, key, fields)
    texts = rows.where("tag is null").select(key, "pos", "token")
    said = innermost(texts, inner, key, "pos").groupBy(key, "container").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("text"))
    read = inner.join(said.withColumnRenamed("container", "pre"), [key, "pre"], "left").select(key, "pre", "tag", attribute(F.col("token"), "href").alias("href"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("text"))
    held = innermost(read, boxes, key).groupBy(key, "container").agg(F.array_sort(F.collect_list(F.struct("pre", "tag", "href", "text"))).alias("fields"))
    out = boxes.join(held.withColumnRenamed("container", "pre"), [key, "pre"], "left")
    return out.select(key, F.col("pre").alias("card"), "tag", attribute(F.col("token"), "class").alias("class"), F.coalesce("fields", F.array().cast("array<struct<pre:int,tag:string,href:string,text:string>>")).alias("fields"))


def page_images(pages: DataFrame, key: str, html: str, main: str = "article") -> DataFrame:
    """key, src, place: every image of a page, by whether the page states it (meta), it lies in the main element (main), or elsewhere (other)."""
    rows = tokens(pages, key, html)
    stated = rows.where((F.col("tag") == "meta") & F.lower(F.col("token")).rlike(r"(property|name)\s*=\s*[\"'](og:image|twitter:image)[\"']")).select(key, attribute(F.col("token"), "content").alias("src"), F.lit("meta").alias("place"))
    shown = rows.where("tag = 'img'").select(key, "pos", attribute(F.col("token"), "src").alias("src"))
    inside = innermost(shown, elements(rows, key, (main,)), key, "pos").select(key, "pos").withColumn("_in", F.lit(True))
    return stated.union(shown.join(inside, [key, "pos"], "left").select(key, "src", F.when(F.col("_in"), "main").otherwise("other"))).where("src is not null")
