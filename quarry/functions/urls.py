"""Links: parts, classes, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.quality import first_reason
from .text import present

#: Link classes, best first.
CLASSES = ("specific", "shared_generic", "homepage", "wrong_event", "feed_export", "relative", "malformed", "missing")
#: Paths and parameters of feeds and exports, and pages that many events share.
EXPORT_PARTS = ("/common/modules/icalendar/", "icalendar.aspx", "/wp-json/", "/calendar/ical/")
EXPORT_ENDS = (".ics", "/ics", "/feed", "/rss")
EXPORT_FORMATS = ("ical", "ics", "rss", "xml", "json")
HOME_PATHS = r"(?i)^/?(?:index\.(?:html?|php|aspx?)|home/?|en/?)?$"


def is_export(path_: Column, query_: Column) -> Column:
    """A calendar's feed or export by its path or by a format parameter."""
    p = F.lower(F.rtrim(path_, F.lit("/")))
    inside = reduce(lambda a, b: a | b, [F.contains(F.lower(path_), F.lit(x)) for x in EXPORT_PARTS])
    ends = reduce(lambda a, b: a | b, [F.endswith(p, F.lit(x)) for x in EXPORT_ENDS])
    asked = F.exists(F.split(F.lower(query_), "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)).isin("format", "output") & F.split_part(x, F.lit("="), F.lit(2)).isin(*EXPORT_FORMATS))
    return inside | ends | asked


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)


def link_class(url: Column, shared: Column | None = None, own_id: Column | None = None, generic: tuple[str, ...] = ()) -> Column:
    """The class of a link; shared marks links that many different titles carry, own_id is the row's id at the link's site, generic has further pages of many events."""
    u = F.coalesce(present(url), F.lit(""))
    no, page = F.lit(False), F.lower(F.rtrim(F.regexp_replace(u, "(?i)^https?://(www[.])?", ""), F.lit("/")))
    linked = F.regexp_extract(u, r"(?i)/events/(\d+|[0-9a-f-]{36})(?:[/?#]|$)", 1)
    other = (linked != "") & own_id.isNotNull() & (F.lower(linked) != F.lower(own_id)) if own_id is not None else no
    http = u.rlike("(?i)^https?://")
    return first_reason([
        ("missing", u == ""), ("malformed", u.rlike(r"\s")), ("relative", ~u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")), ("malformed", ~http | ~F.contains(host(u), F.lit("."))), ("feed_export", is_export(path(u), query(u))), ("wrong_event", other),
        ("shared_generic", (shared if shared is not None else no) | (page.isin(*generic) if generic else no)), ("homepage", path(u).rlike(HOME_PATHS) & (query(u) == "")),
    ], "specific")


def image_url(url: Column) -> Column:
    """A usable http(s) image address, or the empty text."""
    t = F.coalesce(present(url), F.lit(""))
    return F.when(t.rlike(r"""(?i)^https?://[^\s"'<>]+$"""), t).otherwise("")


def resolve(url: Column, base: Column) -> Column:
    """An absolute address of a link on the page base."""
    u = present(url)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/|))", 1)
    return (
        F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(F.startswith(u, F.lit("//")), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), u))
        .when(F.startswith(u, F.lit("/")), F.concat(origin, u)).otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), u))
    )
