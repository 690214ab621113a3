"""Discovery: a canonical state (when, where, what, search) compiled to one predicate, counts and leave-one-out facets.

Events have the columns id, title, venue, city, neighborhood, category (a dotted path), free, source, start_date, end_date, semantics,
occurrence_dates, time, all_day, lat and lng; `prepare` adds what the predicate needs once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.geo import ORBIT, haversine

MODES = ("today", "tonight", "tomorrow", "weekend", "week", "next7", "all", "dates")
#: Fixed value: characters of a search that count.
QUERY_CAP = 200


@dataclass(frozen=True)
class State:
    mode: str = "all"
    first: date | None = None
    last: date | None = None
    neighborhood: str | None = None
    origin: tuple[float, float] | None = None
    radius: float | None = None
    categories: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    free: bool = False
    search: str = ""

    def canonical(self, taxonomy: tuple[str, ...] = ()) -> State:
        """Sorted, without repetitions; all categories are no filter; reversed dates are swapped; an unknown mode is all."""
        cats = tuple(sorted(set(self.categories)))
        if taxonomy and set(taxonomy) <= set(cats):
            cats = ()
        a, b = self.first, self.last
        if a and b and a > b:
            a, b = b, a
        mode = self.mode if self.mode in MODES else "all"
        return replace(self, mode=mode, first=a if mode == "dates" else None, last=b if mode == "dates" else None, categories=cats, features=tuple(sorted(set(self.features))), search=" ".join(self.search.split())[:QUERY_CAP])

    def query(self) -> str:
        pairs = [("when", self.mode)] if self.mode != "all" else []
        pairs += [(k, v.isoformat()) for k, v in (("from", self.first), ("to", self.last)) if v]
        pairs += [(k, v) for k, v in (("nb", self.neighborhood), ("cat", ",".join(self.categories)), ("feature", ",".join(self.features)), ("q", self.search)) if v]
        if self.free:
            pairs.append(("free", "1"))
        if self.radius is not None and self.origin:
            pairs += [("at", f"{self.origin[0]},{self.origin[1]}"), ("within", f"{self.radius:g}")]
        return urlencode(pairs)

    @classmethod
    def parse(cls, text: str) -> State:
        """The first value of a key counts; what cannot be read is ignored."""
        got: dict[str, str] = {}
        for k, v in parse_qsl(text.lstrip("?"), keep_blank_values=True):
            got.setdefault(k, v)

        def read(kind, k):
            try:
                return kind(got[k])
            except (KeyError, ValueError):
                return None

        at = read(lambda v: tuple(float(x) for x in v.split(",")), "at")
        split = lambda k: tuple(x for x in got.get(k, "").split(",") if x)
        return cls(
            got.get("when", "all"), read(date.fromisoformat, "from"), read(date.fromisoformat, "to"), got.get("nb") or None, at if at and len(at) == 2 else None, read(float, "within"),
            split("cat"), split("feature"), got.get("free") == "1", got.get("q", ""),
        ).canonical()


def window(state: State, today: date) -> tuple[date | None, date | None, bool, bool]:
    """(from, to, evening only, forward): all modes but dates start no earlier than today."""
    day = today.isoweekday()
    week = {
        "today": (today, today), "tonight": (today, today), "tomorrow": (today + timedelta(1), today + timedelta(1)), "next7": (today, today + timedelta(6)),
        "weekend": (today + timedelta(5 - day), today + timedelta(7 - day)), "week": (today + timedelta(1 - day), today + timedelta(7 - day)), "dates": (state.first, state.last),
    }
    a, b = week.get(state.mode, (None, None))
    forward = state.mode != "dates"
    return max(a, today) if forward and a else today if forward else a, b, state.mode == "tonight", forward


def prepare(events: DataFrame) -> DataFrame:
    """Adds last_date, night, state and days (the explicit dates)."""
    c = F.col
    e = events.withColumn("last_date", D.last_day(c("start_date"), c("end_date"))).withColumn("night", D.overnight(c("start_date"), c("end_date"), c("time"), c("all_day")))
    e = e.withColumn("state", D.schedule_state(c("semantics"), c("start_date"), c("end_date"), c("occurrence_dates"), c("night")))
    return e.withColumn("days", D.explicit_dates(c("state"), c("semantics"), c("start_date"), c("occurrence_dates")))


def when(state: State, today: date, minutes: int) -> Column:
    """Open in the window. Days that are certain count one by one; an unverified range counts only in mode all."""
    a, b, night, forward = window(state, today)
    now = F.lit(today)
    over = D.ended(F.col("time"), F.lit(minutes))
    inside = lambda lo, hi: reduce(lambda x, y: x & y, [hi >= F.lit(a) if a else F.lit(True), lo <= F.lit(b) if b else F.lit(True)])
    alive = lambda d: ((d > now) | ((d == now) & ~over)) if forward else F.lit(True)
    some = F.exists("days", lambda d: alive(d) & inside(d, d))
    unsure = F.lit(state.mode == "all") & alive(F.col("last_date")) & (F.col("last_date") >= F.lit(a) if a else F.lit(True))
    whole = alive(F.col("last_date")) & inside(F.col("start_date"), F.col("last_date"))
    open_ = F.when(F.col("days").isNull(), whole).when(F.size("days") == 0, unsure).otherwise(some)
    return F.coalesce(F.col("start_date").isNotNull() & open_ & (D.evening(F.col("time")) if night else F.lit(True)), F.lit(False))


def what(state: State, features: dict[str, Column], skip: str | None = None) -> Column:
    out = F.lit(True)
    if state.categories and skip != "category":
        out = out & F.coalesce(F.col("category").isin(*state.categories) | reduce(lambda x, y: x | y, [F.startswith("category", F.lit(f"{p}.")) for p in state.categories]), F.lit(False))
    if state.free:
        out = out & F.coalesce(F.col("free"), F.lit(False))
    if skip != "feature":
        for f in state.features:
            out = out & F.coalesce(features[f], F.lit(False))
    return out


def search(state: State) -> Column:
    if not state.search:
        return F.lit(True)
    hay = F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "venue", "city", "category", "neighborhood", "source"))))
    return F.contains(hay, F.lit(state.search.lower()))


def where(state: State, skip: str | None = None) -> Column:
    """A city without coordinates is never guessed at."""
    out = F.lit(True)
    if state.neighborhood and skip != "neighborhood":
        out = out & F.coalesce(F.col("neighborhood") == state.neighborhood, F.lit(False))
    if state.radius is not None and state.origin and skip != "place":
        far = haversine(F.lit(state.origin[0]), F.lit(state.origin[1]), F.col("lat"), F.col("lng"))
        out = out & F.coalesce(far <= state.radius, F.lit(False))
    return out


def blocked(names: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(n.lower())) for n in names], F.lit(False))


def predicate(state: State, today: date, minutes: int = 0, features: dict[str, Column] | None = None, skip: str | None = None, names: tuple[str, ...] = ()) -> Column:
    return ~blocked(names) & what(state, features or {}, skip) & search(state) & where(state, skip) & when(state, today, minutes)


def inventory(today: date) -> Column:
    """What is still to come: pushed down to the scan as plain comparisons."""
    return (F.col("start_date") >= F.lit(today)) | (F.col("end_date") >= F.lit(today))


def distinct(events: DataFrame) -> DataFrame:
    """Events once by id; rows without an id each count."""
    return events.where("id is not null").dropDuplicates(["id"]).unionByName(events.where("id is null"))


def count(events: DataFrame, state: State, today: date, **more) -> DataFrame:
    hit = prepare(events).where(predicate(state, today, **more))
    return hit.agg((F.countDistinct("id") + F.count_if(F.col("id").isNull())).alias("n"))


def facet(events: DataFrame, state: State, today: date, by: str, values: DataFrame | None = None, skip: str | None = None, **more) -> DataFrame:
    """(value, n) with the dimension's own filter left out; with values(value), zeros are kept."""
    hit = prepare(events).where(predicate(state, today, skip=skip or by, **more))
    n = hit.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("value")).agg(F.countDistinct("id").alias("n"))
    return n if values is None else values.join(n, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def unconfirmed(events: DataFrame, state: State, today: date, **more) -> DataFrame:
    """Unverified ranges that overlap the window: a list of their own, never counted."""
    a, b, _, _ = window(state, today)
    e = prepare(events).where(what(state, more.get("features") or {}) & search(state) & where(state) & (F.col("state") == "unverified"))
    if a:
        e = e.where(F.col("last_date") >= F.lit(a))
    return e.where(F.col("start_date") <= F.lit(b)) if b else e
