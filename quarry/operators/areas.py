"""Points and tables of polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(lng: Column, lat: Column, rings: Column) -> Column:
    """Half-open ray casting over rings of [lng, lat]: inside the first and none of the others."""

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        hit = lambda e: ((e["a"][1] > lat) != (e["b"][1] > lat)) & (lng < (e["b"][0] - e["a"][0]) * (lat - e["a"][1]) / (e["b"][1] - e["a"][1]) + e["a"][0])
        return F.size(F.filter(edges, lambda e: F.coalesce(hit(e), F.lit(False)))) % 2 == 1

    return crossings(rings[0]) & ~F.exists(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), crossings)


def within(points: DataFrame, polygons: DataFrame, cell: float = 0.05) -> DataFrame:
    """points(id, lng, lat, ...) with the name of the polygons(name, rings) that hold them: an equi-join on grid cells, then the exact test.

    Each polygon is met once for every cell of its bounding box, each point in one cell; a point of no polygon is left out, one of
    several comes once for each.
    """
    ring = F.col("rings")[0]
    lo = lambda k: F.floor(F.array_min(F.transform(ring, lambda p: p[k])) / cell)
    hi = lambda k: F.floor(F.array_max(F.transform(ring, lambda p: p[k])) / cell)
    g = polygons.withColumn("_x", F.explode(F.sequence(lo(0), hi(0)))).withColumn("_y", F.explode(F.sequence(lo(1), hi(1))))
    p = points.withColumn("_x", F.floor(F.col("lng") / cell)).withColumn("_y", F.floor(F.col("lat") / cell))
    return p.join(g, ["_x", "_y"]).where(inside(F.col("lng"), F.col("lat"), F.col("rings"))).select(*points.columns, "name").distinct()


def bounds(rings: Column) -> Column:
    """struct(west, south, east, north) of a polygon's first ring."""
    of = lambda f, k: f(F.transform(rings[0], lambda p: p[k]))
    return F.struct(of(F.array_min, 0).alias("west"), of(F.array_min, 1).alias("south"), of(F.array_max, 0).alias("east"), of(F.array_max, 1).alias("north"))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two near points, in a flat projection."""
    return F.hypot((lat2 - lat1) * 111_320.0, (lng2 - lng1) * 111_320.0 * F.cos(F.radians((lat1 + lat2) / 2)))


#: Fixed value: metres within which candidates are one place.
SAME_SPOT = 30.0


def geocode_answer(candidates: Column, state: Column, spread: float = SAME_SPOT) -> Column:
    """struct(status, lat, lng) of array of struct(lat, lng, state): candidates of the state that lie together are one place, else ambiguous."""
    own = F.filter(candidates, lambda x: x["state"] == state)
    first = F.get(own, F.lit(0))
    near = F.forall(own, lambda x: metres(first["lat"], first["lng"], x["lat"], x["lng"]) <= spread)
    status = F.when(F.coalesce(F.size(candidates), F.lit(0)) == 0, "no_match").when(F.size(own) == 0, "other_state").when(near, "ok").otherwise("ambiguous")
    return F.struct(status.alias("status"), F.when(status == "ok", first["lat"]).alias("lat"), F.when(status == "ok", first["lng"]).alias("lng"))
