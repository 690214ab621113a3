"""Distances to the edges of polygons, points along rings, and whether parcels lie in one area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import bound
from ..lineage import cut
from .areas import bounds, inside

#: Metres of a degree; metres between points along a ring, and points of an edge at most.
DEGREE, SAMPLE_EVERY, MOST_STEPS = 111_320.0, 5.0, 200


def segments(polygons: DataFrame) -> DataFrame:
    """name, ring, i, ax, ay, bx, by of every edge of polygons(name, rings of [lng, lat])."""
    rings = polygons.select("name", F.posexplode("rings").alias("ring", "r"))
    edges = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))
    return rings.select("name", "ring", F.posexplode(edges).alias("i", "e")).select("name", "ring", "i", "e.*")


def _metres(lng: Column, lat: Column, s: dict[str, Column]) -> Column:
    """Metres from a point to a segment, in a flat projection at the point's latitude."""
    kx, ky = DEGREE * F.cos(F.radians(lat)), F.lit(DEGREE)
    ax, ay, bx, by = (s["ax"] - lng) * kx, (s["ay"] - lat) * ky, (s["bx"] - lng) * kx, (s["by"] - lat) * ky
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    along = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square)))
    return F.hypot(ax + along * dx, ay + along * dy)


#: Edges of a cell that meet its points in one row.
EDGES = 32


def edge_metres(points: DataFrame, polygons: DataFrame, cell: float = 0.01, growth: int = 4) -> DataFrame:
    """points(id, lng, lat) with metres to the nearest edge of all polygons and the polygon's name (ties: the first name).

    Points of one place are looked up once. Edges are put into the cells of a grid that they cross and the eight around these, in lists of
    at most EDGES; a place looks into its own cell. What lies outside is farther than one cell, so a place whose best edge is nearer is
    done; the others look again in cells `growth` times as large. Places meet lists, each giving its own nearest edge, so what is sorted
    and moved grows with lists and not with edges. Points without any edge (no polygons) have null.
    """
    edges = cut(segments(polygons))
    if edges.isEmpty():
        return points.select("id", F.lit(None).cast("double").alias("metres"), F.lit(None).cast("string").alias("name"))
    best = "struct<metres:double,name:string>"
    left = cut(points.where("lng is not null and lat is not null").select("lng", "lat").distinct()).withColumn("best", F.lit(None).cast(best))
    done, size = left.limit(0), cell
    while size < 360 * growth:
        at = lambda x: F.floor(x / F.lit(size)).cast("long")  # noqa: B023, E731
        # pieces of an edge no longer than a cell lie in the cells of their two ends and those between
        pieces = F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / F.lit(size)).cast("int")
        ends = lambda k, n: F.struct(at(F.col("ax") + (F.col("bx") - F.col("ax")) * k / n).alias("x"), at(F.col("ay") + (F.col("by") - F.col("ay")) * k / n).alias("y"))  # noqa: B023, E731
        n = F.greatest(pieces, F.lit(1))
        around = lambda k: F.array(
            F.struct(ends(k, n)["x"].alias("x"), ends(k, n)["y"].alias("y")), F.struct(ends(k + 1, n)["x"].alias("x"), ends(k + 1, n)["y"].alias("y")),  # noqa: B023
            F.struct(ends(k, n)["x"].alias("x"), ends(k + 1, n)["y"].alias("y")), F.struct(ends(k + 1, n)["x"].alias("x"), ends(k, n)["y"].alias("y")),  # noqa: B023
        )
        code = lambda c: c["x"] * (1 << 32) + c["y"]  # noqa: E731  (a number that two cells share only adds edges to look at)
        near = lambda c: F.array(*(c + (i << 32) + j for i in (-1, 0, 1) for j in (-1, 0, 1)))
        cells = edges.withColumn("_c", F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), around)), code)), near)))))
        asked = left.select("lng", "lat", code({"x": at(F.col("lng")), "y": at(F.col("lat"))}).alias("_c"))
        # only cells that some place asks for; a list takes what its part of the cell's edges has, so a crowded cell is many lists
        wanted = cells.join(asked.select("_c").distinct(), "_c", "left_semi").select("_c", "name", "ax", "ay", "bx", "by")
        numbered = wanted.withColumn("_n", F.count("*").over(Window.partitionBy("_c")))
        lists = numbered.withColumn("_l", F.pmod(F.xxhash64("ax", "ay", "bx", "by", "name"), F.ceil(F.col("_n") / EDGES))).groupBy("_c", "_l").agg(F.collect_list(F.struct("ax", "ay", "bx", "by", "name")).alias("e"))
        nearest = F.array_min(F.transform("e", lambda s: F.struct(_metres(F.col("lng"), F.col("lat"), s).alias("metres"), s["name"].alias("name"))))
        found = asked.join(lists, "_c").select("lng", "lat", nearest.alias("new")).groupBy("lng", "lat").agg(F.min("new").alias("new"))
        seen = cut(left.join(found, ["lng", "lat"], "left").withColumn("best", F.when(F.col("best").isNull() | (F.col("new") < F.col("best")), F.coalesce("new", "best")).otherwise(F.col("best"))).drop("new"))
        enough = F.coalesce(F.col("best.metres") <= F.lit(size * DEGREE) * F.cos(F.radians("lat")), F.lit(False))
        done, left, size = done.union(seen.where(enough)), seen.where(~enough), size * growth
        if left.isEmpty():
            break
    return points.select("id", "lng", "lat").join(done.union(left), ["lng", "lat"], "left").select("id", "best.metres", "best.name")


def ring_points(polygons: DataFrame, every: float = SAMPLE_EVERY, most: int = MOST_STEPS) -> DataFrame:
    """name, ring, i, k, lng, lat: points along every edge, at most `every` metres apart and at most `most` of an edge; the edge's end is the next one's start."""
    e = segments(polygons)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steps = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.hypot(dx * DEGREE * F.cos(F.radians("ay")), dy * DEGREE) / every))).cast("int")
    return e.withColumn("_n", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("name", "ring", "i", "k", (F.col("ax") + dx * F.col("k") / F.col("_n")).alias("lng"), (F.col("ay") + dy * F.col("k") / F.col("_n")).alias("lat"))


def _sampled(rings: Column, every: float, most: int = MOST_STEPS) -> Column:
    """array of struct(lng, lat): the points of ring_points of all of a polygon's rings."""

    def edge(a: Column, b: Column) -> Column:
        dx, dy = b[0] - a[0], b[1] - a[1]
        steps = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.hypot(dx * DEGREE * F.cos(F.radians(a[1])), dy * DEGREE) / every))).cast("int")
        return bound(steps, lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((a[0] + dx * k / n).alias("lng"), (a[1] + dy * k / n).alias("lat"))))

    return F.flatten(F.transform(rings, lambda r: F.flatten(F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), edge))))


def _areas_near(parcels: DataFrame, areas: DataFrame, cell: float = 0.05) -> DataFrame:
    """name, rings, area, area_rings: parcels with the areas whose first ring's box meets theirs; a pair is met in the one cell of its boxes' common corner."""
    floor = lambda x: F.floor(x / cell)
    cells = lambda b: F.flatten(F.transform(F.sequence(floor(b["west"]), floor(b["east"])), lambda x: F.transform(F.sequence(floor(b["south"]), floor(b["north"])), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    whole = lambda rings: bounds(F.array(F.flatten(rings)))
    p = parcels.withColumn("_p", whole(F.col("rings"))).withColumn("_c", F.explode_outer(cells(F.col("_p"))))
    a = areas.select(F.col("name").alias("area"), F.col("rings").alias("area_rings"), bounds(F.col("rings")).alias("_a")).withColumn("_c", F.explode_outer(cells(F.col("_a"))))
    meet = (F.col("_p.west") <= F.col("_a.east")) & (F.col("_a.west") <= F.col("_p.east")) & (F.col("_p.south") <= F.col("_a.north")) & (F.col("_a.south") <= F.col("_p.north"))
    once = (F.col("_c.x") == floor(F.greatest("_p.west", "_a.west"))) & (F.col("_c.y") == floor(F.greatest("_p.south", "_a.south")))
    return p.join(a, "_c").where(meet & once).select("name", "rings", "area", "area_rings")


def parcel_areas(parcels: DataFrame, areas: DataFrame, every: float = SAMPLE_EVERY) -> DataFrame:
    """name, recorded, status, area of parcels(name, rings, recorded): settled where every point along its edges lies in the one area that its record names.

    Otherwise no_geometry (fewer than three different corners), outside (a point in no area), crosses_boundary, or record_and_drawing_disagree.
    """
    corners = F.size(F.array_distinct(F.transform(F.col("rings")[0], lambda p: F.concat_ws(",", p[0], p[1]))))
    drawn = parcels.where(F.coalesce(corners, F.lit(0)) >= 3)
    near = _areas_near(drawn.select("name", "rings"), areas)
    held = bound(_sampled(F.col("rings"), every), lambda ps: F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda k: bound(F.get(ps, k), lambda p: F.coalesce(inside(p["lng"], p["lat"], F.col("area_rings")), F.lit(False)))))
    hits = near.select("name", "area", held.alias("hits")).where(F.size("hits") > 0)
    by_parcel = hits.groupBy("name").agg(F.min("area").alias("first"), F.max("area").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("held"))
    seen = drawn.groupBy("name").agg(F.max(F.size(_sampled(F.col("rings"), every))).alias("points")).join(by_parcel, "name", "left").select("name", "first", "last", (F.coalesce("held", F.lit(0)) < F.col("points")).alias("out"))
    same = F.lower(F.trim("first")) == F.lower(F.trim(F.coalesce("recorded", F.lit(""))))
    status = F.when(F.col("out").isNull(), "no_geometry").when(F.col("out") & F.col("first").isNull(), "outside").when(F.col("out") | (F.col("first") != F.col("last")), "crosses_boundary").when(~same, "record_and_drawing_disagree").otherwise("settled")
    return parcels.join(seen, "name", "left").select("name", "recorded", status.alias("status"), F.when(status == "settled", F.col("first")).alias("area"))
