"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Sizes are words `[^\\x20\\x09-\\x0D]+` (null text: 0). Sources in code-point order, null last, weigh `weights`, repeating, and share
`share` of all words; a target stops at `cap` times its source's words and the excess is reshared by weight. A source's weight at time u
of training is its weight times 1 + ramp * (2u - 1); the integral of that schedule is its cumulative demand, and a document that starts
at y of its source's demand gets the position u where the integral is y. Documents of a source follow one another by md5 of doc_id; a
second pass begins where the first has used them all, so no document is taken more than twice and the last one taken may be taken in part.

The running sums are split: documents are counted by (source, slice of the md5 range), the slices are summed up in order, and only within
a slice are documents put in order, so a source with a third of all rows is many small windows. Sources themselves (one row each) are
ranked in one task. A null doc_id sorts by its text, after a slash; repeated rows count each; a null text has no words, a very long one is
counted whole. Other columns are carried along; one named like a result gives way to it. An empty table gives no rows. Rows come in order
of their first position; a second pass has its own, `position2`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, without

WEIGHTS, RAMPS = (3, 1, 2), (-0.5, 0.0, 0.5)
_WORD = r"[^\x20\x09-\x0D]+"


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _cycle(values, rank) -> F.Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, share: float, weights, ramps, cap: float) -> DataFrame:
    """source, source_size, target, ramp from (source, source_size): one row a source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("ramp", _cycle(ramps, F.col("rank")))
    every = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    filled = (
        ranked.withColumn("limit", F.col("source_size").cast("double") * cap)
        .withColumn("goal", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("level", (F.col("goal") - F.coalesce(F.sum("limit").over(before), none)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none)))
        .withColumn("full", F.col("limit") / F.col("weight") <= F.col("level"))
        # the level that the sources below their limit share
        .withColumn("shared", F.first(F.when(~F.col("full"), F.col("level")), True).over(Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * F.col("shared")).alias("target"), "ramp")


def position(y, ramp) -> F.Column:
    """The time u in 0..1 at which the integral u * (1 - ramp) + ramp * u**2 of a schedule is y."""
    b = 1 - ramp
    return 2 * y / (b + F.sqrt(b * b + 4 * ramp * y))


def mix(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, ramps=RAMPS, cap: float = 2.0, keep: bool = False) -> DataFrame:
    """Columns of docs (text with keep), then size, source_size, target, taken, position, position2 (of a second pass), in order of position."""
    names = without([c for c in docs.columns if keep or c != "text"], ("size", "source_size", "target", "taken", "position", "position2"))
    sized = docs.select(F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"), words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), "text"), F.lit("")).cast("binary")).alias("key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    if not keep:
        sized = cut(sized)
    rows = sized.count()
    bits = max(0, min(24, (max(rows, 1).bit_length() + 1) // 2))  # about the square root of the rows in slices, and in the fullest one
    sized = sized.withColumn("part", F.shiftright(F.conv(F.substring("key", 1, 6), 16, 10).cast("int"), 24 - bits))
    parts = cut(sized.groupBy("_source", "part").agg(F.sum("size").alias("words")))
    sizes = parts.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size"))
    goals = targets(sizes, share, weights, ramps, cap)
    earlier = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_source", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    starts = cut(starts.join(goals, F.col("_source").eqNullSafe(F.col("source"))).select(F.col("_source").alias("s"), F.col("part").alias("p"), "start", "source_size", "target", "ramp"))
    inside = Window.partitionBy("_source", "part").orderBy("key", F.col("_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sized.withColumn("at", F.sum("size").over(inside) - F.col("size"))
    placed = run.join(starts, F.col("_source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("at", F.col("at") + F.col("start"))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    zero = F.lit(0).cast("long")
    first = F.greatest(zero, F.least(F.col("size"), goal - F.col("at")))
    second = F.greatest(zero, F.least(F.col("size"), goal - F.col("source_size") - F.col("at")))
    out = placed.select(
        *(F.col(f"row.`{c}`").alias(c) for c in names), "size", "source_size", "target", (first + second).alias("taken"),
        F.when(first > 0, position(F.col("at") / F.col("target"), F.col("ramp"))).alias("position"),
        F.when(second > 0, position((F.col("at") + F.col("source_size")) / F.col("target"), F.col("ramp"))).alias("position2"),
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")
