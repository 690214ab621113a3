"""Two snapshots of a table compared through checksums of key ranges: only ranges that differ are joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading bits of a key's hash that name a leaf range, and bits that a level of the tree adds.
BITS, STEP = 12, 4


def range_of(key: str, bits: int = BITS) -> Column:
    """The leaf range of a key: the leading bits of its hash; a null key has one too."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - bits).cast("int")


def checksums(df: DataFrame, key: str, columns: list[str], bits: int = BITS, step: int = STEP) -> DataFrame:
    """level, range, n, sum, xor of every range of a tree: level 0 is the table, each level splits a range into 2**step.

    Sums and parities of rows' hashes don't depend on order; the hash tells null from every value. Leaves are summed up in one pass.
    """
    row = F.xxhash64(F.col(key), *(x for c in columns for x in (F.col(c).isNull(), F.col(c))))
    leaf = df.select(range_of(key, bits).alias("range"), row.alias("h")).groupBy("range").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("xor"))
    levels = F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright("range", bits - min(i * step, bits)).alias("range")) for i in range(-(-bits // step) + 1)))
    up = leaf.select(F.explode(levels).alias("l"), "n", "sum", "xor").groupBy("l").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor"))
    return up.select("l.level", "l.range", "n", "sum", "xor")


def differing(a: DataFrame, b: DataFrame, bits: int = BITS, step: int = STEP) -> DataFrame:
    """Leaf ranges whose checksums differ, found from the root: of a level only the children of ranges that differ are compared."""
    last = -(-bits // step)
    open_ = None
    for level in range(last + 1):
        x, y = (s.where(F.col("level") == level).select("range", F.struct("n", "sum", "xor").alias(n)) for s, n in ((a, "x"), (b, "y")))
        if open_ is not None:
            width = min(step, bits - (level - 1) * step)
            parents = open_.select(F.col("range").alias("parent"))
            x, y = (s.join(parents, F.shiftright("range", width) == F.col("parent"), "left_semi") for s in (x, y))
        open_ = x.join(y, "range", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("range")
    return open_


def narrowed(df: DataFrame, key: str, ranges: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of the given ranges; there are at most 2**bits of these, so they are broadcast."""
    return df.withColumn("_range", range_of(key, bits)).join(F.broadcast(ranges.select(F.col("range").alias("_range"))), "_range", "left_semi").drop("_range")


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str], bits: int = BITS) -> DataFrame:
    """key, change (added, removed, changed), reasons (names of the columns that changed): keys are unique in each snapshot."""
    ranges = differing(checksums(before, key, columns, bits), checksums(after, key, columns, bits), bits)
    side = lambda df, n: narrowed(df.select(key, *columns), key, ranges, bits).select(F.col(key).alias(f"_{n}"), F.lit(True).alias(f"_has_{n}"), F.struct(*columns).alias(n))
    j = side(before, "x").join(side(after, "y"), F.col("_x").eqNullSafe(F.col("_y")), "full")
    reasons = F.array_compact(F.array(*(F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), c) for c in columns)))
    change = F.when(F.col("_has_x").isNull(), "added").when(F.col("_has_y").isNull(), "removed").when(F.size(reasons) > 0, "changed")
    out = j.select(F.coalesce("_x", "_y").alias(key), change.alias("change"), F.when(change == "changed", reasons).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return out.where("change is not null")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables and whether they are the same rows, from checksums alone."""
    top = [s.where("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{n}"), F.first("sum").alias(f"s_{n}"), F.first("xor").alias(f"x_{n}")) for s, n in ((a, "a"), (b, "b"))]
    return reduce(lambda x, y: x.join(y), top).select("n_a", "n_b", (F.col("s_a").eqNullSafe(F.col("s_b")) & F.col("x_a").eqNullSafe(F.col("x_b")) & (F.col("n_a") == F.col("n_b"))).alias("same"))  # one row each


def staleness(rows: DataFrame, created: str, updated: str, now: Column, days: int = 3) -> DataFrame:
    """n, newest creation and update, and how many rows were not updated for `days`."""
    return rows.agg(F.count("*").alias("n"), F.max(created).alias("newest_created"), F.max(updated).alias("newest_updated"), F.count_if(F.col(updated) < now - F.make_interval(days=F.lit(days))).alias("stale"))
