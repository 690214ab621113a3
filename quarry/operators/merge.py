"""Keyed merges that know an absent key from a null, owner locks, withdrawal, range preservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present

#: A withdrawal of more rows than this and more than this share is refused.
MOST_WITHDRAWN, MOST_SHARE = 5, 0.2


def upsert(stored: DataFrame, patch: DataFrame, key: str, locked: str | None = None) -> DataFrame:
    """stored with patch merged in: patch.present (array of names) says which columns a row brings; others keep what is stored.

    A null that is present overwrites. Columns named in the stored row's array `locked` are never overwritten. A key met twice in patch
    is an error, as its order would decide.
    """
    cols = [c for c in stored.columns if c not in (key, locked)]
    p = patch.groupBy(key).agg(F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string")))).otherwise(F.first(F.struct("present", *(c for c in cols if c in patch.columns)))).alias("p"))
    s = stored.select(F.col(key).alias("_k"), F.struct(*stored.columns).alias("s"))
    j = s.join(p, F.col("_k") == F.col(key), "full_outer")

    def pick(c: str) -> Column:
        if c not in patch.columns:
            return F.col(f"s.{c}")
        fresh = F.array_contains(F.col("p.present"), c)
        if locked:
            fresh = fresh & ~F.coalesce(F.array_contains(F.col(f"s.{locked}"), c), F.lit(False))
        return F.when(F.coalesce(fresh, F.lit(False)), F.col(f"p.{c}")).otherwise(F.col(f"s.{c}"))

    keep = [F.col(f"s.{locked}").alias(locked)] if locked else []
    return j.select(F.coalesce("_k", key).alias(key), *(pick(c).alias(c) for c in cols), *keep)


def fill_blank(stored: Column, fresh: Column) -> Column:
    """What is stored, or the fresh value where nothing is."""
    return F.coalesce(present(stored), present(fresh))


def withdraw(stored: DataFrame, produced: DataFrame, key: str, most: int = MOST_WITHDRAWN, share: float = MOST_SHARE) -> DataFrame:
    """Stored keys that are produced no more; none at all where they are too many to be plausible."""
    gone = stored.select(key).join(produced.select(key), key, "left_anti")
    total, n = stored.agg(F.count("*")).scalar(), gone.agg(F.count("*")).scalar()
    return gone.where((n <= most) | (n <= share * total))


def preserve_range(start: Column, end: Column, old_start: Column, old_end: Column, semantics: Column, old_dates: Column, complete: Column) -> Column:
    """struct(start, end, action): an incoming range widened to evidence, clipped to complete evidence, or held at a continuous range."""
    last = F.when(end > start, end).otherwise(start)
    old_last = F.when(old_end > old_start, old_end).otherwise(old_start)
    evidence = F.array_sort(F.array_distinct(F.coalesce(old_dates, F.array().cast("array<date>"))))
    first_seen, last_seen = F.try_element_at(evidence, F.lit(1)), F.try_element_at(evidence, F.lit(-1))
    known = F.coalesce((semantics == "recurring") & (F.size(evidence) > 0), F.lit(False))
    held = F.coalesce((semantics == "continuous") & old_start.isNotNull(), F.lit(False))
    clip = known & F.coalesce(complete, F.lit(False)) & (last > last_seen)
    lo = F.when(known, F.least(start, first_seen)).when(held, F.least(start, old_start)).otherwise(start)
    hi = F.when(clip, last_seen).when(known, F.greatest(last, last_seen)).when(held, F.greatest(last, old_last)).otherwise(last)
    changed = (lo != start) | (hi != last)
    action = F.when(clip, "clipped-to-evidence").when(known & changed, "widened-to-evidence").when(held & changed, "held-existing").otherwise("incoming")
    return F.struct(lo.alias("start"), F.when(hi > lo, hi).alias("end"), action.alias("action"))


def append_history(history: Column, **fields: Column) -> Column:
    return F.concat(F.coalesce(history, F.array()), F.array(F.struct(*(v.alias(k) for k, v in fields.items()))))
