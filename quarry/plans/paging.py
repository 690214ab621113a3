"""Orders, pages and summaries as clients ask for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_by(text: str, columns: list[str]) -> list[Column]:
    """Columns of 'a.desc,b.asc.nullslast,c': ascending, nulls last when ascending and first when descending, unless it says otherwise."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, *how = part.split(".")
        if name not in columns or set(how) - {"asc", "desc", "nullsfirst", "nullslast"}:
            raise ValueError(f"no such order: {part}")
        down = "desc" in how
        first = "nullsfirst" in how or (down and "nullslast" not in how)
        c = F.col(name)
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def page(df: DataFrame, order: str, unique: str, offset: int = 0, limit: int = 1000, cap: int = 1000) -> DataFrame:
    """Rows of one page, at most `cap`. An order that does not end in the unique column is refused: its pages could repeat or lose rows."""
    if order.split(",")[-1].split(".")[0].strip() != unique:
        raise ValueError(f"an order of pages ends in {unique}")
    return df.orderBy(*order_by(order, df.columns)).offset(offset).limit(min(limit, cap))


def found(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in which some column holds the text, in any case."""
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower())) for c in columns]))


def total_and_by(df: DataFrame, by: str, **measures: Column) -> DataFrame:
    """The measures over all rows and for each value, in one pass; total marks the first."""
    return df.groupingSets([[], [by]], by).agg(*(m.alias(k) for k, m in measures.items()), (F.grouping(by) == 1).alias("total"))


def classes(findings: DataFrame, most: int = 5) -> DataFrame:
    """(code, n, by_source, samples, place) of findings(id, code, source, rank): the gravest first, then the most frequent.

    Sources are counted before they are listed, samples are the smallest ids, taken in slices of a code first.
    """
    n = findings.groupBy("code").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    by = findings.groupBy("code", "source").agg(F.count("*").alias("k")).groupBy("code").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "source"))).alias("s"))
    by = by.select("code", F.array_join(F.transform("s", lambda x: F.concat(x["source"], F.lit("="), (-x["k"]).cast("string"))), ",").alias("by_source"))
    w = lambda *keys: Window.partitionBy(*keys).orderBy("id")
    few = findings.select("code", "id").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_n", F.row_number().over(w("code", "_s"))).where(F.col("_n") <= most)
    few = few.withColumn("_n", F.row_number().over(w("code"))).where(F.col("_n") <= most).groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("samples"))
    place = F.row_number().over(Window.orderBy(F.desc("rank"), F.desc("n"), "code"))  # one row a code
    return n.join(by, "code").join(few, "code").select("code", "n", "by_source", "samples", place.alias("place"))


def pinned_first(names: DataFrame, name: str, pinned: str) -> DataFrame:
    """A short directory in order of name, the pinned one first, with places."""
    return names.select(name, F.row_number().over(Window.orderBy(F.col(name) != pinned, name)).alias("place"))
