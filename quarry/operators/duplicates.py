"""Duplicate listings: survivors by authority, and a consolidation plan that never lets one listing absorb two performances."""

from __future__ import annotations

from collections import namedtuple
from datetime import timedelta
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import squish, tokens
from ..lineage import cut


def start_time(time: Column) -> Column:
    """'h:mm am' of the first full time in a text, or null."""
    t = F.lower(F.regexp_extract(F.coalesce(time, F.lit("")), r"(?i)\d{1,2}:\d{2}\s*[ap]m", 0))
    return F.when(t != "", F.concat_ws(" ", F.concat_ws(":", F.regexp_extract(t, r"^(\d+)", 1).try_cast("int").cast("string"), F.regexp_extract(t, r":(\d{2})", 1)), F.regexp_extract(t, "([ap]m)$", 1)))


def completeness(weights: dict[str, int]) -> Column:
    """Sum of the weights of the columns that say something."""
    return sum((F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", w).otherwise(0) for c, w in weights.items()), F.lit(0))


def survivors(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows with their group's size and rank; rank 1 survives."""
    w = Window.partitionBy(*key)
    return df.withColumn("group_size", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(*order)))


def _same_run(a, b) -> bool:
    """The last days agree; an end on the day after the start is the same night."""
    start, x, y = a.start_date, a.end_date or a.start_date, b.end_date or b.start_date
    night = start + timedelta(days=1)
    return x == y or (x == start and y == night) or (y == start and x == night)


def _judge(a, b) -> tuple[str, str] | None:
    """(kind, rule) of two listings of one title, day and place, or None where they are two performances."""
    same = a.source == b.source
    if same:
        stated = a.clock == b.clock if a.clock and b.clock else bool(a.all_day and b.all_day and a.said == b.said)
        if not stated:
            return ("review", "same_source_time_unknown") if a.clock == b.clock else None
    elif a.clock and b.clock and a.clock != b.clock:
        return "review", "two_sources_same_place_time_conflict"
    if not _same_run(a, b):
        return "review", "end_dates_differ"
    return "merge", "same_source_twice" if same else "two_sources_one_place"


def _decide(group: list):
    """Each decision on a group's rows, which come in order of authority."""
    gone = set()
    for i, a in enumerate(group):
        if i in gone:
            continue
        times = {a.clock} - {None}  # what the row and those merged into it state
        for j in range(i + 1, len(group)):
            b = group[j]
            if j in gone or not (found := _judge(a, b)):
                continue
            kind, rule = found
            if kind == "merge" and b.clock and times and b.clock not in times:
                kind, rule = "review", "one_listing_two_performances"
            if kind == "merge":
                times |= {b.clock} - {None}
                gone.add(j)
            yield a.id, b.id, kind, rule


def decisions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(survivor, loser, kind, rule) of rows(id, title_key, start_date, place, source, clock and, where known, end_date, all_day, description).

    Kind is merge, or review where a person decides: end dates that differ, one source twice without stated times, two sources with two
    times, a listing without a time that has taken one performance. In order of authority each row that stays is compared with all later
    rows of its title, day and place, and takes those that merge; a row is merged once. Two rows of one source state the same time by
    equal clocks, or both are all-day and say the same. A group is one task's scan, with as many reviews as it has undecided pairs.
    """
    keys = ["title_key", "start_date", "place"]
    known = rows.where("title_key <> '' and start_date is not null and place is not null")
    for name, kind in (("end_date", "date"), ("all_day", "boolean"), ("description", "string")):
        known = known if name in rows.columns else known.withColumn(name, F.lit(None).cast(kind))
    said = F.lower(squish(F.regexp_replace(F.coalesce(F.col("description"), F.lit("")), r"(?i)https?://\S+", " ")))
    w = Window.partitionBy(*keys)
    ranked = (
        known.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_size", F.count("*").over(w)).where("_size > 1")
        .select("id", *keys, "source", F.nullif("clock", F.lit("")).alias("clock"), F.col("end_date").cast("date").alias("end_date"), F.coalesce("all_day", F.lit(False)).alias("all_day"), said.alias("said"), F.col("_n").alias("n"))
        .sortWithinPartitions(*keys, "n")
    )
    names = ranked.columns

    kind = dict(rows.dtypes)["id"]
    schema = f"survivor {kind}, loser {kind}, kind string, rule string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def scan(batches):
        """A group lies in one partition (the window's), in order, and may go on in the next batch."""
        row = namedtuple("row", names)
        listed = (row._make(r) for b in batches for r in zip(*(b.column(n).to_pylist() for n in names), strict=True))
        found = (d for _, group in groupby(listed, lambda r: (r.title_key, r.start_date, r.place)) for d in _decide(list(group)))
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return ranked.mapInArrow(scan, schema)


def plan(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(survivor, loser, rule): the merges among the decisions."""
    return decisions(rows, order).where("kind = 'merge'").drop("kind")


#: Counters that words are hashed into to order them by how rare they are; documents of a bucket whose words one task holds, and that it is asked about.
COUNTERS, HELD, ASKED = 1 << 20, 1 << 14, 1 << 17
#: Meetings that are counted at once (a row's own at least).
STEP = 1 << 21
#: Ids that are sent to every task to pick out the sets that are compared.
SENT = 1 << 20


def _rarest_first(sets: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (columns, h) with each set's hashed words from the rarest to the most frequent; the same order in all rows."""
    at = F.pmod(F.col("w"), F.lit(COUNTERS))
    counts = np.zeros(COUNTERS, np.int64)
    rows = sets.select(F.explode("h").alias("w")).groupBy(at.alias("at")).agg(F.count("*").alias("n")).toArrow()  # COUNTERS rows at most
    counts[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def order(batches):
        for b in batches:
            h = b.column(len(columns))
            size, w = pc.list_value_length(h).to_numpy(), h.flatten().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            w = w[np.lexsort((w, shared.value[w % COUNTERS], owner))]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(w))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], lists], names=[*columns, "h"])

    return sets.select(*columns, "h").mapInArrow(order, sets.select(*columns, "h").schema)


def _met(asked: pa.Table, held: pa.Table) -> pa.Table:
    """(x, y): each asked row and those held that are no smaller and have `hits` of its words at least."""
    y, sy = held.column("id").to_numpy(), held.column("size").to_numpy()
    hy = held.column("h").combine_chunks()
    words, owner = hy.flatten().to_numpy(), np.repeat(np.arange(len(y)), pc.list_value_length(hy).to_numpy())
    o = np.argsort(words, kind="stable")
    words, owner = words[o], owner[o]
    x, sx, hits = (asked.column(c).to_numpy() for c in ("id", "size", "hits"))
    hx = asked.column("h").combine_chunks()
    n = pc.list_value_length(hx).to_numpy()
    w = hx.flatten().to_numpy()
    lo, hi = np.searchsorted(words, w, "left"), np.searchsorted(words, w, "right")
    ends = np.r_[0, np.cumsum(n)]
    work = np.r_[0, np.cumsum(hi - lo)][ends]  # meetings before each row
    found, i = [], 0
    while i < len(x):
        j = min(max(i + 1, int(np.searchsorted(work, work[i] + STEP, "right")) - 1), len(x))
        a, m = lo[ends[i] : ends[j]], (hi - lo)[ends[i] : ends[j]]
        at = owner[np.arange(m.sum()) + np.repeat(a - np.r_[0, np.cumsum(m)[:-1]], m)]
        row = np.repeat(np.repeat(np.arange(i, j), n[i:j]), m)
        pair, times = np.unique(row * len(y) + at, return_counts=True)
        p, q = pair // max(len(y), 1), pair % max(len(y), 1)
        keep = (times >= hits[p]) & ((sx[p] < sy[q]) | ((sx[p] == sy[q]) & (x[p] < y[q])))
        found.append((x[p[keep]], y[q[keep]]))
        i = j
    both = [np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1)]
    return pa.table({"x": pa.array(both[0], pa.int64()), "y": pa.array(both[1], pa.int64())})


def contained_pairs(docs: DataFrame, by: list[str], id_: str, text: str, least: int = 20, share: float = 0.85) -> DataFrame:
    """(a, b, shared, copy): documents of one bucket whose smaller word set is nearly contained in the other's.

    Documents of a bucket with equal sets are a class, its first one stands for it. With copy, b is another document of a's class; else each
    of a's class is linked with each of b's. Ids are whole numbers; a null bucket has no links.

    Of a set that has `share` of its words in a larger one at most (1 - share) * size are not there, so of its rarest words all but so
    many are. Only these are sent, to tasks that each hold the hashed words of a block of a bucket's sets; those that meet often enough are
    compared on the words themselves. Any order of words gives all links; that of hashed counters makes meetings few. Blocks of a bucket
    meet in pairs, which is quadratic in a bucket of many blocks, in what is sent as in the work; memory is bounded by the blocks.
    """
    d = docs.select(*by, F.col(id_).cast("long").alias("id"), F.col(text).alias("_text")).where(" and ".join(f"`{c}` is not null" for c in by))
    t = d.select(*by, "id", tokens(F.col("_text")).alias("t")).where(F.size("t") >= least)
    sets = cut(t.select(*by, "id", F.size("t").alias("size"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("set"), F.transform("t", lambda w: F.hash(w)).alias("h")))
    classes = sets.groupBy(*by, "set").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = sets.select(*by, "set", "id", "size").join(classes.where("n > 1"), [*by, "set"]).where("id <> rep")
    one = copies.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.col("size").cast("long").alias("shared"), F.lit(True).alias("copy"))
    first = sets.join(copies.select(*by, "id"), [*by, "id"], "left_anti")
    ranked = _rarest_first(first, [*by, "id", "size"])
    blocks = first.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.ceil(F.col("_n") / HELD).cast("int").alias("_held"), F.ceil(F.col("_n") / ASKED).cast("int").alias("_asked"))
    ranked = ranked.join(blocks, by)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    need = F.greatest(F.lit(least), F.ceil(share * F.col("size") - 1e-9).cast("int"))
    sent = F.least(F.col("size"), F.col("size") - need + 2 + (F.col("size") / 16).cast("int"))
    new = [F.col(c).alias(c) for c in (*by, "id", "size")]  # else the two sides of the cogroup can't be told apart
    asked = ranked.select(*new, every("_held").alias("_y"), own("_asked").alias("_x"), (sent - (F.col("size") - need)).alias("hits"), F.slice("h", F.lit(1), sent).alias("h"))
    held = ranked.select(*by, own("_held").alias("_y"), every("_asked").alias("_x"), "id", "size", "h")
    keys = [*by, "_y", "_x"]
    met = cut(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_met, "x long, y long"))
    ids = met.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    words = d.join(F.broadcast(ids) if met.count() <= SENT else ids, "id", "left_semi").select("id", tokens(F.col("_text")).alias("t"))
    a, b = (words.select(F.col("id").alias(n), F.col("t").alias(f"t{n}")) for n in "xy")
    shared = F.size(F.array_intersect("tx", "ty"))
    full = met.join(a, "x").join(b, "y").select("x", "y", shared.alias("shared"), F.least(F.size("tx"), F.size("ty")).alias("small")).where((F.col("shared") >= least) & (F.col("shared") >= share * F.col("small")))
    return one.unionByName(full.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("shared").cast("long").alias("shared"), F.lit(False).alias("copy")))


#: Documents of a class that travel in one row, to be paired with as many others.
CHUNK = 500


def all_contained_pairs(docs: DataFrame, by: list[str], id_: str, text: str, least: int = 20, share: float = 0.85) -> DataFrame:
    """(a, b, shared) with a < b: contained_pairs() expanded into all pairs of documents, which is quadratic in a class.

    Links stay those of classes until the end; a class travels as lists of CHUNK ids, and each two lists that meet are a row of their own,
    dealt over all tasks, so no task has a whole large class.
    """
    links = contained_pairs(docs, by, id_, text, least, share)
    copies = links.where("copy")
    classes = copies.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n"), F.min("shared").alias("shared"))  # a class has one size
    members = copies.select(F.col("a").alias("rep"), F.col("b").alias("id")).unionByName(classes.select("rep", F.col("rep").alias("id")))
    lists = members.join(classes.select("rep", F.ceil((F.col("n") + 1) / CHUNK).alias("n")), "rep").groupBy("rep", F.pmod(F.xxhash64("id"), "n").alias("c")).agg(F.collect_list("id").alias("ids"))
    pairs = links.where("not copy").select("a", "b", "shared").unionByName(classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "shared"))
    for x in ("a", "b"):
        ids = F.coalesce(f"{x}s", F.array(x))  # a class of one document has no list
        pairs = pairs.join(lists.select(F.col("rep").alias(x), F.col("ids").alias(f"{x}s")), x, "left").withColumn(f"{x}s", ids)
    pairs = pairs.repartition(F.get("as", F.lit(0)), F.get("bs", F.lit(0))).select("a", "b", "shared", F.explode("as").alias("x"), "bs").select("a", "b", "shared", "x", F.explode("bs").alias("y"))
    return pairs.where("a <> b or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")
