"""Guarded listings over restarts, observed batches that are repeated, families of sources and one-pass reports."""

import random
import re
import tempfile
from datetime import date, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quarry.operators import families, report
from quarry.streaming import batches, guard

LISTING = "id long, key string, title string, venue string, day date, at long"


def plain_guard(rows):
    """Every listing against all before it."""
    words = lambda x: re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()
    out, seen = {}, []
    for r in sorted((r for r in rows if r[4]), key=lambda r: (r[5], r[0])):
        i, key, title, venue, day, _ = r
        first = {}
        for s in seen:
            for kind, text in (("t", words(s[2])), ("v", words(s[3]))):
                first.setdefault((kind, text, s[4]), s[0])
        same = [s[0] for s in seen if s[1] == key and s[4] == day]
        near = {j for (kind, text, d), j in first.items() if text and ((kind == "t" and d in (day, day + timedelta(1)) and words(title) and (text in words(title) or words(title) in text)) or (kind == "v" and d == day and text == words(venue)))}
        out[i] = ("already_exists", [same[0]]) if same else ("possible_duplicate", sorted(near)) if near else ("created", [])
        seen.append(r)
    return out


def test_guard_over_restarts(spark):
    """A stream in three parts, each after a restart from its checkpoint, decides as all rows at once would."""
    was = {k: spark.conf.get(k) for k in guard.SETTINGS}
    for k, v in guard.SETTINGS.items():
        spark.conf.set(k, v)
    rng, rows = random.Random(2), []
    for i in range(60):
        day = date(2026, 6, 1) + timedelta(rng.randrange(4))
        rows.append((i, f"k{rng.randrange(50)}", rng.choice(["Jazz", "Jazz Night", "Rock", "Folk evening", "Folk", None, "", "Talk " + str(i)]), rng.choice([None, "Hall A", "hall-a", "B", "C" + str(i)]), day if i % 13 else None, i // 2))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    try:
        for part in range(3):
            spark.createDataFrame(rows[part * 20 : part * 20 + 20], LISTING).write.mode("append").parquet(f"{folder}/in")
            q = guard.guarded(spark.readStream.schema(LISTING).parquet(f"{folder}/in")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
        got = {r["id"]: (r["outcome"], r["matches"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == plain_guard(rows) and {v[0] for v in got.values()} == {"created", "possible_duplicate", "already_exists"}


def test_repeated_epochs_change_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(i, "a" if i % 2 else "b", None if i % 5 == 0 else "x") for i in range(40)]
    parts = [spark.createDataFrame(rows[k : k + 20], "id long, source string, title string") for k in (0, 20)]
    sink = batches.observed(batches.merge_into(f"{folder}/table", "id", now=lambda: "2026-06-01 00:00:00"), f"{folder}/quality", {"no_title": F.col("title").isNull()}, by="source")
    for epoch in (0, 1, 1, 0, 1):
        sink(parts[epoch], epoch)
    got = {r["source"]: (r["rows"], r["no_title"]) for r in batches.observations(spark, f"{folder}/quality", "source").collect()}
    assert got == {s: (sum(r[1] == s for r in rows), sum(r[1] == s and r[2] is None for r in rows)) for s in ("a", "b")}
    with pytest.raises(ZeroDivisionError):
        batches.observed(lambda batch, epoch: 1 / 0, f"{folder}/other", {})(parts[0], 0)


def test_updated_at(spark):
    before = spark.createDataFrame([(1, "a", "2026-01-01 00:00:00"), (2, None, "2026-01-01 00:00:00")], "id int, v string, t string").select("id", "v", F.col("t").cast("timestamp").alias("updated_at"))
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = {r["id"]: str(r["updated_at"])[:10] for r in batches.touched(new, before, "id", ["v"], "2026-06-01 00:00:00").collect()}
    assert got == {1: "2026-01-01", 2: "2026-06-01", 3: "2026-06-01"}


def test_families_of_sources(spark):
    """Who says a text first is not a copier; chains and rings of copies are one family; nulls say nothing."""
    told = [("wire", f"t{i}", 1) for i in range(10)] + [("paper", f"t{i}", 2) for i in range(8)] + [("blog", f"t{i}", 3) for i in range(3, 7)] + [("own", f"o{i}", 1) for i in range(9)] + [("own", "t1", 5)]
    told += [("x", f"x{i}", 1 + i % 2) for i in range(6)] + [("y", f"x{i}", 2 - i % 2) for i in range(6)] + [("tie", "o1", 1), (None, "t1", 9), ("quiet", None, 1)]
    df = spark.createDataFrame(told, "source string, text string, at int")
    pairs = {(r["source"], r["original"]): (r["n"], r["said"]) for r in families.copies(df, 2, 0.5).collect()}
    assert pairs == {("paper", "wire"): (8, 8), ("blog", "wire"): (4, 4), ("x", "y"): (3, 6), ("y", "x"): (3, 6)}
    out = {r["source"]: (r["family"], r["copies"]) for r in families.independent(df).select("source", "family", "copies").distinct().collect()}
    assert out == {"wire": ("blog", False), "paper": ("blog", True), "blog": ("blog", True), "own": ("own", False), "x": ("x", True), "y": ("x", True), "tie": ("tie", False), "quiet": ("quiet", False), None: (None, False)}


def test_report_from_one_scan(spark):
    rows = spark.createDataFrame([(1, "approved", "a", 5, [("m", 4)]), (2, "approved", "b", 5, []), (3, "pending", "a", 1, [("m", 4)]), (4, "approved", None, 5, None), (5, "approved", "a", 1, [("m", 4), ("m", 4)])], "id int, status string, source string, seen_at int, codes array<struct<code:string,rank:int>>")
    seen = Observation("totals")
    out = report.inventory(rows, spark.createDataFrame([("a", 3)], "source string, cutoff int"), seen)
    got = {(r["section"], r["key"]): r["n"] for r in out.collect()}
    assert got[("status", "approved")] == 4 and got[("state", "blocked")] == 2 and got[("state", "cleared")] == 2 and got[("currency", "stale")] == 1 and got[("currency", "unknown")] == 2
    assert got[("code", "m")] == 2 and got[("code", "currency.not_reseen")] == 1 and got[("source", "unattributed")] == 1 and got[("code_source", "m|a")] == 2 and ("code", None) not in got
    assert seen.get == {"rows": 5, "approved": 4, "unattributed": 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2
    found = spark.createDataFrame([("k1", "c1", [1, 2]), ("k2", "c1", [2, 2]), ("k3", "c2", [2])], "key string, code string, ids array<int>")
    assert {r["id"]: [(x["code"], x["keys"]) for x in r["codes"]] for r in report.findings_by_row(found).collect()} == {1: [("c1", ["k1"])], 2: [("c1", ["k1", "k2"]), ("c2", ["k3"])]}
