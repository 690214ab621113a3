"""Whole jobs on groups of many rows: what an operator returns and meets grows with the rows, not with their square."""

import random
from datetime import date, datetime

from pyspark.sql import functions as F

from quarry import cases, lineage, queries
from quarry.functions import addresses, clocktext, hours, integrity, titles
from quarry.operators import articles, boundary, duplicates, pairs, series, venues
from quarry.sources import calendar

DAY = date(2024, 1, 1)


def test_identity_of_one_day_meets_no_pairs(spark):
    """2,000 new occurrences and 2,000 unclaimed rows share a day; rows of a day are counted before they are joined."""
    n = 2000
    occ = spark.range(n).select(F.concat(F.lit("u"), "id").alias("uid"), F.lit(DAY).alias("day"), F.lit(DAY).alias("original_day"), F.concat(F.lit("t"), "id").alias("title"))
    lone = spark.createDataFrame([("solo", date(2024, 2, 1), date(2024, 2, 1), "x"), ("moved", date(2024, 3, 1), date(2024, 3, 2), "y"), ("twice", date(2024, 4, 1), date(2024, 4, 2), "z")], occ.schema)
    stored = spark.range(n).select(F.concat(F.lit("ical-z"), "id").alias("external_id"), F.lit(DAY).alias("start_date"), F.lit("approved").alias("status"))
    stored = stored.union(spark.createDataFrame([("ical-a", date(2024, 2, 1), "approved"), ("ical-b", date(2024, 3, 2), "approved"), ("ical-c", date(2024, 4, 1), "approved"), ("ical-d", date(2024, 4, 2), "approved")], stored.schema))
    plan = pairs.identity_plan(occ.union(lone), stored)
    got = {(r["action"], r["adopted"]): r["n"] for r in plan.groupBy("action", "adopted").agg(F.count("*").alias("n")).collect()}
    assert got == {("new", None): n + 1, ("adopt-by-date", "ical-a"): 1, ("adopt-by-date", "ical-b"): 1}
    assert "count(distinct" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()  # rows of a day against its occurrences


def test_a_gap_is_measured_in_full(spark):
    """Half a second over the gap begins a session; the gap itself does not."""
    at = [datetime(2024, 1, 1, 0, 0, 0, 200_000), datetime(2024, 1, 1, 1, 0, 0, 700_000), datetime(2024, 1, 1, 2, 0, 0, 700_000)]
    got = series.sessions(spark.createDataFrame([(1, x) for x in at], "u int, ts timestamp"), "u", "ts", 60)
    assert sorted((r["session"], r["n"]) for r in got.collect()) == [(1, 1), (2, 2)]


def listings(spark, n):
    """n listings of three days, with places stated in one to three ways, known and unknown starts, few sources and titles."""
    k = F.col("id")
    pick = lambda m, *xs: F.get(F.array(*(F.lit(x) for x in xs)), F.pmod(F.xxhash64(k, F.lit(m)), F.lit(len(xs))).cast("int"))
    day = F.date_add(F.lit(DAY), F.pmod(F.xxhash64(k, F.lit(0)), F.lit(3)).cast("int"))
    return spark.range(n).select(
        k, day.alias("start_date"), pick(1, 1, 2, None).alias("venue_id"), pick(2, "Hall", "hall!", "Venue TBA", "Loft").alias("venue"), pick(3, "Troy", "Novi", None).alias("city"), pick(4, "1 Main St", None).alias("address"), pick(5, "7 PM", "19:00", "8 PM", None).alias("time"),
        F.lit(False).alias("all_day"), pick(6, "x", "y", "z").alias("source"), pick(7, "Big Jazz Night", "The Jazz Night", "Jazz", "jazz!").alias("title"), pick(8, "https://a.org/1", "https://a.org/2", "a").alias("event_url"), pick(9, "https://a.org/1", None).alias("ticket_url"),
    )


def expanded(out, copy, by):
    """All pairs of classes' rows: members of a class are known by its first row and `by`."""
    members, linked = {}, []
    for r in out:
        if copy(r):
            members.setdefault((r["a"], by(r)), {r["a"]}).add(r["b"])
        else:
            linked.append(r)
    of = lambda x, r: members.get((x, by(r)), {x})
    return [(min(x, y), max(x, y), r) for r in linked for x in of(r["a"], r) for y in of(r["b"], r)], members


def test_classes_of_places_hold_all_pairs(spark):
    rows = listings(spark, 150).cache()
    out = pairs.same_place_classes(rows).collect()
    two, members = expanded(out, lambda r: r["copy"], lambda r: r["way"])
    got = {}
    kinds = {(r["a"], r["way"]): r["kind"] for r in out if r["copy"]}
    for x, y, kind, way in [(x, y, r["kind"], r["way"]) for x, y, r in two] + [(x, y, kinds[key], key[1]) for key, m in members.items() for x in m for y in m if x < y]:
        assert got.setdefault((x, y), (kind, way))[0] == kind
        got[x, y] = (kind, min(got[x, y][1], way, key=pairs.WAYS.index))
    assert got == {(r["a"], r["b"]): (r["kind"], r["way"]) for r in pairs.same_place(rows).collect()}


def test_classes_of_sources_hold_all_pairs(spark):
    rows = listings(spark, 150).cache()
    two, _ = expanded(pairs.cross_source_classes(rows).collect(), lambda r: r["basis"] == "copy", lambda r: r["way"])
    assert {(x, y, r["basis"], r["overlap"]) for x, y, r in two} == {tuple(r) for r in pairs.cross_source(rows).collect()}


def test_classes_of_links_hold_all_pairs(spark):
    rows = listings(spark, 150).cache()
    _, members = expanded(pairs.shared_link_classes(rows).collect(), lambda r: True, lambda r: r["link"])
    assert {(x, y) for m in members.values() for x in m for y in m if x < y} == {tuple(r) for r in pairs.shared_link_pairs(rows).collect()}


def few_listings(spark, folder):
    """Four equal listings and one of another source; all their pairs."""
    rows = [(k, 12, DAY, "1-URGENT") for k in (1, 13, 25, 37)] + [(49, 12, DAY, "2-HIGH")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0]]


def test_query_of_places_returns_all_pairs(spark, tmp_path):
    every = few_listings(spark, tmp_path)
    assert sorted(tuple(r) for r in queries.QUERIES["same_place_pairs"](spark, str(tmp_path)).collect()) == [(a, b, "same_venue_same_start_review", "venue_id") for a, b in every]


def test_query_of_sources_returns_all_pairs(spark, tmp_path):
    every = few_listings(spark, tmp_path)
    assert sorted(tuple(r)[:3] for r in queries.QUERIES["cross_source_pairs"](spark, str(tmp_path)).collect()) == [(a, b, "same_start_similar_title") for a, b in every if b == 49]


def test_query_of_links_returns_all_pairs(spark, tmp_path):
    every = few_listings(spark, tmp_path)
    assert sorted(tuple(r) for r in queries.QUERIES["shared_link_pairs"](spark, str(tmp_path)).collect()) == every


def test_pairs_of_two_links_count_once(spark):
    """Rows that share both links, in either order, or one of them."""
    rows = spark.createDataFrame([(1, "https://a.org", "https://b.org"), (2, "https://b.org", "https://a.org"), (3, "https://b.org", None), (4, "https://a.org", "https://b.org")], "id long, event_url string, ticket_url string")
    rows = rows.select("*", F.lit(DAY).alias("start_date"), F.lit("7 PM").alias("time"), F.lit(False).alias("all_day"))
    assert sorted(tuple(r) for r in pairs.shared_link_pairs(rows).collect()) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_pairs_are_not_shuffled(spark):
    """Rows are shuffled to meet; what they make is not."""
    rows = listings(spark, 20)
    for out in (pairs.same_place(rows), pairs.cross_source(rows), pairs.shared_link_pairs(rows)):
        above, top = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)
        assert "Aggregate" not in above and "_ba#" in top.split("\n")[0]  # the last join is that of blocks


def test_copies_are_not_paired(spark):
    """3,000 equal listings of one place: as many rows as listings in each of the three ways, and one class of links."""
    q = spark.range(3000).select("id", F.lit(DAY).alias("start_date"), *(F.lit(v).alias(k) for k, v in {"venue_id": 1, "venue": "Hall", "city": "Troy", "address": "1 Main St", "time": "7 PM", "all_day": False, "source": "x", "title": "Jazz", "event_url": "https://a.org", "ticket_url": "https://a.org"}.items()))
    assert [f(q).count() for f in (pairs.same_place_classes, pairs.cross_source_classes, pairs.shared_link_classes)] == [8997, 8997, 2999]


def test_each_step_of_a_text_is_stated_once(spark):
    """A step that later ones name several times is bound: its pattern occurs in the plan as often as texts are read, not once for each use."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 1_000_000)
    plan = lambda x: spark.range(1).select(F.lit("a").alias("t"), F.lit(None).cast("string").alias("u")).select(x.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(venues.cities_differ(F.col("t"), F.col("u"))).count("[^a-z0-9 ]") == 2
    assert plan(F.struct(addresses.street(F.col("t")), addresses.address(F.col("u")))).count("split(") <= 5
    assert plan(integrity.integrity({"title": F.col("t"), "event_url": F.col("u")})).count("a.m.|p.m.") <= 1
    assert plan(cases._map(hours.weekly_hours(F.col("t")))).count("noon|midnight)") == plan(hours.weekly_hours(F.col("t"))).count("noon|midnight)")
    assert plan(titles.title_case(F.col("t"))).count("[^ /]+|[ /]+") == 1


def test_each_part_of_a_rule_is_read_once(spark):
    """Parts of a rule and lines of an event are searched for once, and a rule makes its occurrences alone."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 1_000_000)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    ics = spark.range(1).select(F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), "id", F.lit("\r\nDTSTART:19970611T100000Z\r\nRRULE:FREQ=WEEKLY;INTERVAL=2;COUNT=3\r\nEND:VEVENT")).alias("ics"))
    read = calendar.vevents(ics, "ics")
    assert plan(read).count("(?m)^DTSTART") == 1 and plan(read).count("(?m)^EXDATE") == 1
    rows = read.localCheckpoint()
    days = calendar.expand(rows, F.lit(date(2400, 1, 1)))
    assert plan(days).count("INTERVAL=") <= 2 and "_over" in plan(days)
    assert [r["day"] for r in days.orderBy("day").collect()] == [date(1997, 6, 11), date(1997, 6, 25), date(1997, 7, 9)]


def test_points_of_one_place_are_looked_up_once(spark):
    """4,000 points of two places and an edge list that no cell holds whole: what meets edges are places, and each point has its answer."""
    points = spark.range(4000).select("id", (F.col("id") % 2 * 0.004).alias("lng"), F.lit(0.0).alias("lat")).union(spark.createDataFrame([(-1, None, 0.0)], "id long, lng double, lat double"))
    square = lambda i: [[[0.001 * i + x, 0.003 + y] for x, y in ((0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.0))]]
    polygons = spark.createDataFrame([(f"p{i:02}", square(i)) for i in range(40)], "name string, rings array<array<array<double>>>")
    met = []
    metres = boundary._metres
    boundary._metres = lambda *a: met.append(1) or metres(*a)
    try:
        got = boundary.edge_metres(points, polygons)
    finally:
        boundary._metres = metres
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and {(r["id"] % 2 if r["id"] >= 0 else -1, None if r["metres"] is None else round(r["metres"]), r["name"]) for r in got.collect()} == {(-1, None, None), (0, 334, "p00"), (1, 334, "p03")}
    assert got.count() == 4001


def test_parcels_meet_areas_without_rows_of_points(spark):
    """A parcel of 800 points meets its two areas as two rows."""
    box = lambda a, b, c, d: [[[a, b], [c, b], [c, d], [a, d], [a, b]]]
    areas = spark.createDataFrame([("A", box(0.0, 0.0, 1.0, 1.0)), ("B", box(1.0, 0.0, 2.0, 1.0)), ("C", box(5.0, 5.0, 6.0, 6.0))], "name string, rings array<array<array<double>>>")
    parcels = spark.createDataFrame([(1, box(0.9, 0.4, 1.1, 0.5), "A"), (2, box(0.2, 0.2, 0.3, 0.3), " a "), (3, box(1.2, 0.2, 1.3, 0.3), "A"), (4, box(8.0, 8.0, 8.1, 8.1), "A"), (5, box(-0.1, 0.2, 0.1, 0.3), "A"), (6, [[[0.0, 0.0]]], "A")], "name int, rings array<array<array<double>>>, recorded string")
    assert boundary._areas_near(parcels.where("name = 1"), areas).count() == 2
    assert {(r["name"], r["status"], r["area"]) for r in boundary.parcel_areas(parcels, areas).collect()} == {(1, "crosses_boundary", None), (2, "settled", "A"), (3, "record_and_drawing_disagree", None), (4, "outside", None), (5, "crosses_boundary", None), (6, "no_geometry", None)}


def test_a_range_of_days_is_read_by_one_pattern(spark):
    """Each of the four forms, and texts that are none of them; the month is looked for once a pattern and the text is read once."""
    said = {
        "June 5, 1997 - July 2, 1997": ("1997-06-05", "1997-07-02"), "Dec 30 – Jan 2, 1998": ("1997-12-30", "1998-01-02"), "June 5 - 9 1997": ("1997-06-05", "1997-06-09"), "sept 5, 1997": ("1997-09-05", None), "June 5, 1997 - 9, 1997": (None, None),
        "June 31, 1997 - July 2, 1997": (None, None), "July 2, 1998 - June 5, 1997": (None, None), "June 5 1997-June 6 1997": ("1997-06-05", "1997-06-06"), "June 5": (None, None), "June 5 - July 9": (None, None), "June 5, 97": (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", clocktext.date_range(F.col("t")).alias("x"))
    assert {r["t"]: tuple(None if v is None else str(v) for v in r["x"]) for r in rows.collect()} == said
    assert rows._jdf.queryExecution().analyzed().toString().count("(jan(?:uary)?") <= 12


def test_a_guarded_listing_asks_the_state_once_a_key(spark):
    """1,000 listings of four keys and titles: the state is asked for each key once, and answers are those of a scan."""
    import pandas as pd

    from quarry.streaming import guard

    class State(dict):
        asked = 0

        def containsKey(self, k):
            State.asked += 1
            return k in self

        def getValue(self, k):
            State.asked += 1
            return self[k]

        def updateValue(self, k, v):
            self[k] = v

        def iterator(self):
            return iter(self.items())

    s = guard.SeenBefore(400)
    s.titles, s.venues, s.known = State(), State(), State()
    rows = [(i, f"k{i * 7 % 4}", ("jazz", "jazz night", "", "night")[i % 4], ("hall", "loft", None)[i % 3], ("2024-01-01", "2024-01-02")[i % 5 == 0], i % 5 > 0, i) for i in range(1000)]
    got = list(s.handleInputRows(("2024-01-01",), iter([pd.DataFrame(rows, columns=["id", "key", "title", "venue", "day", "judged", "at"])]), None))[0]
    titles, venues, known, want = {}, {}, {}, []
    for i, k, t, v, day, judged, _ in rows:
        if judged:
            near = {x for (u, _), x in titles.items() if u and t and (u in t or t in u)} | ({venues[v, day]} if v and (v, day) in venues else set())
            want.append((i, "already_exists" if k in known else "possible_duplicate" if near else "created", [known[k]] if k in known else sorted(near)))
            known.setdefault(k, i)
        if t:
            titles.setdefault((t, day), i)
        if v:
            venues.setdefault((v, day), i)
    assert [tuple(r) for r in got.itertuples(index=False)] == want and State.asked <= 8


def test_a_text_of_many_rows_is_read_once(spark):
    """The reading stands on the different texts: 1,000 rows of three texts and of none read four values."""
    rows = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("t"))
    seen = spark.sparkContext.accumulator(0)
    read = F.udf(lambda x: seen.add(1) or f"<{x}>", "string")
    got = lineage.read_once(rows, "t", "x", read).collect()
    assert len(got) == 1000 and all(r["x"] == f"<{r['t']}>" for r in got) and seen.value == 4


def test_few_phrases_go_to_the_words(spark):
    """Words of texts are not shuffled to meet few phrases."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(1, "the grand old hall tonight"), (2, "megrand old"), (3, "grands of old")], "article_id int, hay string")
        got = articles.phrases_in(texts, spark.createDataFrame([("grand old",), ("grand old hall",), ("tonight",)], "phrase string"))
        assert {tuple(r) for r in got.collect()} == {(1, "grand old"), (1, "grand old hall"), (1, "tonight"), (2, "grand old")}
        assert "BroadcastHashJoin [key" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_contained_sets_over_blocks(spark, monkeypatch):
    """Small blocks, few counters, many copies and near copies, null buckets: all links of different sets, and each copy once, with its class."""
    for name, n in (("HELD", 40), ("ASKED", 70), ("COUNTERS", 16), ("STEP", 50)):
        monkeypatch.setattr(duplicates, name, n)
    rng = random.Random(3)
    rows = []
    for i in range(150):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(15, 90))]
        rows.append((i, rng.choice(["a", "b"]), " ".join(base)))
        if i % 3 == 0:
            rows.append((1000 + i, rows[-1][1], " ".join(base[:-2]) + " more"))
    rows += [(2000 + i, "a", "copy " + " ".join(f"w{k}" for k in range(30))) for i in range(120)] + [(3000, None, rows[0][2]), (3001, None, rows[0][2]), (3002, "a", None)]
    sets = {(b, frozenset(t.split())): [] for i, b, t in rows if b and t and len(set(t.split())) >= 20}
    for i, b, t in rows:
        if (b, frozenset((t or "").split())) in sets:
            sets[b, frozenset(t.split())].append(i)
    want = {(min(m), x, len(w), True) for (_, w), m in sets.items() for x in m if x != min(m)}
    for (b, v), m in sets.items():
        want |= {(min(m), min(n), len(v & w), False) for (c, w), n in sets.items() if b == c and min(m) < min(n) and len(v & w) >= max(20, 0.85 * min(len(v), len(w)))}
    docs = spark.createDataFrame(rows, "doc int, b string, text string").repartition(5)
    out = duplicates.contained_pairs(docs, ["b"], "doc", "text")
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and len(want) > 200


def test_containment_query_returns_all_pairs(spark, tmp_path, monkeypatch):
    """Two classes of copies, one contained in the other, a document contained in both, and one of another source: every pair, each once, over small lists."""
    monkeypatch.setattr(duplicates, "CHUNK", 2)
    small, large = (" ".join(f"w{k}" for k in range(n)) for n in (30, 34))
    texts = {5: small, 2: small, 9: small, 4: large, 7: large, 1: large, 8: large, 3: " ".join(f"w{k}" for k in range(29)) + " x", 6: " ".join(f"v{k}" for k in range(30))}
    rows = [(i, "en", "s", t) for i, t in texts.items()] + [(10, "en", "other", small), (11, None, "s", small)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: set(t.split()) for i, t in texts.items()}
    want = [(a, b, len(words[a] & words[b])) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.85 * min(len(words[a]), len(words[b]))]
    assert sorted(tuple(r) for r in queries.QUERIES["containment_pairs"](spark, str(tmp_path)).collect()) == sorted(want) and len(want) == 28


def test_orders_of_cases_are_dealt_over_tasks(spark):
    """The orders of a small file are one task when read; the codes are worked out in as many as shuffles have, in compiled steps."""
    out = queries.QUERIES["integrity_verdict"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "date.malformed_start" in x]
    assert len(lines) == 1 and "lambda" not in lines[0].split("date.malformed_start")[0]


def test_steps_find_what_the_column_finds(spark):
    """Codes of rows with blanks of all kinds around their texts, by steps and by one column."""
    rows = [(" Jazz\u000b", " 1997-06-20\t", " ", " Troy, MI 48084 ", "Troy", "Novi", " /e/1 ", "jazz "), ("  ", None, "1997-06-31 ", "", "Venue TBA", "Troy", "", ""), (None,) * 8, ("Circuit #15", "1997-06-20", "1998-07-20", "Troy", "Troy ", None, "https://a.org", "Kart monthly")]
    names = ("title", "start_date", "end_date", "raw_city", "raw_name", "venue_city", "event_url", "description")
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    fields = {n: F.col(n) for n in names}
    got = integrity.with_integrity(df, fields, "v").select("v", integrity.integrity(fields).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in got) and [len(r["v"]["codes"]) for r in got] == [7, 8, 7, 6]
