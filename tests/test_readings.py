"""Line machines, nested elements, cues, boundaries, snapshots and chains of merges against plain versions."""

import math
import random
import re
from datetime import date

from pyspark.sql import functions as F

from quarry.functions import cues
from quarry.operators import boundary, elements, repair, snapshots
from quarry.sources import lines as L


def page(spark, *ls):
    return spark.createDataFrame([(1, list(ls))], "page int, ls array<string>")


def test_listing_of_dates(spark):
    """Years and days as headings, noise, brackets and places that go on, presenters in front."""
    ls = [
        "Home", "Before any day", "2027", "January 5", "First Band", "(A, B, C)", "Second Act", "at Public Library", "closed for a private event", "x", "Some Series presents", "Another Series presents", "Third Act", "in Town",
        "February 7, 2028", "Festival present", "March 1", "Alone", "info@example.com", "2029", "No day yet", "April 3", "(Bracket first)",
    ]
    want = [
        ("2027-01-05", "First Band (A, B, C)"), ("2027-01-05", "Second Act at Public Library"), ("2027-01-05", "Another Series presents Third Act in Town"), ("2027-03-01", "Alone"), ("2029-04-03", "(Bracket first)"),
    ]
    got = L.dated_listing(page(spark, *ls), ["page"], F.col("ls"), 2026).orderBy("record").collect()
    assert [(str(r["date"]), r["title"]) for r in got] == want
    assert [str(r["date"]) for r in L.dated_listing(page(spark, "May 4", "Show"), ["page"], F.col("ls"), 2026).collect()] == ["2026-05-04"]


def test_titles_with_days_below(spark):
    ls = ["Some Film", "Tickets: $5", "Fri Sept 18 - Sun Sept 20, 2026", "Matinee", "Oct. 3 & Oct. 4, 2026 at 2pm and 8pm", "Repeated", "Nov 1, Nov 2, 2026 7:30 PM", "Dec 5", "Year-end", "Jan 2 noon"]
    got = L.titled_dates(page(spark, *ls), ["page"], F.col("ls"), F.lit("2026-12-20").cast("date")).collect()
    assert sorted((r["title"], str(r["date"]), r["end_date"] and str(r["end_date"]), r["time"]) for r in got) == sorted([
        ("Some Film", "2026-09-18", "2026-09-20", None), ("Matinee", "2026-10-03", None, "2pm"), ("Matinee", "2026-10-04", None, "8pm"), ("Repeated", "2026-11-01", None, "7:30 PM"), ("Repeated", "2026-11-02", None, "7:30 PM"), ("Year-end", "2027-01-02", None, "noon"),
    ])


def test_states_do_not_depend_on_blocks(spark):
    rng = random.Random(4)
    rows = [(p, [rng.choice(["2027", "May 4", "May 5, 2029", "Act", "(x y)", "at Home", "Q presents", "no", "e@x", ""]) for _ in range(rng.randrange(0, 90))]) for p in range(25)]
    df = spark.createDataFrame(rows, "page int, ls array<string>")
    read = lambda b: sorted(tuple(r) for r in L.states(df, ["page"], F.col("ls"), L.DATED_LISTING, block=b).collect())
    m = L.DATED_LISTING
    want = []
    for p, ls in rows:
        state = m.states[0]
        for n, line in enumerate(ls):
            kind = next((k for k, pattern in m.classes if re.search(pattern.replace("(?i)", ""), line, re.I if "(?i)" in pattern else 0)), "other")
            to, what = m.moves.get((state, kind), (state, None))
            want.append((p, n, line, kind, state, what))
            state = to
    key = lambda r: (r[0], r[1])
    assert sorted(read(1), key=key) == sorted(read(7), key=key) == sorted(read(64), key=key) == sorted(want, key=key)


def test_lines_around_and_sections(spark):
    df = page(spark, "A", "B", "May 4", "C", "D", "May 5")
    got = {r["n"]: (r["before"], r["after"]) for r in L.around(df, ["page"], F.col("ls"), "^May").collect()}
    assert got == {2: (["B", "A"], ["C"]), 5: (["D", "C"], [])}
    df = page(spark, "x", "Bands", "one", "two", "Date", "Bands", "three", "Home")
    assert {r["label"]: r["lines"] for r in L.sections(df, ["page"], F.col("ls"), ["Bands", "Date", "Home"]).collect()} == {"Bands": ["one", "two"], "Date": [], "Home": []}


def test_innermost_containers_of_random_pages(spark):
    """Nested, unclosed and wrongly closed elements against a stack for each name."""
    rng = random.Random(7)
    pages = [(p, "".join(rng.choice(["<div>", "<div class='c'>", "</div>", "<ul>", "</ul>", "<p>", "</p>", "text ", "<a href='u'>", "</a>", "<br>", "<script>if(a<div)</script>", "<!-- <p> -->"]) for _ in range(rng.randrange(0, 60)))) for p in range(60)]
    df = spark.createDataFrame([*pages, (99, None)], "page int, html string")
    tags = elements.tokens(df, "page", "html")
    got = {(r["page"], r["tag"], r["pre"], r["post"]) for r in elements.elements(tags, "page", ("div", "ul", "p")).collect()}
    want, inner = set(), set()
    for p, html in pages:
        parts = re.findall(r"<[^>]*>|[^<]+", re.sub(r"(?s)<script\b.*?</script>|<!--.*?-->", "", html))
        spans = []
        for name in ("div", "ul", "p"):
            open_: list = []
            for i, x in enumerate(parts):
                start, end = re.match(rf"<{name}\b", x), x == f"</{name}>"
                if name == "p" and (start or end) and open_:
                    spans.append((name, open_.pop(), i))
                    end = None
                if start:
                    open_.append(i)
                elif end and open_:
                    spans.append((name, open_.pop(), i))
            spans += [(name, i, 2**31 - 1) for i in open_]
        want |= {(p, *s) for s in spans}
        divs = [s for s in spans if s[0] == "div"]
        inner |= {(p, i, max(a for _, a, b in divs if a < i < b)) for i, x in enumerate(parts) if x.startswith("<a") and any(a < i < b for _, a, b in divs)}
    assert got == want
    links = tags.where("tag = 'a' and kind = 1").select("page", "pos")
    # unclosed containers may cross closed ones; all others are nested
    nested = {(p, i, c) for p, i, c in inner if all(b < 2**31 - 1 for q, n, a, b in want if q == p and n == "div")}
    got = {(r["page"], r["pos"], r["container"]) for r in elements.innermost(links, elements.elements(tags, "page", ("div",)), "page", "pos").collect()}
    assert nested <= got and nested
    html = '<head><meta property="og:image" content="m.png"></head><article><img src="a.png"></article><img src="b.png"><img>'
    got = elements.page_images(spark.createDataFrame([(1, html)], "page int, html string"), "page", "html").collect()
    assert {(r["src"], r["place"]) for r in got} == {("m.png", "meta"), ("a.png", "main"), ("b.png", "other")}


def test_nearest_cues(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["cue ", "Cue", "12", "7", " x ", "é" * 9, "\n", "\U0001f600"]) for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "12", "cue"]
    for within, required in ((6, True), (40, False)):
        got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cues.mentions_with_cue(F.col("t"), "[0-9]+", "[cC]ue", within, required).alias("m")).collect()
        for r in got:
            text, want = texts[r["i"]] or "", []
            marks = [(m.start(), m.end(), m.group()) for m in re.finditer("[cC]ue", text)]
            for m in re.finditer("[0-9]+", text):
                near = max((x for x in marks if x[1] <= m.start()), default=None)
                ok = near and m.start() - near[1] <= within
                if ok or not required:
                    want.append((m.start(), m.group(), near[2] if ok else None, m.start() - near[1] if ok else None))
            assert [tuple(x) for x in r["m"]] == want
    text = "Published January 3. The show opens on Feb. 14 and closes March 2, 2027; tickets go on sale Feb. 1."
    got = spark.createDataFrame([(text,)], "t string").select(cues.dates_by_cue(F.col("t"), F.lit("2026-12-20").cast("date"), "opens|closes", "sale|Published", 20).alias("d")).first()["d"]
    assert got == [date(2027, 2, 14), date(2027, 3, 2)]
    got = spark.createDataFrame([("$5 at 7 PM, doors 6 PM, $5", ["starts 7 pm"])], "a string, b array<string>").select(cues.facts_only_in(F.col("a"), F.col("b"), r"\$\d+|\d+ PM").alias("f")).first()["f"]
    assert got == ["$5", "6 PM"]


def test_distance_to_edges(spark):
    """Random polygons and points near and far, against every edge; long edges, holes, nulls, no polygons."""
    rng = random.Random(5)
    shapes = []
    for i in range(12):
        x, y, r = rng.uniform(-84, -82), rng.uniform(41.5, 43), rng.choice([0.001, 0.05, 0.7])
        ring = [[x + r * math.cos(a), y + r * math.sin(a)] for a in sorted(rng.uniform(0, 6.28) for _ in range(5))]
        shapes.append((f"n{i:02}", [ring + ring[:1]] + ([[[x, y], [x, y], [x + r / 9, y], [x, y]]] if i % 3 == 0 else [])))
    points = [(i, rng.uniform(-86, -80), rng.uniform(40, 45)) for i in range(60)] + [(100, None, 42.0), (101, 100.0, -30.0)]
    polygons = spark.createDataFrame(shapes, "name string, rings array<array<array<double>>>")
    df = spark.createDataFrame(points, "id int, lng double, lat double")
    got = {r["id"]: (r["metres"], r["name"]) for r in boundary.edge_metres(df, polygons, cell=0.02).collect()}
    assert len(got) == len(points) and got[100] == (None, None)
    for i, lng, lat in points:
        if lng is None:
            continue
        kx, ky, best = 111320 * math.cos(math.radians(lat)), 111320, (math.inf, "")
        for name, rings in shapes:
            for ring in rings:
                for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                    ax, ay, bx, by = (ax - lng) * kx, (ay - lat) * ky, (bx - lng) * kx, (by - lat) * ky
                    dx, dy = bx - ax, by - ay
                    k = 0 if dx * dx + dy * dy == 0 else max(0, min(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
                    best = min(best, (math.hypot(ax + k * dx, ay + k * dy), name))
        assert abs(got[i][0] - best[0]) < 1e-6 * max(1, best[0]) and got[i][1] == best[1]
    assert {tuple(r) for r in boundary.edge_metres(df, polygons.limit(0)).select("metres", "name").collect()} == {(None, None)}


def test_parcels(spark):
    square = lambda x, y, r: [[[x, y], [x + r, y], [x + r, y + r], [x, y + r], [x, y]]]
    areas = spark.createDataFrame([("North", square(0.0, 1.0, 0.01)), ("South", square(0.0, 0.99, 0.01))], "name string, rings array<array<array<double>>>")
    parcels = [(1, square(0.004, 1.004, 0.0002), "north "), (2, square(0.004, 1.004, 0.0002), "South"), (3, square(0.004, 0.9999, 0.0002), "North"), (4, square(0.05, 1.0, 0.0002), "North"), (5, square(0.0099, 1.004, 0.0002), "North"), (6, [[[0.0, 1.0], [0.0, 1.0]]], "North"), (7, None, "North")]
    got = boundary.parcel_areas(spark.createDataFrame(parcels, "name int, rings array<array<array<double>>>, recorded string"), areas).collect()
    assert {r["name"]: (r["status"], r["area"]) for r in got} == {1: ("settled", "North"), 2: ("record_and_drawing_disagree", None), 3: ("crosses_boundary", None), 4: ("outside", None), 5: ("crosses_boundary", None), 6: ("no_geometry", None), 7: ("no_geometry", None)}


def test_only_ranges_that_differ_are_joined(spark):
    before = spark.range(20000).select("id", F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("v"), F.lit(None).cast("int").alias("w"))
    after = before.where("id <> 5").withColumn("v", F.when(F.col("id") == 17, None).otherwise(F.col("v"))).union(spark.createDataFrame([(-3, "new", 1)], "id long, v string, w int"))
    a, b = (snapshots.checksums(x, "id", ["v", "w"]) for x in (before, after))
    ranges = snapshots.differing(a, b)
    assert ranges.count() <= 3 and snapshots.narrowed(before, "id", ranges).count() < 100
    got = snapshots.changes(before, after, "id", ["v", "w"]).collect()
    assert {(r["id"], r["change"], tuple(r["reasons"])) for r in got} == {(5, "removed", ()), (17, "changed", ("v",)), (-3, "added", ())}
    assert snapshots.differing(a, snapshots.checksums(before.repartition(5, "v"), "id", ["v", "w"])).isEmpty()
    assert snapshots.changes(before, before.limit(0), "id", ["v", "w"]).count() == 20000
    n = spark.createDataFrame([(None, "x", 1), (1, "a", 2)], "id long, v string, w int")
    assert [(r["id"], r["change"], r["reasons"]) for r in snapshots.changes(n, n.withColumn("w", F.lit(9)), "id", ["v", "w"]).orderBy("id").collect()] == [(None, "changed", ["w"]), (1, "changed", ["w"])]


def test_chains_and_rings_of_merges(spark):
    pairs = [(2, 1), (3, 2), (4, 3)] + [(i + 1, i) for i in range(10, 50)] + [(60, 61), (61, 62), (62, 60), (60, 63)] + [(71, 70), (69, 70)] + [(80, 80)]
    plan = spark.createDataFrame([(s, x, "r") for s, x in pairs] + [(None, 5, "r")], "survivor int, loser int, rule string")
    got = {r["loser"]: (r["survivor"], r["hops"], r["n_survivors"]) for r in repair.last_survivors(plan).collect()}
    assert got[1] == (4, 3, 1) and got[3] == (4, 1, 1) and got[10] == (50, 40, 1) and got[70] == (69, 1, 2)
    assert all(got[k][0] is None for k in (60, 61, 62, 63, 80)) and 5 not in got
    rows = spark.createDataFrame([(1, "only here"), (2, None), (3, ""), (4, None), (60, None), (61, "ring")], "id int, description string").select("id", "description", F.lit("approved").alias("status"), F.lit(None).cast("string").alias("internal_note"))
    done = {r["id"]: (r["description"], r["status"]) for r in repair.merged(rows, plan).collect()}
    assert done == {1: ("only here", "rejected"), 2: (None, "rejected"), 3: ("", "rejected"), 4: ("only here", "approved"), 60: (None, "approved"), 61: ("ring", "approved")}
    links = spark.createDataFrame([("a", 1), ("a", 2), ("b", 61)], "article_id string, event_id int")
    assert {tuple(r) for r in repair.moved_links(links, plan).collect()} == {("a", 4), ("b", 61)}


def test_one_right_row_fills_one_left_row(spark):
    """Two rows of one title on the left: the first by id takes what the right has."""
    from quarry.operators import merging

    kind = "external_id string, title string, start_date date, end_date date, image_url string"
    left = spark.createDataFrame([("l2", "Show", date(2026, 6, 1), None, None), ("l1", "show", date(2026, 6, 1), None, ""), ("l3", "Other", date(2026, 6, 1), None, None)], kind)
    right = spark.createDataFrame([("r1", "Show | Hall", date(2026, 6, 1), None, "i1"), ("r2", "SHOW", date(2026, 6, 1), date(2026, 6, 2), "i2"), ("r3", "New", date(2026, 6, 1), None, "i3")], kind)
    got = {r["external_id"]: (r["image_url"], r["kept_from"], r["review"]) for r in merging.two_sources(left, right).collect()}
    assert got == {"l1": ("i1", "left", True), "l2": (None, "left", False), "l3": (None, "left", False), "r3": ("i3", "right", False)}


def test_pairs_of_large_groups(spark):
    """All pairs of each group once, whatever the blocks."""
    from quarry.operators import pairs

    rows = [(i, "hot" if i < 60 else f"k{i % 7}") for i in range(90)] + [(200, None)]
    df = spark.createDataFrame(rows, "id int, k string")
    want = sorted((k, a, b) for a, k in rows for b, x in rows if k is not None and k == x and a < b)
    for block in (1, 7, 500):
        assert sorted(tuple(r) for r in pairs.pairs_within(df, ["k"], block).collect()) == want
