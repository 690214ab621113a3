"""Pages read line by line by a declared machine: a table of classes, states and moves, run over blocks of lines.

Every line is a function from states to states; a block's function is that of its lines one after another, so blocks of one page can be read
by different tasks: the states at the beginning of the blocks come from their functions alone, and only these travel.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import bound, fold


@dataclass(frozen=True)
class Machine:
    """Classes of lines (the first pattern that fits; no other: "other"), and for (state, class) the next state and what is done.

    start begins a record with the line, extend adds it to the last one, hold puts it in front of the next; absent moves change nothing.
    Registers keep what a class's pattern found (class -> group), until a class in `clears` comes.
    """

    states: tuple[str, ...]
    classes: tuple[tuple[str, str], ...]
    moves: dict[tuple[str, str], tuple[str, str | None]]
    registers: dict[str, dict[str, int]] = field(default_factory=dict)
    clears: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def names(self) -> tuple[str, ...]:
        return *(n for n, _ in self.classes), "other"

    def table(self) -> list[list[int]]:
        return [[self.states.index(self.moves.get((s, n), (s, None))[0]) for n in self.names] for s in self.states]


def _class(line: Column, m: Machine) -> Column:
    out = F.lit(len(m.classes))
    for i in range(len(m.classes) - 1, -1, -1):
        out = F.when(line.rlike(m.classes[i][1]), i).otherwise(out)
    return out.cast("int")


def states(pages: DataFrame, keys: list[str], lines: Column, m: Machine, block: int = 64) -> DataFrame:
    """keys, n (from 0), line, class, state (before the line), action, of every line; keys tell the pages apart."""
    size = F.size("_l")
    cut = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")), lambda i: F.slice("_l", i * block + 1, block))
    blocks = pages.select(*keys, lines.alias("_l")).where(size > 0).select(*keys, F.posexplode(cut).alias("_b", "_l"))
    blocks = blocks.withColumn("_l", F.transform("_l", lambda x: F.struct(x.alias("line"), _class(x, m).alias("class"))))
    table = F.array(*(F.array(*(F.lit(s) for s in row)) for row in m.table()))
    function = F.aggregate("_l", F.array(*(F.lit(s) for s in range(len(m.states)))), lambda f, x: F.transform(f, lambda s: table[s][x["class"]]))
    # state at the start of every block, from the functions of those before it
    runs = blocks.select(*keys, "_b", function.alias("f")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "f"))).alias("fs"))
    first = F.aggregate("fs", F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(x["f"][F.element_at(done, -1)])))
    entries = runs.select(*keys, F.posexplode(F.slice(first, F.lit(1), F.size("fs"))).alias("_b", "_s"))
    state = F.struct(F.col("_s").alias("s"), F.array().cast("array<struct<line:string,class:int,state:int>>").alias("out"))
    step = lambda a, x: {"s": table[a["s"]][x["class"]], "out": F.concat(a["out"], F.array(F.struct(x["line"].alias("line"), x["class"].alias("class"), a["s"].alias("state"))))}
    read = blocks.join(entries, [*keys, "_b"]).select(*keys, "_b", F.posexplode(fold(F.col("_l"), state, ["s", "out"], step)["out"]).alias("_i", "x"))
    action = F.lit(None).cast("string")
    for (s, n), (_, what) in m.moves.items():
        if what:
            action = F.when((F.col("x.state") == m.states.index(s)) & (F.col("x.class") == m.names.index(n)), what).otherwise(action)
    named = lambda of, i: F.array(*(F.lit(n) for n in of))[i]
    return read.select(*keys, (F.col("_b") * block + F.col("_i")).alias("n"), F.col("x.line").alias("line"), named(m.names, F.col("x.class")).alias("class"), named(m.states, F.col("x.state")).alias("state"), action.alias("action"))


def records(read: DataFrame, keys: list[str], m: Machine) -> DataFrame:
    """keys, record (from 1), n (its first line), a column for each register as it stood there, held (the line put in front), n_lines, text (its lines, joined by a space)."""
    before = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    patterns = dict(m.classes)
    cols = {}
    for name, sets in m.registers.items():
        value = F.lit(None).cast("struct<v:string>")
        for k, group in sets.items():
            value = F.when(F.col("class") == k, F.struct(F.regexp_extract("line", patterns[k], group).alias("v"))).otherwise(value)
        for k in m.clears.get(name, ()):
            value = F.when(F.col("class") == k, F.struct(F.lit(None).cast("string").alias("v"))).otherwise(value)
        cols[name] = F.last(value, True).over(before)["v"]
    ends_hold = F.col("action").eqNullSafe("start") | F.col("class").isin(*m.clears.get("held", ("",)))
    held = F.last(F.when(F.col("action") == "hold", F.struct(F.col("line").alias("v"))).when(ends_hold, F.struct(F.lit(None).cast("string").alias("v"))), True).over(earlier)["v"]
    run = read.select("*", *(v.alias(k) for k, v in cols.items()), held.alias("held"), F.sum((F.coalesce(F.col("action") == "start", F.lit(False))).cast("long")).over(before).alias("record"))
    run = run.where(F.col("action").isin("start", "extend") & (F.col("record") > 0))
    first = F.min(F.struct("n", *cols, "held"))
    parts = F.array_sort(F.collect_list(F.struct("n", F.when(F.col("action") == "start", F.concat_ws(" ", "held", "line")).otherwise(F.col("line")).alias("line"))))
    out = run.groupBy(*keys, "record").agg(first.alias("f"), parts.alias("p"))
    return out.select(*keys, "record", "f.n", *(F.col(f"f.{k}").alias(k) for k in (*cols, "held")), F.size("p").cast("long").alias("n_lines"), F.array_join("p.line", " ").alias("text"))


def around(pages: DataFrame, keys: list[str], lines: Column, pattern: str, before: int = 2, after: int = 1) -> DataFrame:
    """keys, n, line and before (nearest first) and after it, of every line with the pattern: records told by one line in a fixed place."""
    near = lambda ls, i: F.struct(
        i.cast("int").alias("n"), ls[i].alias("line"), F.reverse(F.slice(ls, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)))).alias("before"), F.slice(ls, i + 2, after).alias("after")
    )
    hits = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(pattern), near(ls, i))), lambda x: x.isNotNull())
    return pages.select(*keys, F.inline(bound(lines, hits)))


def sections(pages: DataFrame, keys: list[str], lines: Column, labels: list[str]) -> DataFrame:
    """keys, label, lines: what follows the first line that is exactly one of the labels, up to the next label."""
    start = F.struct(F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<label:string,line:string>>").alias("out"))

    def step(s: Column, x: Column) -> dict[str, Column]:
        new = x.isin(*labels)
        known = F.array_contains(s["seen"], x)
        row = F.array(F.struct(F.when(new, x).otherwise(s["label"]).alias("label"), F.when(~new, x).alias("line")))
        return {"label": F.when(new & known, F.lit(None)).when(new, x).otherwise(s["label"]), "seen": F.when(new & ~known, F.concat(s["seen"], F.array(x))).otherwise(s["seen"]), "out": F.when((new & ~known) | (~new & s["label"].isNotNull()), F.concat(s["out"], row)).otherwise(s["out"])}

    rows = pages.select(*keys, F.posexplode(fold(lines, start, ["label", "seen", "out"], step)["out"]).alias("n", "x"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("x.line").isNotNull(), F.struct("n", F.col("x.line").alias("line")))))
    return rows.groupBy(*keys, F.col("x.label").alias("label")).agg(F.transform(in_order, lambda r: r["line"]).alias("lines"))


# Names of months, and lines of a page of dates that are no titles.
_MONTHS = "January February March April May June July August September October November December".split()
MENU = "home about events shop contact menu ticket tickets newsletter subscribe instagram facebook twitter donate directions hours faq".split()
LONGEST_TITLE = 120
# What tells a year, a line in brackets, a place, a presenter and a price from a title.
YEAR_ALONE, BRACKETS, PLACE_AFTER, PRESENTER, PRICES = r"^(20\d{2})$", r"^\(.+\)$", r"^(?:at|in)\s+[A-Z]", r"(?i)\bpresents?$", r"\$\d.*|tickets?:.*"

#: A page of dates: a year or a day as a heading, titles below; a line in brackets or a place goes on with the title before it, one that ends
#: with 'presents' stands in front of the next.
DATED_LISTING = Machine(
    states=("none", "dated", "listed", "held", "held_listed"),
    classes=(
        ("year", YEAR_ALONE), ("day", rf"(?i)^((?:{'|'.join(_MONTHS)})\s+\d{{1,2}}(?:,?\s*\d{{4}})?)$"),
        ("noise", rf"(?i)^(?:.{{0,2}}|.{{{LONGEST_TITLE + 1},}}|coming soon|{'|'.join(MENU)}|https?://.*|.*@.*|closed\b.*)$"), ("bracket", BRACKETS), ("place", PLACE_AFTER), ("presents", PRESENTER),
    ),
    moves={
        **{(s, k): ("none" if k == "year" else "dated", None) for s in ("none", "dated", "listed", "held", "held_listed") for k in ("year", "day")},
        ("dated", "other"): ("listed", "start"), ("listed", "other"): ("listed", "start"), ("held", "other"): ("listed", "start"), ("held_listed", "other"): ("listed", "start"),
        ("dated", "bracket"): ("listed", "start"), ("dated", "place"): ("listed", "start"), ("held", "bracket"): ("listed", "start"), ("held", "place"): ("listed", "start"),
        **{(s, k): (s, "extend") for s in ("listed", "held_listed") for k in ("bracket", "place")},
        ("dated", "presents"): ("held", "hold"), ("held", "presents"): ("held", "hold"), ("listed", "presents"): ("held_listed", "hold"), ("held_listed", "presents"): ("held_listed", "hold"),
    },
    registers={"year": {"year": 1}, "day": {"day": 1}}, clears={"day": ("year",), "held": ("year", "day")},
)


def dated_listing(pages: DataFrame, keys: list[str], lines: Column, year: int) -> DataFrame:
    """keys, record, date, title of a page of dates; a day without a year is in the last year that stood alone, or in `year`."""
    from ..functions.clocktext import day_of, month_number

    rows = records(states(pages, keys, lines, DATED_LISTING), keys, DATED_LISTING)
    part = lambda p: F.nullif(F.regexp_extract("day", p, 1), F.lit(""))
    date = day_of(F.coalesce(part(r"(\d{4})$"), F.col("year"), F.lit(str(year))), month_number(part(r"^(\p{L}+)")), part(r"^\p{L}+\s+(\d{1,2})"))
    return rows.select(*keys, "record", date.alias("date"), F.col("text").alias("title"))


_MONTH_DAY = rf"(?:{'|'.join(m[:3] for m in _MONTHS)})[a-z]*\.?\s+\d{{1,2}}(?:st|nd|rd|th)?\b(?:,?\s*\d{{4}}\b)?"
#: A page of titles, each with a line of days below it; prices and menus between are no titles.
TITLED_DATES = Machine(
    states=("none", "titled"),
    classes=(("days", rf"(?i)^(.*{_MONTH_DAY}.*)$"), ("noise", rf"(?i)^(?:.{{0,2}}|.{{101,}}|{'|'.join(MENU)}|{PRICES})$")),
    moves={("none", "other"): ("titled", "hold"), ("titled", "other"): ("titled", "hold"), ("titled", "days"): ("none", "start")},
    registers={"days": {"days": 1}},
)


def titled_dates(pages: DataFrame, keys: list[str], lines: Column, today: Column) -> DataFrame:
    """keys, title, date, end_date, time: of days joined by a dash one row from the first to the last, of others a row each.

    Days without a year take that of another day of the line, or lie near today. As many times as days are paired with them in order; one time
    counts for every day, and a run of days shows one if it states one.
    """
    from ..functions.clocktext import day_of, month_number, next_occurrence
    from ..functions.tokens import bound

    rows = records(states(pages, keys, lines, TITLED_DATES), keys, TITLED_DATES)
    line = F.col("days")
    found = F.regexp_extract_all(line, F.lit(f"(?i){_MONTH_DAY}"), F.lit(0))
    times = F.regexp_extract_all(line, F.lit(r"(?i)\d{1,2}(?::\d{2})?\s*[ap]\.?m\b\.?|\bnoon\b|\bmidnight\b"), F.lit(0))
    year = F.nullif(F.regexp_extract(line, r"(?i)\d{1,2}(?:st|nd|rd|th)?,?\s*(\d{4})\b", 1), F.lit(""))
    number = lambda x: F.regexp_extract(x, r"^\p{L}+\.?\s+(\d{1,2})", 1)
    own = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"(\d{4})$", 1), F.lit("")), year)
    day = lambda x: F.coalesce(day_of(own(x), month_number(x), number(x)), F.when(own(x).isNull(), next_occurrence(month_number(x), number(x), today)))
    between = F.regexp_extract(line, rf"(?i){_MONTH_DAY}(.*?){_MONTH_DAY}", 1)
    run = between.rlike("[-–]") & ~between.rlike(r"(?i)\band\b|&")

    def dates(x: Column) -> Column:
        one = F.array(F.struct(day(x["found"][0]).alias("date"), F.when(F.size(x["found"]) > 1, day(F.element_at(x["found"], -1))).alias("end_date"), F.get(x["times"], F.lit(0)).alias("time")))
        each = F.transform(x["found"], lambda f, i: F.struct(day(f).alias("date"), F.lit(None).cast("date").alias("end_date"), F.when(F.size(x["times"]) == F.size(x["found"]), x["times"][i]).otherwise(F.get(x["times"], F.lit(0))).alias("time")))
        return F.when(run | (F.size(x["found"]) == 1), one).otherwise(each)

    return rows.select(*keys, F.col("held").alias("title"), F.inline(bound(F.struct(found.alias("found"), times.alias("times")), dates)))
