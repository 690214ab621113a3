"""Opening hours, seasons and closed days that a text states, read token by token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clocktext import DAYS, MONTHS, clock, day_of
from .tokens import bound, fold, lookup, tokens

# Words and how far apart they may stand.
DAY_WORDS = {w: i for i, d in enumerate(DAYS) for w in (d, f"{d}s", {"tue": "tuesday", "wed": "wednesday", "thu": "thursday", "sat": "saturday"}.get(d, f"{d}day"), {"tue": "tuesdays", "wed": "wednesdays", "thu": "thursdays", "sat": "saturdays"}.get(d, f"{d}days"))} | {"tues": 2, "thur": 4, "thurs": 4}
DAY_GROUPS = {"weekend": (0, 6), "weekends": (0, 6), "weekday": (1, 2, 3, 4, 5), "weekdays": (1, 2, 3, 4, 5), "nightly": tuple(range(7)), "daily": tuple(range(7))}
EVERY = ("day", "night", "evening")
FILLERS, MOST_FILLERS = ("from", "open", "opens", "at", "hours"), 2
DAY_SPAN, DAY_LIST, TIME_SPAN = ("-", "–", "—", "to", "through", "thru"), (",", "&", "and", "+"), ("-", "–", "—", "to", "until", "till")
OPENING, CLOSING, SEASON_SPAN = ("open", "opens", "opening", "begin", "begins", "start", "starts"), ("through", "until", "to", "close", "closes", "end", "ends"), ("-", "–", "—", "to", "through", "until")
OPENING_NEAR, CLOSING_NEAR, SEASON_NEAR = 40, 25, 400
CLOSED, NO, NONE_OF = ("dark", "closed", "except", "excepting"), "no", ("shows", "performances", "tours", "events")
_MONTH_WORDS = {w: i + 1 for i, m in enumerate(MONTHS) for w in (m,)} | {w: i + 1 for i, w in enumerate("january february march april may june july august september october november december".split())} | {"sept": 9}

_CLOCK = r"\d{1,2}(?::\d{2})?\s*(?:[ap]\.m\.?|[ap]m\b\.?|[ap]\b)?"
_TOKEN = rf"(?s){_CLOCK}|\p{{L}}+\.?|\S"
_minutes = {"noon": 720, "midnight": 0}


def _word(token: Column) -> Column:
    return F.regexp_replace(token, r"\.$", "")


def _clock_token(token: Column) -> Column:
    """struct(hour, minute, half) of digits and what follows, or of noon and midnight (named); null for other tokens."""
    part = F.regexp_extract(token, r"^(\d+)", 1)
    hour, minute, half = part.try_cast("int"), F.coalesce(F.regexp_extract(token, r":(\d+)", 1).try_cast("int"), F.lit(0)), F.nullif(F.regexp_extract(token, r"([ap])", 1), F.lit(""))
    named = _word(token).isin(*_minutes)
    return F.when(named, F.struct(F.lit(12).alias("hour"), F.lit(0).alias("minute"), F.when(F.startswith(token, F.lit("n")), "p").otherwise("a").alias("half"), F.lit(True).alias("named"))).when(
        hour.between(1, 12) & minute.between(0, 59), F.struct(hour.alias("hour"), minute.alias("minute"), half.alias("half"), F.lit(False).alias("named"))
    )


def _at(c: Column, half: Column) -> Column:
    return F.pmod(c["hour"], F.lit(12)) * 60 + c["minute"] + F.when(half == "p", 720).otherwise(0)


def _span(first: Column, last: Column) -> Column:
    """'9:00 AM-5:00 PM': an opening without am or pm takes the closing's, 11-2 AM begins in the evening; what stays unclear is null."""
    close, same = _at(last, last["half"]), _at(first, last["half"])
    wraps = ~last["named"] & (same >= close)
    opening = F.when(first["half"].isNotNull(), _at(first, first["half"])).when(~wraps | (first["hour"] == 12) & (last["half"] == "a"), same).when(last["half"] == "a", _at(first, F.lit("p")))
    return F.when(last["half"].isNotNull() & (opening != close), F.concat(clock(opening), F.lit("-"), clock(close)))


# Phases of reading hours: days may follow, days are joined, a clock may follow, an opening is read, its dash is read.
_IDLE, _DAYS, _JOINED, _READY, _OPEN, _UNTIL = range(6)


def _named(table: dict[str, object], word: Column) -> Column:
    """What a word stands for: one membership test for each value, so no map is built or searched for a token."""
    out = F
    for value in dict.fromkeys(table.values()):
        out = out.when(word.isin(*(w for w, v in table.items() if v == value)), F.array(*(F.lit(i) for i in value)) if isinstance(value, tuple) else F.lit(value))
    return out


def stated_hours(text: Column) -> Column:
    """array of struct(day, hours) of every 'days, then opening to closing' in a text; day 0 is Sunday."""
    empty = F.array().cast("array<int>")

    def classed(t: Column) -> Column:
        clock = F.when(t.rlike(r"^(?:\d|noon|midnight)"), _clock_token(t))
        return bound(_word(t), lambda w: F.struct(t.alias("t"), w.alias("w"), _named(DAY_WORDS, w).alias("day"), _named(DAY_GROUPS, w).alias("group"), clock.alias("clock")))

    start = F.struct(
        F.lit(_IDLE).alias("phase"), empty.alias("days"), F.lit("").alias("link"), F.lit(0).alias("fillers"), F.lit(False).alias("every"), F.lit(None).cast("struct<hour:int,minute:int,half:string,named:boolean>").alias("open"),
        F.array().cast("array<struct<day:int,hours:string>>").alias("out"),
    )

    def share(s: Column, x: Column) -> Column:
        phase, w, t = s["phase"], x["w"], x["t"]
        every_day = s["every"] & w.isin(*EVERY)
        is_day, is_clock = x["day"].isNotNull() | x["group"].isNotNull() | every_day, x["clock"].isNotNull()
        within = phase.isin(_DAYS, _JOINED, _READY)
        filler = within & w.isin(*FILLERS) & (s["fillers"] < MOST_FILLERS)
        link = F.when(w.isin(*DAY_SPAN), "span").when(w.isin(*DAY_LIST), "list")
        new = (
            F.when(is_day, _DAYS).when(is_clock & (phase == _UNTIL), _IDLE).when(is_clock & within, _OPEN).when(phase.isin(_DAYS, _JOINED) & link.isNotNull(), _JOINED)
            .when(filler | (within & ~t.rlike(r"^[\p{L}\d]")), _READY).when((phase == _OPEN) & w.isin(*TIME_SPAN), _UNTIL).otherwise(_IDLE)
        )
        hours = F.when((phase == _UNTIL) & is_clock, _span(s["open"], x["clock"]))
        return F.struct(new.alias("phase"), every_day.alias("every"), link.alias("link"), filler.alias("filler"), hours.alias("hours"))

    def step(s: Column, x: Column, y: Column) -> dict[str, Column]:
        day, known = x["day"], s["days"]
        first = F.get(known, F.lit(0))
        spanned = F.transform(F.sequence(first, F.when(day < first, day + 7).otherwise(day)), lambda d: F.pmod(d, F.lit(7)))
        joined = (s["phase"] == _JOINED) & day.isNotNull()
        days = (
            F.when(y["phase"] != _DAYS, known).when(y["every"], F.array(*(F.lit(d) for d in range(7)))).when(x["group"].isNotNull(), x["group"])
            .when(joined & (s["link"] == "span") & (F.size(known) == 1), spanned).when(joined & (s["link"] == "list"), F.array_distinct(F.concat(known, F.array(day)))).otherwise(F.array(day))
        )
        return {
            "phase": y["phase"], "days": days, "link": F.when(y["phase"] == _JOINED, y["link"]).otherwise(""), "every": x["w"] == "every",
            "fillers": F.when(y["filler"], s["fillers"] + 1).when(y["phase"].isin(_READY, _JOINED), s["fillers"]).otherwise(0), "open": F.when(y["phase"] == _OPEN, x["clock"]).otherwise(s["open"]),
            "out": F.when(y["hours"].isNotNull(), F.concat(s["out"], F.transform(known, lambda d: F.struct(d.alias("day"), y["hours"].alias("hours"))))).otherwise(s["out"]),
        }

    read = fold(F.transform(tokens(text, _TOKEN), classed), start, ["phase", "days", "link", "fillers", "every", "open", "out"], step, share)["out"]
    return F.when(F.lower(text).rlike(r"\d|noon|midnight"), read).otherwise(F.array().cast("array<struct<day:int,hours:string>>"))


def weekly_hours(text: Column) -> Column:
    """map of day (0 Sunday) to 'h:mm AM-h:mm PM'. A day with two different hours has none; an end without am or pm is no evidence."""
    one = lambda pairs: F.filter(pairs, lambda p: F.size(F.filter(pairs, lambda q: q["day"] == p["day"])) == 1)
    return F.map_from_entries(bound(F.array_distinct(stated_hours(text)), one))


def _mentions(year: int | None = None) -> str:
    month = "|".join(sorted(_MONTH_WORDS, key=len, reverse=True))
    return rf"\b(?:{month})\b\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?!\d)(?:\s*,?\s*{year}\b)?" if year else rf"\b(?:{month})\b\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?!\d)"


def _day_in(mention: Column, year: int) -> Column:
    word, day = F.regexp_extract(mention, r"^(\p{L}+)", 1), F.regexp_extract(mention, r"^\p{L}+\.?\s+(\d+)", 1)
    return day_of(F.lit(year), F.try_element_at(lookup(_MONTH_WORDS), word), day)


def season(text: Column, year: int) -> Column:
    """struct(start, end): two days joined by a dash or 'to', else an opening and the last closing near behind it; null where none is said."""
    is_day = rf"^{_mentions()}"
    start = F.struct(
        F.lit(0).alias("at"), F.lit("").alias("before"), F.lit(False).alias("dashed"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"),
        F.lit(None).cast("int").alias("opens"), F.lit(None).cast("string").alias("open"), F.lit(None).cast("int").alias("since"), F.lit(None).cast("int").alias("closes"), F.lit(None).cast("string").alias("close"),
    )

    def classed(t: Column) -> Column:
        return bound(F.struct(t.alias("t"), _word(t).alias("w"), t.rlike(is_day).alias("mention")), lambda x: F.struct(
            x["t"].alias("t"), x["w"].alias("w"), x["mention"].alias("mention"), t.rlike(r"^\s+$").alias("space"), (t.isin(".", "\n") | t.rlike(r"\p{L}\.$") & ~x["mention"]).alias("stop"), F.length(t).alias("n"), t.isin(*SEASON_SPAN).alias("span"), x["w"].isin(*OPENING).alias("opening"), x["w"].isin(*CLOSING).alias("closing"),
        ))

    def step(s: Column, x: Column) -> dict[str, Column]:
        at, t, mention, space, stop = s["at"], x["t"], x["mention"], x["space"], x["stop"]
        found = s["first"].isNotNull()
        pair = mention & s["dashed"] & (s["before"] != "") & ~found
        first_open = x["opening"] & s["open"].isNull()
        opened = mention & s["opens"].isNotNull() & s["open"].isNull() & (at - s["opens"] <= OPENING_NEAR)
        closed = mention & s["closes"].isNotNull() & (at - s["closes"] <= CLOSING_NEAR) & (at + x["n"] - s["since"] <= SEASON_NEAR)
        return {
            "at": at + x["n"], "before": F.when(mention, t).when(space | x["span"], s["before"]).otherwise(""), "dashed": F.when(space, s["dashed"]).otherwise(x["span"]),
            "first": F.when(pair, s["before"]).otherwise(s["first"]), "last": F.when(pair, t).otherwise(s["last"]),
            "opens": F.when(first_open, at + x["n"]).when(~stop, s["opens"]), "open": F.when(opened, t).otherwise(s["open"]), "since": F.when(opened, at + x["n"]).otherwise(s["since"]),
            "closes": F.when(s["open"].isNotNull() & x["closing"], at + x["n"]).when(~stop & ~mention, s["closes"]), "close": F.when(closed, t).otherwise(s["close"]),
        }

    names = ["at", "before", "dashed", "first", "last", "opens", "open", "since", "closes", "close"]
    read = fold(F.transform(tokens(text, rf"(?s){_mentions(year)}|\p{{L}}+\.?|\n|[^\S\n]+|."), classed), start, names, step)

    def days(s: Column) -> Column:
        a, b = _day_in(F.coalesce(s["first"], s["open"]), year), _day_in(F.when(s["first"].isNotNull(), s["last"]).otherwise(s["close"]), year)
        return F.when(a <= b, F.struct(a.alias("start"), b.alias("end")))

    return F.when(F.lower(text).rlike(_mentions()), bound(read, days))


def closed_dates(text: Column, year: int) -> Column:
    """Days that the first sentence with such days names after a word for closed."""
    days = rf"{_mentions()}(?:\s*[-–—]\s*\d{{1,2}})?"
    none = F.array().cast("array<date>")

    def named(t: Column) -> Column:
        def each(first: Column) -> Column:
            last = F.coalesce(F.regexp_extract(t, r"(\d+)$", 1).try_cast("int"), F.dayofmonth(first))
            return F.when(last >= F.dayofmonth(first), F.filter(F.transform(F.sequence(F.lit(0), last - F.dayofmonth(first)), lambda k: F.date_add(first, k)), lambda d: F.month(d) == F.month(first)))

        return F.coalesce(bound(_day_in(t, year), each), none)

    start = F.struct(F.lit(False).alias("closed"), F.lit("").alias("before"), F.lit(False).alias("ends"), F.lit(False).alias("done"), none.alias("days"))

    def classed(t: Column) -> Column:
        return bound(F.struct(t.alias("t"), _word(t).alias("w"), t.rlike(rf"^{days}").alias("mention")), lambda x: F.struct(
            x["w"].alias("w"), x["mention"].alias("mention"), (t == "\n").alias("line"), t.rlike(r"^[\p{L}]").alias("letter"), x["w"].isin(*CLOSED).alias("closed"),
            (t.isin(".", "!", "?") | (t.rlike(r"\p{L}\.$") & ~x["mention"])).alias("ends"), F.when(x["mention"], named(t)).alias("days"),
        ))

    def share(s: Column, x: Column) -> Column:
        return F.struct((x["line"] | (s["ends"] & x["letter"])).alias("new"))  # a sentence ends at a full stop before a word, or with its line

    def step(s: Column, x: Column, y: Column) -> dict[str, Column]:
        w, new = x["w"], y["new"]
        over = s["done"] | (new & (F.size(s["days"]) > 0))
        says = x["closed"] | ((w == "open") & (s["before"] == "not")) | (w.isin(*NONE_OF) & (s["before"] == NO))
        takes = x["mention"] & s["closed"] & ~new & ~over
        return {"closed": (s["closed"] & ~new) | says, "before": w, "ends": x["ends"], "done": over, "days": F.when(takes, F.concat(s["days"], x["days"])).otherwise(s["days"])}

    out = fold(F.transform(tokens(text, rf"(?s){days}|\p{{L}}+\.?|\n|\S"), classed), start, ["closed", "before", "ends", "done", "days"], step, share)
    return F.when(F.lower(text).rlike(_mentions()), F.array_sort(F.array_distinct(F.array_compact(out["days"])))).otherwise(none)


def season_calendar(season_: Column, hours: Column, closed: Column, first: Column | None = None) -> Column:
    """array of struct(date, open, hours) of a season: closed days win, days without hours are left out."""

    def rows(x: Column) -> Column:
        start = F.greatest(x["season"]["start"], x["from"])
        days = F.when(start <= x["season"]["end"], F.sequence(start, x["season"]["end"])).otherwise(F.array().cast("array<date>"))
        each = F.transform(days, lambda d: F.struct(d.alias("date"), (~F.array_contains(x["closed"], d)).alias("open"), F.when(~F.array_contains(x["closed"], d), F.try_element_at(x["hours"], F.dayofweek(d) - 1)).alias("hours")))
        return F.filter(each, lambda r: ~r["open"] | r["hours"].isNotNull())

    given = first if first is not None else F.lit(None).cast("date")
    return bound(F.struct(season_.alias("season"), hours.alias("hours"), closed.alias("closed"), given.alias("from")), rows)
