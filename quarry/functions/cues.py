"""What a text mentions, with the nearest cue before it: both patterns are found in one pass and merged in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clocktext import day_of, month_number, near_year
from .tokens import fold

_OUT = "array<struct<at:int,mention:string,cue:string,gap:int>>"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: A day by its month's name, with or without a year.
DAY = rf"(?:{'|'.join(m.capitalize() for m in _MONTHS)})[a-z]*\.? [0-9]{{1,2}}(?:, [0-9]{{4}})?"


def mentions_with_cue(text: Column, mention: str, cue: str, within: int, required: bool = True) -> Column:
    """array of struct(at, mention, cue, gap): mentions of a text with the last cue that ends at most `within` characters before them.

    Patterns have no groups that capture. A mention without such a cue is left out, or has null if none is required. What both patterns
    fit is a mention. A null text has none.
    """
    both = f"(?:{mention})|(?:{cue})"
    found = F.regexp_extract_all(text, F.lit(both), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, both, -1), F.lit(1), F.size(found)), found, lambda gap, x: F.struct(F.length(gap).alias("gap"), x.alias("x"), x.rlike(f"^(?:{mention})$").alias("is")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("cue"), F.lit(0).alias("end"), F.array().cast(_OUT).alias("out"))

    def step(s: Column, p: Column) -> dict[str, Column]:
        at = s["at"] + p["gap"]
        near = s["cue"].isNotNull() & (at - s["end"] <= within)
        row = F.struct(at.alias("at"), p["x"].alias("mention"), F.when(near, s["cue"]).alias("cue"), F.when(near, at - s["end"]).alias("gap"))
        takes = p["is"] & (near if required else F.lit(True))
        return {"at": at + F.length(p["x"]), "cue": F.when(p["is"], s["cue"]).otherwise(p["x"]), "end": F.when(p["is"], s["end"]).otherwise(at + F.length(p["x"])), "out": F.when(takes, F.concat(s["out"], F.array(row))).otherwise(s["out"])}

    return F.when(text.rlike(mention), fold(pairs, start, ["at", "cue", "end", "out"], step)["out"]).otherwise(F.array().cast(_OUT))


def dates_by_cue(text: Column, published: Column, cue: str, against: str, within: int, slack: int = 30) -> Column:
    """Days that a text names behind a cue, and not behind a word that speaks against it (whichever is nearer); sorted, near the day of publication."""
    near = F.filter(mentions_with_cue(text, DAY, f"(?:{cue})|(?:{against})", within), lambda m: m["cue"].rlike(f"^(?:{cue})$"))
    part = lambda m, p: F.regexp_extract(m["mention"], p, 1)
    year = lambda m: part(m, r"([0-9]{4})$")
    day = lambda m: F.when(year(m) != "", day_of(year(m), month_number(m["mention"]), part(m, r" ([0-9]{1,2})"))).otherwise(near_year(month_number(m["mention"]), part(m, r" ([0-9]{1,2})"), published, slack))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(near, day))))


def facts_only_in(stored: Column, others: Column, fact: str) -> Column:
    """Facts (matches of a pattern) of a stored text that none of the other texts (an array) has, in order, each once."""
    own = F.array_distinct(F.regexp_extract_all(F.coalesce(stored, F.lit("")), F.lit(fact), F.lit(0)))
    return F.filter(own, lambda x: ~F.exists(others, lambda o: F.contains(F.lower(F.coalesce(o, F.lit(""))), F.lower(x))))
