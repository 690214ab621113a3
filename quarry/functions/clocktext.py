"""Days, hours and prices that texts state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.quality import first_reason
from .text import blank, present
from .tokens import bound

#: Months by their first three letters; days likewise, Sunday is 0.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(F.substring(name, 1, 3))), F.lit(0).cast("long")).cast("int")


def _int(x: Column) -> Column:
    return x.try_cast("int")


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers, or null where there is no such day."""
    part = lambda x, n: F.lpad(_int(x).cast("string"), n, "0")
    return F.concat(part(year, 4), F.lit("-"), part(month, 2), F.lit("-"), part(day, 2)).try_cast("date")


def _groups(x: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(F.coalesce(x, F.lit("")), pattern, k) for k in range(1, n + 1)]


def explicit_date(text: Column) -> Column:
    """The first full date of a text: month by name, else with slashes, else as year-month-day."""
    named, slashed, iso = rf"(?i)\b{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", r"\b(\d{4})-(\d{2})-(\d{2})\b"
    m, s, i = _groups(text, named, 3), _groups(text, slashed, 3), _groups(text, iso, 3)
    return F.coalesce(day_of(m[2], month_number(m[0]), m[1]), day_of(s[2], s[0], s[1]), day_of(*i))


def date_range(text: Column) -> Column:
    """struct(start, end) of a text that is a range of days and nothing else; end is null for one day, both for anything unreadable."""
    year, day = r",?\s+(\d{4})$", r"\s+(\d{1,2})"
    # all forms in one pattern: the first day, its year where the last day repeats it, the last month, day and year; one day has the year alone
    pattern = rf"(?i)^{_MONTH}{day}(?:(?:,?\s+(\d{{4}})(?=\s*-\s*[a-z]))?\s*-\s*(?:{_MONTH}\s+)?(\d{{1,2}}))?{year}"
    names = ("month", "day", "year", "last_month", "last_day", "last_year")

    def read(t: Column) -> Column:
        return F.struct(*(F.nullif(F.regexp_extract(t, pattern, k + 1), F.lit("")).alias(n) for k, n in enumerate(names)))

    def days(x: Column) -> Column:
        first, last = month_number(x["month"]), month_number(F.coalesce(x["last_month"], x["month"]))
        turn = F.when(x["year"].isNull() & (first > last), 1).otherwise(0)  # the range goes over New Year
        return F.struct(day_of(F.coalesce(_int(x["year"]), _int(x["last_year"]) - turn), first, x["day"]).alias("start"), day_of(x["last_year"], last, F.coalesce(x["last_day"], x["day"])).alias("end"))

    def said(d: Column) -> Column:
        ok = d["end"] >= d["start"]
        return F.struct(F.when(ok, d["start"]).alias("start"), F.when(ok & (d["end"] > d["start"]), d["end"]).alias("end"))

    return bound(bound(bound(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[–—]", "-")), read), days), said)


def near_year(month: Column, day: Column, published: Column, slack: int) -> Column:
    """A day without a year: of the year of publication, or of the next where that is more than slack days before it."""
    this = day_of(F.year(published), month, day)
    return F.when(this < F.date_sub(published, slack), day_of(F.year(published) + 1, month, day)).otherwise(this)


def dates_in_text(text: Column, published: Column, slack: int = 30) -> Column:
    """All days that a text names by month, sorted; those without a year lie near the day of publication."""
    pattern = rf"(?i)\b{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?!\d)(?:,?\s+(\d{{4}}))?"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))

    def one(x: Column) -> Column:
        m, d, y = (F.regexp_extract(x, pattern, k) for k in (1, 2, 3))
        return F.when(y != "", day_of(y, month_number(m), d)).otherwise(near_year(month_number(m), d, published, slack))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, one))))


def listing_date(text: Column, today: Column, slack: int = 7) -> Column:
    """'5 Jun' or an ISO date as listings write them; one without a year that is more than slack days past is next year's."""
    t = F.trim(F.coalesce(text, F.lit("")))
    m = _groups(t, r"^(?:[A-Za-z]{3},?\s+)?(\d{1,2})\s+([A-Za-z]+)\.?$", 2)
    return F.coalesce(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:T.*)?$", 1).try_cast("date"), near_year(month_number(m[1]), m[0], today, slack))


def next_occurrence(month: Column, day: Column, today: Column, slack: int = 3) -> Column:
    return near_year(month, day, today, slack)


def date_mentions(text: Column) -> Column:
    """array of struct(month, day, year) of days named in either order; year is null where none is said."""
    forms = ((rf"(?i)\b{_MONTH}\b[\s.,-]+(\d{{1,2}})(?!\d)(?!\s*[ap]m\b)(?:st|nd|rd|th)?(?:[\s,-]+(\d{{4}}))?", 1, 2), (rf"(?i)\b(\d{{1,2}})(?!\d)(?:st|nd|rd|th)?[\s.,-]+{_MONTH}\b(?:[\s,-]+(\d{{4}}))?", 2, 1))

    def all_of(pattern: str, m: int, d: int) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda x: F.struct(month_number(F.regexp_extract(x, pattern, m)).alias("month"), _int(F.regexp_extract(x, pattern, d)).alias("day"), _int(F.regexp_extract(x, pattern, 3)).alias("year")))

    return F.filter(F.concat(*(all_of(*f) for f in forms)), lambda x: x["day"].between(1, 31))


def mentions_agree(text: Column, start: Column, end: Column) -> Column:
    """No day that the text names lies outside a run, by month and day; a text that names none agrees."""
    last = F.coalesce(end, start)
    at = lambda d: F.month(d) * 100 + F.day(d)
    fits = lambda m: (m["year"].isNull() | m["year"].isin(F.year(start), F.year(last))) & (m["month"] * 100 + m["day"]).between(F.least(at(start), at(last)), F.greatest(at(start), at(last)))
    return start.isNull() | F.forall(date_mentions(text), fits)


def _time(hour: Column, minute: Column, half: Column) -> Column:
    """Minutes of a 12-hour time, or null."""
    h, m = _int(hour), F.coalesce(_int(minute), F.lit(0))
    return F.when(h.between(1, 12) & m.between(0, 59), F.pmod(h, F.lit(12)) * 60 + m + F.when(F.lower(F.substring(half, 1, 1)) == "p", 720).otherwise(0))


def start_and_end(time: Column) -> Column:
    """struct(start, end) in minutes: a time at the very start of a text, and one after a dash or 'to' right behind it."""
    one = r"(\d{1,2})(?::([0-5]\d))?\s*([ap])\.?m\.?"
    s = _groups(F.trim(time), rf"(?i)^{one}(?!\w)", 3)
    e = _groups(F.trim(time), rf"(?i)^\d{{1,2}}(?::[0-5]\d)?\s*[ap]\.?m\.?\s*(?:[–—-]|to)\s*{one}(?!\w)", 3)
    start = _time(*s)
    return F.struct(start.alias("start"), F.when(start.isNotNull(), _time(*e)).alias("end"))


def clock(minutes: Column) -> Column:
    """'7:05 PM' for minutes of a day."""
    h = F.floor(F.pmod(minutes, F.lit(1440)) / 60)
    return F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":"), F.lpad(F.pmod(minutes, F.lit(60)).cast("string"), 2, "0"), F.when(h >= 12, " PM").otherwise(" AM"))


def clock_of(hm: Column) -> Column:
    """'19:05' as '7:05 PM'; null where it is no time."""
    h, m = _groups(hm, r"^(\d{1,2}):(\d{2})", 2)
    return F.when(h != "", clock(_int(h) * 60 + _int(m)))


def without_placeholder_end(time: Column) -> Column:
    """A time that ends at 11:59 PM states its start only."""
    head = F.regexp_extract(time, r"(?i)^(.*?\S)\s*(?:[–—-]|\bto\b|\buntil\b)\s*(?:11:59\s*P\.?M\.?|23:59)\s*$", 1)
    return F.when(head.rlike(r"(?i)\d\s*(?:AM|PM)|\bnoon\b"), head).otherwise(time)


def stated_span(start: Column, end: Column, all_day: Column | None = None, same_day: bool = False) -> Column:
    """struct(start_date, end_date, time) of two wall-clock timestamps: an end on another day is the last day, 23:59 is no end time.

    With same_day, as one source has it, only an end on the first day is shown.
    """
    s, e = start.cast("timestamp"), end.cast("timestamp")
    minute = lambda t: F.hour(t) * 60 + F.minute(t)
    shown = e.isNotNull() & (minute(e) != 1439)
    shown = shown & (F.to_date(e) == F.to_date(s)) & (minute(e) != minute(s)) if same_day else shown
    time = F.when(shown, F.concat(clock(minute(s)), F.lit(" – " if same_day else "–"), clock(minute(e)))).otherwise(clock(minute(s)))
    hidden = F.coalesce(all_day, F.lit(False)) if all_day is not None else F.lit(False)
    return F.struct(F.to_date(s).alias("start_date"), F.when(F.to_date(e) != F.to_date(s), F.to_date(e)).alias("end_date"), F.when(~hidden, time).alias("time"))


def instance(start: Column, end: Column, all_day: Column, late: str = "06:00") -> Column:
    """struct(date, end_date, all_day, time, signature) of one occurrence; start and end are ISO texts in local time.

    Midnight to midnight is all day; a night that ends by `late` belongs to its first day; any longer span shows its start only.
    """
    day, hm = (lambda x: F.substring(x, 1, 10).try_cast("date")), (lambda x: F.substring(x, 12, 5))
    d, last, a, b = day(start), day(end), hm(start), hm(end)
    whole = F.datediff(last, d)
    filled = (a == "00:00") & (((b == "00:00") & (whole >= 1)) | ((b == "23:59") & (whole >= 0)))
    is_all = F.coalesce(all_day, F.lit(False)) | F.coalesce(filled, F.lit(False))
    final = F.when(b == "00:00", F.date_sub(last, 1)).otherwise(last)
    night = (whole == 1) & (b <= late) & (b < a)
    long_ = F.coalesce((whole >= 1) & ~night, F.lit(False))
    time = F.when(~long_ & end.isNotNull() & (b != a), F.concat(clock_of(a), F.lit(" – "), clock_of(b))).otherwise(clock_of(a))
    return F.struct(
        d.alias("date"), F.when(is_all & (final > d), final).when(~is_all & long_, last).alias("end_date"), is_all.alias("all_day"), F.when(~is_all, time).alias("time"),
        F.when(is_all, "all-day").otherwise(F.concat(a, F.lit("-"), F.coalesce(b, F.lit("")))).alias("signature"),
    )


def cron_hours(expr: Column) -> Column:
    """Hours between runs of a schedule of five fields, or null where it is none of the plain kinds."""
    p = [F.get(F.split(F.trim(F.coalesce(expr, F.lit(""))), r"\s+"), F.lit(k)) for k in range(5)]
    plain = (F.size(F.split(F.trim(expr), r"\s+")) == 5) & p[0].rlike(r"^\d+$") & (p[2] == "*") & (p[3] == "*")
    every, number = F.regexp_extract(p[1], r"^\*/(\d+)$", 1), p[1].rlike(r"^\d+$")
    hours = F.when(number & (p[4] == "*"), 24).when(number & p[4].rlike(r"^\d$"), 168).when((every != "") & (p[4] == "*"), _int(every)).when((p[1] == "*") & (p[4] == "*"), 1)
    return F.when(plain, hours)


def cron_slots(expr: Column, now: Column, days: int, most: int) -> Column:
    """Times at which a schedule was due in the last days, newest first, at most `most`; null where it is none of the plain kinds."""
    p = [F.get(F.split(F.trim(F.coalesce(expr, F.lit(""))), r"\s+"), F.lit(k)) for k in range(5)]
    every = _int(F.regexp_extract(p[1], r"^\*/(\d+)$", 1))
    hours = F.when(p[1].rlike(r"^\d+$"), F.array(_int(p[1]))).when(p[1] == "*", F.sequence(F.lit(0), F.lit(23))).when(every.between(1, 23), F.sequence(F.lit(0), F.lit(23), every))
    valid = (F.size(F.split(F.trim(expr), r"\s+")) == 5) & (_int(p[0]) <= 59) & (p[2] == "*") & (p[3] == "*") & p[4].rlike(r"^([0-7]|\*)$") & F.forall(hours, lambda h: h <= 23)
    dates = F.transform(F.sequence(F.lit(0), F.lit(days)), lambda k: F.date_sub(now.cast("date"), k))
    dates = F.filter(dates, lambda d: (p[4] == "*") | (F.dayofweek(d) - 1 == F.pmod(_int(p[4]), F.lit(7))))
    slots = F.flatten(F.transform(dates, lambda d: F.transform(hours, lambda h: d.cast("timestamp") + F.make_dt_interval(F.lit(0), h, _int(p[0])))))
    due = F.filter(slots, lambda s: (s <= now) & (s >= now - F.make_dt_interval(F.lit(days))))
    return F.when(valid, F.slice(F.reverse(F.array_sort(due)), 1, most))


#: How texts say that admission is free, and what takes it back.
FREE = r"\b(?:free (?:admission|entry|to attend|to the public|and open to the public|of charge)|admission (?:is )?free)\b"
FREE_LIMITED = r"(?i)\b(?:for (?:members?|kids?|children|students?|seniors?|veterans?|residents?|youth|teens?|ticket holders?)|under \d|over \d|ages? \d|before|after|until|with|only|except|on (?:the )?(?:first|second|third|last|every|each)|first|every|each|ticket holders?|members?)\b|\$\d"
FREE_DENIED_BEFORE = r"(?i)(?:\b(?:not|no|never)\s+|n't\s+)(?:\w+\s+){0,2}$"
FREE_DENIED_AFTER = (
    r"(?i)^\s*(?:\w+\s+){0,3}?(?:not|never|cannot|unavailable|no longer|\w+n't)\b"
    r"|^[\s,:;.()\-–—]*(?:not|cannot|no longer|never|\w+n't)\s+(?:\w+\s+){0,2}?(?:available|offered|provided|included|applicable|possible|valid|this year|anymore)\b"
    r"|^[\s,:;.()\-–—]*(?:discontinued\b|(?:has|have|had)\s+been\s+(?:discontinued|cancell?ed|suspended|ended|replaced)|(?:has|have)\s+ended|(?:is|are|was|will be)\s+(?:over|suspended|discontinued|cancell?ed|replaced)|replaced by)"
)


def says_free(text: Column) -> Column:
    """Some phrase of the text says without condition that admission is free."""
    t = F.coalesce(text, F.lit(""))
    n = F.regexp_count(t, F.lit("(?i)" + FREE))
    parts = F.split(t, "(?i)" + FREE, -1)

    def free(k: Column) -> Column:
        before, after = F.substr(F.get(parts, k - 1), F.greatest(F.lit(1), F.length(F.get(parts, k - 1)) - 29)), F.get(parts, k)
        return ~before.rlike(FREE_DENIED_BEFORE) & ~F.substring(after, 1, 40).rlike(FREE_LIMITED) & ~F.substring(after, 1, 70).rlike(FREE_DENIED_AFTER)

    return F.when(n > 0, F.exists(F.sequence(F.lit(1), n), free)).otherwise(F.lit(False))


def is_free(cost: Column, flag: Column, description: Column) -> Column:
    """A stated amount is not free; 'free', the source's flag, or a text without a stated cost can say so."""
    c = F.coalesce(present(cost), F.lit(""))
    return first_reason([("no", c.rlike(r"\$\s*(?:0*[1-9]\d*|0*\.\d*[1-9]\d*)")), ("yes", c.rlike(r"(?i)^free\.?$") | F.coalesce(flag, F.lit(False)) | (blank(cost) & says_free(description)))], "no") == "yes"


def admission(lines: Column) -> Column:
    """struct(is_free, price_from) of the lines about admission."""
    t = F.trim(F.array_join(lines, " "))
    free = t.rlike("(?i)free")
    return F.struct(free.alias("is_free"), F.when(~free, F.regexp_extract(t, r"(\d+(?:\.\d{1,2})?)", 1).try_cast("double")).alias("price_from"))


def least_paid(cents: Column) -> Column:
    """Dollars of the cheapest tier that costs something; 0 where none does, null where none is priced."""
    priced = F.filter(cents, lambda x: x >= 0)
    return F.when(F.size(priced) > 0, F.round(F.coalesce(F.array_min(F.filter(priced, lambda x: x > 0)), F.lit(0)) / 100.0, 2))


def best_time(times: Column) -> Column:
    """Of struct(time, score, at): the highest score, then the latest place."""
    return F.array_max(F.transform(times, lambda x: F.struct(x["score"].alias("score"), x["at"].alias("at"), x["time"].alias("time"))))["time"]


def epoch_day(text: Column) -> Column:
    return F.unix_date(F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d{4}-\d{2}-\d{2})$", 1).try_cast("date"))


def rotated(items: Column, seed: Column) -> Column:
    """The list from place seed on, then what stands before it."""
    n = F.size(items)
    k = F.pmod(seed, F.greatest(n, F.lit(1))).cast("int")
    return F.when(n > 0, F.concat(F.slice(items, k + 1, n), F.slice(items, F.lit(1), k))).otherwise(items)


def weekly(anchor: Column, horizon: int) -> Column:
    """Days a week apart from an anchor for so many days."""
    return F.sequence(anchor, F.date_add(anchor, horizon), F.expr("INTERVAL 7 DAYS"))

