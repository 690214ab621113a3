"""Date semantics, clocks and recurrence. Every function takes `today` or `now` as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Detroit"
#: Most listed days, the hour evening starts, days of grace of a new past row, recheck days by days to the event.
MAX_DAYS, EVENING_HOUR, GRACE_DAYS = 60, 17, 1
RECHECK = ((3, 1), (14, 2), (45, 7))


def iso_date(text: Column) -> Column:
    """A real calendar date written yyyy-MM-dd, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def occurrences(dates: Column) -> Column:
    """Known dates, once each, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(dates, F.array().cast("array<date>")), lambda d: d.isNotNull())))


def last_day(start: Column, end: Column) -> Column:
    return F.when(end > start, end).otherwise(start)


def clock_minutes(text: Column) -> Column:
    """Minutes of the day of every time like 7 PM or 7:30 pm, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\d{1,2}(?::\d{2})?\s*[ap]\.?m"), F.lit(0))

    def minutes(t: Column) -> Column:
        hour = F.regexp_extract(t, r"^(\d{1,2})", 1).cast("int") % 12 + F.when(t.rlike(r"(?i)p\.?m$"), 12).otherwise(0)
        return hour * 60 + F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, r":(\d{2})", 1), F.lit("")), F.lit("99")).cast("int"), F.lit(0))

    return F.transform(found, minutes)


def overnight(start: Column, end: Column, time: Column, all_day: Column) -> Column:
    """One night that ends on the next morning."""
    m = clock_minutes(time)
    return F.coalesce((end == F.date_add(start, 1)) & ~F.coalesce(all_day, F.lit(False)) & (F.size(m) >= 2) & (F.element_at(m, -1) < F.element_at(m, 1)), F.lit(False))


def schedule_state(semantics: Column, start: Column, end: Column, dates: Column, night: Column) -> Column:
    """confirmed, ongoing or unverified: an unclassified range of several days is open on no day for certain."""
    several = F.coalesce(end > start, F.lit(False)) & ~night
    return (
        F.when(semantics == "single", "confirmed").when(semantics == "continuous", "ongoing")
        .when(semantics == "recurring", F.when(F.size(occurrences(dates)) > 0, "confirmed").otherwise("unverified"))
        .when(several, "unverified").otherwise("confirmed")
    )


def explicit_dates(state: Column, semantics: Column, start: Column, dates: Column) -> Column:
    """The days one can attend; null where the whole range is open, empty where none is certain."""
    none = F.array().cast("array<date>")
    return (
        F.when(state == "ongoing", F.lit(None).cast("array<date>")).when(state == "unverified", none)
        .when(F.coalesce(semantics == "recurring", F.lit(False)), occurrences(dates)).when(start.isNull(), none).otherwise(F.array(start))
    )


def active_on(explicit: Column, start: Column, end: Column, day: Column) -> Column:
    return F.coalesce(F.when(explicit.isNotNull(), F.array_contains(explicit, day)).otherwise(day.between(start, last_day(start, end))), F.lit(False))


def availability(state: Column, explicit: Column, start: Column, end: Column, day: Column) -> Column:
    inside = F.coalesce(day.between(start, last_day(start, end)), F.lit(False))
    return F.when(active_on(explicit, start, end, day), F.when(state == "ongoing", "ongoing").otherwise("confirmed")).when((state == "unverified") & inside, "unverified")


def upcoming(state: Column, semantics: Column, start: Column, end: Column, dates: Column, today: Column) -> Column:
    recurring = F.coalesce(semantics == "recurring", F.lit(False))
    return F.coalesce(
        start.isNotNull()
        & F.when((state == "confirmed") & recurring, F.array_max(occurrences(dates)) >= today).when(state == "confirmed", start >= today).otherwise(last_day(start, end) >= today),
        F.lit(False),
    )


def next_date(state: Column, explicit: Column, start: Column, end: Column, today: Column) -> Column:
    """The first day from today on that one can attend."""
    going = F.when(last_day(start, end) >= today, F.greatest(start, today))
    return F.when(state == "ongoing", going).otherwise(F.array_min(F.filter(explicit, lambda d: d >= today)))


def listed_days(explicit: Column, start: Column, end: Column, floor: Column, cap: int = MAX_DAYS) -> Column:
    """At most cap days to list an event on, from floor on where that falls inside its range."""
    first = F.when((floor > start) & (floor <= end), floor).otherwise(start)
    whole = F.when(end > start, F.slice(F.sequence(first, end), 1, cap)).otherwise(F.array(start))
    return F.when(explicit.isNotNull(), F.slice(F.filter(explicit, lambda d: d >= floor), 1, cap)).when(start.isNotNull(), whole).otherwise(F.array().cast("array<date>"))


def review_reason(state: Column, semantics: Column, start: Column, end: Column, dates: Column, time: Column, all_day: Column) -> Column:
    known = occurrences(dates)
    recurring = F.coalesce(semantics == "recurring", F.lit(False))
    outside = F.exists(known, lambda d: (d < start) | (d > last_day(start, end)))
    timed = semantics.isNull() & ~F.coalesce(all_day, F.lit(False)) & (F.coalesce(time, F.lit("")) != "")
    return (
        F.when(recurring & (F.size(known) == 0), "recurring-without-dates").when(recurring & outside, "occurrence-outside-range")
        .when((state == "unverified") & timed, "unclassified-multiday-clock-time").when(state == "unverified", "unverified-multiday-schedule")
    )


def local_clock(ts: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """Local date and minutes of the day of an instant in UTC."""
    t = F.from_utc_timestamp(ts, zone)
    return F.to_date(t), F.hour(t) * 60 + F.minute(t)


def wall_to_utc(day: Column, minutes: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(F.timestamp_add("MINUTE", minutes, day.cast("timestamp")), zone)


def time_range(text: Column) -> Column:
    """struct(start, end) in minutes of the first two times of a text; a time without AM or PM borrows the half of the day of the next that has it."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\bnoon\b|\bmidnight\b|\b\d{1,2}:\d{2}\s*(?:AM|PM)?"), F.lit(0))
    plain = F.transform(
        parts,
        lambda t: F.struct(
            F.when(F.lower(t) == "noon", 720).when(F.lower(t) == "midnight", 0)
            .otherwise(F.try_element_at(F.split(t, ":"), F.lit(1)).try_cast("int") % 12 * 60 + F.regexp_extract(t, r":(\d{2})", 1).try_cast("int")).alias("m"),
            F.when(t.rlike(r"(?i)pm$|noon"), 720).when(t.rlike(r"(?i)am$|midnight"), 0).alias("half"),
            t.rlike(r"(?i)noon|midnight").alias("word"),
        ),
    )
    sized = F.transform(plain, lambda x, i: F.struct(x["m"].alias("m"), x["word"].alias("word"), F.coalesce(x["half"], F.try_element_at(F.filter(F.slice(plain, i + 1, F.size(plain)), lambda y: y["half"].isNotNull()), F.lit(1))["half"]).alias("half")))
    whole = F.transform(F.filter(sized, lambda x: x["half"].isNotNull()), lambda x: x["m"] + F.when(x["word"], 0).otherwise(x["half"]))
    return F.struct(F.try_element_at(whole, F.lit(1)).alias("start"), F.try_element_at(whole, F.lit(2)).alias("end"))


def evening(text: Column) -> Column:
    return F.coalesce(F.coalesce(text, F.lit("")).rlike("(?i)evening") | (time_range(text)["start"] >= EVENING_HOUR * 60), F.lit(False))


def ended(text: Column, minutes: Column) -> Column:
    """A stated end after its start that lies before the clock."""
    r = time_range(text)
    return F.coalesce((r["end"] > r["start"]) & (r["end"] < minutes), F.lit(False))


def nth_weekday(month: Column, day: str, n: int) -> Column:
    """The n-th weekday (such as 'Sat') of the month a date is in; n below 1 is the last one."""
    if n < 1:
        return F.next_day(F.date_sub(F.last_day(month), 7), day)
    d = F.date_add(F.next_day(F.date_sub(F.trunc(month, "MM"), 1), day), 7 * (n - 1))
    return F.when(F.trunc(d, "MM") == F.trunc(month, "MM"), d)


def all_day_last(start: Column, end: Column) -> Column:
    """Last day of an all-day span whose end is exclusive; null for a single day."""
    d = F.date_sub(end, 1)
    return F.when(d > start, d)


def infer_year(month: Column, day: Column, published: Column, slack: int = 30) -> Column:
    """A date without a year: in the year of publication, or the next one if that lies more than slack days back."""
    here = F.try_make_date(F.year(published), month, day) if hasattr(F, "try_make_date") else F.make_date(F.year(published), month, day)
    return F.when(here < F.date_sub(published, slack), F.add_months(here, 12)).otherwise(here)


def recheck_days(days: Column) -> Column:
    out = F.lit(14)
    for most, every in reversed(RECHECK):
        out = F.when(days <= most, every).otherwise(out)
    return out


def expired(start: Column, end: Column, today: Column) -> Column:
    return F.coalesce(last_day(start, end) < F.date_sub(today, GRACE_DAYS), F.lit(False))
