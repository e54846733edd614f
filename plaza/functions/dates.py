"""Dates, clocks, hours and windows. Every clock is a parameter; instants are UTC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaza.functions.text import either

ZONE = "America/Halifax"
DAY_MS = 86_400_000
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def moment(clock) -> Column:
    """A clock given as text or column."""
    return F.to_timestamp_ntz(F.lit(clock)) if isinstance(clock, str) else clock


def local(column, zone: str = ZONE) -> Column:
    """Wall clock in a zone of a UTC instant without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), either(column).cast("timestamp_ntz"))


def utc(column, zone: str = ZONE) -> Column:
    """UTC instant of a wall clock in a zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), either(column).cast("timestamp_ntz"))


def local_date(column, all_day=None, zone: str = ZONE) -> Column:
    """Local date of an instant; an all-day value at UTC midnight keeps its UTC date."""
    plain = F.to_date(local(column, zone))
    if all_day is None:
        return plain
    midnight = F.date_format(either(column), "HH:mm:ss") == "00:00:00"
    return F.when(either(all_day) & midnight, F.to_date(either(column))).otherwise(plain)


def millis(column) -> Column:
    return F.unix_micros(either(column).cast("timestamp")) / 1000


def age_ms(column, as_of) -> Column:
    return millis(moment(as_of)) - millis(column)


def age_days(column, as_of) -> Column:
    """Whole days; null for a missing or a future clock."""
    age = age_ms(column, as_of)
    return F.when(age >= 0, F.floor(age / DAY_MS))


def publication_state(column, as_of) -> Column:
    """missing, future or valid; no skew is forgiven."""
    age = age_ms(column, as_of)
    return F.when(age.isNull(), "missing").when(age < 0, "future").otherwise("valid")


def is_recent(column, as_of, days: int) -> Column:
    age = age_ms(column, as_of)
    return F.coalesce((age >= 0) & (age <= days * DAY_MS), F.lit(False))


def freshness_bucket(column, as_of, skew_hours: int = 0) -> Column:
    """under_7, 7_30, 30_90, over_90 or unknown; a future clock within the skew counts as new."""
    days = age_ms(column, as_of) / DAY_MS
    return F.when(days.isNull() | (days < -skew_hours / 24), "unknown").when(days < 7, "under_7").when(days <= 30, "7_30").when(days <= 90, "30_90").otherwise("over_90")


def freshness_state(column, as_of, target_hours) -> Column:
    """fresh up to the target, warn up to twice, then stale; unknown without a clock or over an hour ahead."""
    hours = age_ms(column, as_of) / 3_600_000
    target = either(target_hours) if isinstance(target_hours, (str, Column)) else F.lit(target_hours)
    return F.when(hours.isNull() | (hours < -1), "unknown").when(hours <= target, "fresh").when(hours <= 2 * target, "warn").otherwise("stale")


def start_instant(date) -> Column:
    """An all-day start stands at noon."""
    return either(date).cast("timestamp_ntz") + F.expr("interval 12 hours")


def end_instant(end, all_day) -> Column:
    """An all-day end lasts to 08:00 of the next day."""
    day = F.to_date(either(end)).cast("timestamp_ntz")
    return F.when(either(all_day), day + F.expr("interval 32 hours")).otherwise(either(end))


def inclusive_days(start, end) -> Column:
    return F.greatest(F.lit(1), F.datediff(either(end), either(start)) + 1)


def duration_kind(start, end, longest: int = 7) -> Column:
    return F.when(inclusive_days(start, end) > longest, "long").otherwise("short")


def time_kind(column, all_day=None, zone: str = ZONE) -> Column:
    hour = F.hour(local(column, zone))
    kind = F.when(hour < 12, "morning").when(hour < 17, "afternoon").otherwise("evening")
    return kind if all_day is None else F.when(either(all_day), "all_day").otherwise(kind)


def weekend_of(day: Column) -> tuple[Column, Column]:
    """Friday to Sunday of the weekend that holds the day, or of the next."""
    w = F.weekday(day)  # 0 is Monday
    friday = F.date_add(day, 4 - w)  # Saturday and Sunday look back
    return friday, F.date_add(friday, 2)


def window_bounds(window, day: Column) -> tuple[Column, Column]:
    """First and last day of today, weekend, or so many days on; the last day counts."""
    if window == "today":
        return day, day
    if window == "weekend":
        return weekend_of(day)
    return day, F.date_add(day, int(window))


def overlaps(start: Column, end: Column, first: Column, last: Column) -> Column:
    return (end >= first) & (start <= last)


def tonight(column, today: Column, zone: str = ZONE) -> Column:
    """From 17:00 today to 03:00 tomorrow, local."""
    at = local(column, zone)
    day, hour = F.to_date(at), F.hour(at)
    return ((day == today) & (hour >= 17)) | ((day == F.date_add(today, 1)) & (hour < 3))


def strict_date(column) -> Column:
    """A date of the form yyyy-mm-dd that exists; else null."""
    text = either(column)
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.date_format(day, "yyyy-MM-dd") == text), day)


# English day and month names of feed dates.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def strict_instant(column) -> Column:
    """An ISO instant with Z, or an RFC 822 date in GMT whose weekday agrees; else null."""
    text = F.trim(either(column))
    iso = F.regexp_extract(text, "^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})Z$", 0)
    parts = [F.regexp_extract(text, "^(?:([A-Z][a-z]{2}), )?([0-9]{1,2}) ([A-Z][a-z]{2}) ([0-9]{4}) ([0-9]{2}:[0-9]{2}:[0-9]{2}) (?:GMT|UTC|[+]0000)$", k) for k in range(1, 6)]
    month = F.array_position(F.array(*map(F.lit, MONTHS)), parts[2])
    mail = F.concat(parts[3], F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit(" "), parts[4])
    plain = F.when(iso != "", F.concat(F.substr(iso, F.lit(1), F.lit(10)), F.lit(" "), F.substr(iso, F.lit(12), F.lit(8)))).when(parts[1] != "", mail)
    at = F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss"))
    agrees = (parts[0] == "") | (F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(at) + 1) == parts[0])
    return F.when((F.date_format(at, "yyyy-MM-dd HH:mm:ss") == plain) & agrees, at)


def has_ended(end, date_only, as_of, zone: str = ZONE) -> Column:
    """A date-only end has passed once the local day is later; an instant once the clock is."""
    return F.when(either(date_only), F.to_date(either(end)) < F.to_date(local(moment(as_of), zone))).otherwise(either(end) < moment(as_of))


def clock_24(hour: Column, minute: Column, half: Column) -> Column:
    """HH:mm of a twelve-hour clock."""
    h = hour.cast("int") % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0)
    return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(F.coalesce(F.when(minute != "", minute), F.lit("00")), 2, "0"))


def cadence(column) -> Column:
    """``Mon-Fri 3pm-6pm`` as days (a range may pass the week's end) and clocks; null if it isn't one."""
    pattern = "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)(?:-(Mon|Tue|Wed|Thu|Fri|Sat|Sun))? ([0-9]{1,2})(?::([0-9]{2}))?(am|pm)-([0-9]{1,2})(?::([0-9]{2}))?(am|pm)$"
    g = lambda k: F.regexp_extract(either(column), pattern, k)
    number = lambda name: (F.array_position(F.array(*map(F.lit, WEEKDAYS)), name) - 1).cast("int")
    first, last = number(g(1)), F.when(g(2) != "", number(g(2))).otherwise(number(g(1)))
    count = F.pmod(last - first, F.lit(7))
    days = F.transform(F.sequence(F.lit(0), count), lambda k: F.element_at(F.array(*map(F.lit, DAYS)), F.pmod(first + k, F.lit(7)) + 1))
    return F.when(g(1) != "", F.struct(days.alias("days"), clock_24(g(3), g(4), g(5)).alias("opens"), clock_24(g(6), g(7), g(8)).alias("closes")))


def minutes(clock: Column) -> Column:
    return F.split(clock, ":")[0].cast("int") * 60 + F.split(clock, ":")[1].cast("int")


def hours_state(weekly, at: Column) -> Column:
    """open, closed or unknown at a local wall clock. ``weekly`` maps day to spans (open, close); a missing day is unknown, an empty one closed.

    A span that closes at or before it opens lasts into the next day.
    """
    names = F.array(*map(F.lit, DAYS))
    now = F.hour(at) * 60 + F.minute(at)
    today = F.element_at(names, F.weekday(at) + 1)
    before = F.element_at(names, F.pmod(F.weekday(at) - 1, F.lit(7)) + 1)
    spans, carried = either(weekly)[today], either(weekly)[before]
    late = lambda s: minutes(s["close"]) <= minutes(s["open"])
    here = F.exists(spans, lambda s: (now >= minutes(s["open"])) & (late(s) | (now < minutes(s["close"]))))
    over = F.coalesce(F.exists(carried, lambda s: late(s) & (now < minutes(s["close"]))), F.lit(False))
    return F.when(here | over, "open").when(spans.isNull() | carried.isNull(), "unknown").otherwise("closed")


def retry_not_before(value, observed) -> Column:
    """Retry-After in seconds or as a date, as an instant."""
    text = F.trim(either(value))
    seconds = F.when(text.rlike("^[0-9]{1,9}$"), text).cast("int")
    later = F.timestamp_add("SECOND", seconds, either(observed).cast("timestamp_ntz"))
    return F.coalesce(later, strict_instant(text).cast("timestamp_ntz"))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
