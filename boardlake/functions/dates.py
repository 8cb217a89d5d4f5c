"""Dates of boards and clocks of listings. Every function of time takes its clock as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_A_DAY = 86_400_000_000

# The formats of written-out dates.
WRITTEN_FORMATS = ["dd/MM/yyyy", "MMMM d, yyyy"]


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days from earlier to later."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(float(MICROS_A_DAY))


def normalized(text: Column) -> Column:
    """UTC time of an ISO text, of epoch milliseconds in digits, or of a text that ends in ' UTC'; else null."""
    s = F.trim(text)
    digits = s.rlike("^[0-9]+$")
    millis = F.timestamp_millis(F.try_cast(s, "bigint")) if hasattr(F, "try_cast") else F.timestamp_millis(s.try_cast("bigint"))
    plain = F.regexp_replace(s, " UTC$", "Z")
    return F.when(digits, millis).when(F.length(s) > 0, plain.try_cast("timestamp"))


def relative(text: Column, as_of: Column) -> Column:
    """'Posted N Days Ago' and 'Posted Yesterday' before the clock; 'Posted Today' says too little and is null."""
    s = F.lower(F.trim(text))
    n = F.regexp_extract(s, r"^posted (\d+)\+?\s*days? ago", 1).try_cast("int")
    days = F.when(s == "posted yesterday", 1).otherwise(n)
    return F.when(days.isNotNull(), as_of - F.make_dt_interval(days))


def local_to_utc(text: Column, zone: str = "Asia/Jerusalem") -> Column:
    """A bare ISO text read as the zone's clock; one with an offset keeps its own."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    bare = F.convert_timezone(F.lit(zone), F.lit("UTC"), text.try_cast("timestamp_ntz")).cast("timestamp")
    return F.when(zoned, text.try_cast("timestamp")).otherwise(bare)


def written(text: Column) -> Column:
    """The date of DD/MM/YYYY or 'Month D, YYYY'; else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in WRITTEN_FORMATS]).cast("date")


def days_open(first_seen: Column, closed_at: Column, as_of: Column) -> Column:
    """Days from the first sight to the close, or to the clock, to two places."""
    return F.round(days_between(F.coalesce(closed_at, as_of), first_seen), 2)


def week_key(ts: Column) -> Column:
    """Year and week, weeks beginning on Monday, the days before the first Monday in week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def age_phrase(ts: Column, as_of: Column) -> Column:
    """'today', 'N days ago' under two months, else 'N months ago'."""
    n = F.floor(days_between(as_of, ts)).cast("int")
    months = F.floor(n / 30).cast("int")
    return F.when(ts.isNull(), None).when(n < 1, "today").when(n == 1, "1 day ago").when(n < 60, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.concat(months.cast("string"), F.lit(" months ago")))


def w3c(ts: Column) -> Column:
    """The time in UTC as sitemaps write it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
