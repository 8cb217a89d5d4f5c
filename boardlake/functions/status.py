"""Answers that depend on a listing's state and on schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import days_between

GONE_DAYS = 30


def page_status(exists: Column, alias_of: Column, closed_at: Column, as_of: Column) -> Column:
    """404 for no row, 301 for an alias, 410 for one closed more than 30 days ago, else 200."""
    return F.when(~exists, 404).when(alias_of.isNotNull(), 301).when(days_between(as_of, closed_at) > GONE_DAYS, 410).otherwise(200)


def digest_due(cadence: Column, since: Column, as_of: Column, at: Column, zone: Column, day: Column) -> Column:
    """Whether a digest is due: an instant one always, else if the last is older than the latest scheduled local moment.

    A missing time is 08:00, a missing zone UTC, a missing weekday Monday (0).
    """
    zone = F.coalesce(zone, F.lit("UTC"))
    local = F.convert_timezone(F.lit("UTC"), zone, as_of.cast("timestamp_ntz"))
    clock = F.coalesce(F.regexp_extract(at, r"^([01]\d|2[0-3]):[0-5]\d$", 0), F.lit(""))
    hours = F.when(clock == "", F.lit("08:00")).otherwise(clock)
    today = F.concat(F.date_format(local, "yyyy-MM-dd "), hours, F.lit(":00")).cast("timestamp_ntz")
    daily = F.when(today > local, today - F.expr("INTERVAL 1 DAY")).otherwise(today)
    back = F.pmod(F.weekday(daily) - F.coalesce(day, F.lit(0)), F.lit(7))
    moment = F.when(cadence == "weekly", daily - F.make_dt_interval(back)).otherwise(daily)
    utc = F.convert_timezone(zone, F.lit("UTC"), moment)
    return (cadence == "instant") | since.isNull() | (since.cast("timestamp_ntz") < utc)
