"""Calendar logic in Indian Standard Time on UTC wall times without zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ist(utc: Column) -> Column:
    return utc + F.expr("INTERVAL 330 MINUTES")


def ist_day(utc: Column) -> Column:
    return to_ist(utc).cast("date")


def ist_week(utc: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", to_ist(utc)).cast("date")


def ist_month(utc: Column) -> Column:
    return F.trunc(ist_day(utc), "month")


def iso_week_key(utc: Column) -> Column:
    """`2026-W53`."""
    day = ist_day(utc)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def minute_of_day(utc: Column) -> Column:
    ist = to_ist(utc)
    return F.hour(ist) * 60 + F.minute(ist)


def in_quiet_hours(utc: Column, start_minute: Column, end_minute: Column) -> Column:
    """Start included, end not; a start after the end wraps past midnight."""
    at = minute_of_day(utc)
    return F.when(start_minute <= end_minute, (at >= start_minute) & (at < end_minute)).otherwise((at >= start_minute) | (at < end_minute))


def recency(age_days: Column) -> Column:
    """Halves every 60 days; ages below 0 count as 0."""
    return F.pow(F.lit(0.5), F.greatest(age_days.cast("double"), F.lit(0.0)) / 60)
