"""Column functions on timestamps and durations.  All clocks are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_START_HOUR = 9
DAY_END_HOUR = 17

_MICROS_PER_HOUR = 3_600_000_000
_MICROS_PER_DAY = 24 * _MICROS_PER_HOUR


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with their fraction."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(_MICROS_PER_HOUR))


def iso_instant(text: Column) -> Column:
    """ISO time, with ``Z`` or an offset, to a timestamp; null if it does not parse."""
    return F.try_to_timestamp(text)


def created_hour(ts: Column) -> Column:
    return F.hour(ts)


def created_day(ts: Column) -> Column:
    """Weekday with Monday as 0."""
    return F.weekday(ts)


def hour_in_business_day(hour: Column) -> Column:
    """The whole hour that starts at 17:00 still counts as a business hour."""
    return hour.between(DAY_START_HOUR, DAY_END_HOUR)


def is_weekend_day(day: Column) -> Column:
    return day.isin(5, 6)


def is_business_hour(ts: Column) -> Column:
    return (F.weekday(ts) < 5) & hour_in_business_day(F.hour(ts))


def business_hours_between(start: Column, end: Column) -> Column:
    """Hours from 9:00 to 17:00, Monday to Friday, between two instants.

    The first day counts from ``start`` and only if ``start`` itself lies in
    business hours; every later weekday counts from 9:00 to 17:00 or ``end``.
    The weekdays between are counted by arithmetic on day numbers, so the cost
    does not grow with the span.
    """
    first, last = F.unix_date(F.to_date(start)), F.unix_date(F.to_date(end))
    start_clock = F.unix_micros(start) - first.cast("long") * F.lit(_MICROS_PER_DAY)
    end_clock = F.unix_micros(end) - last.cast("long") * F.lit(_MICROS_PER_DAY)
    opening = F.lit(DAY_START_HOUR * _MICROS_PER_HOUR)
    closing = F.lit(DAY_END_HOUR * _MICROS_PER_HOUR)
    full_day = closing - opening

    def weekdays_before(day: Column) -> Column:
        # Day 0 of the count is a Monday, three days before 1970-01-01.
        monday_based = day + F.lit(3)
        return F.floor(monday_based / F.lit(7)) * F.lit(5) + F.least(
            F.pmod(monday_based, F.lit(7)), F.lit(5)
        )

    first_day_end = F.when(last > first, closing).otherwise(F.least(closing, end_clock))
    first_day = F.when(
        is_business_hour(start), F.greatest(F.lit(0), first_day_end - start_clock)
    ).otherwise(F.lit(0))
    between = F.greatest(
        F.lit(0), weekdays_before(last) - weekdays_before(first + F.lit(1))
    ) * full_day
    last_day = F.when(
        (last > first) & (F.weekday(end) < 5),
        F.greatest(F.lit(0), F.least(closing, end_clock) - opening),
    ).otherwise(F.lit(0))
    hours = (first_day + between + last_day) / F.lit(float(_MICROS_PER_HOUR))
    return F.when(start >= end, F.lit(0.0)).otherwise(hours)


def one_decimal(x: Column) -> Column:
    """Text with one decimal, rounding the binary value and exact ties to even.

    ``format_string`` rounds the shortest decimal text half up instead, which
    turns 0.25 into 0.3.
    """
    scale = 1 << 58
    size = F.abs(x)
    whole = F.floor(size)
    scaled = ((size - whole) * F.lit(float(scale))).cast("long") * F.lit(10)
    below = F.floor(scaled / F.lit(float(scale))).cast("long")
    # The quotient may round up to the next integer; the remainder corrects it.
    below = F.when(scaled - below * F.lit(scale) < 0, below - 1).otherwise(below)
    rest = scaled - below * F.lit(scale)
    tenths = whole.cast("long") * F.lit(10) + below
    half = F.lit(scale // 2)
    up = (rest > half) | ((rest == half) & (F.pmod(tenths, F.lit(2)) == 1))
    tenths = tenths + F.when(up, 1).otherwise(0)
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(
        sign,
        F.floor(tenths / F.lit(10)).cast("string"),
        F.lit("."),
        F.pmod(tenths, F.lit(10)).cast("string"),
    )


def format_duration(hours: Column) -> Column:
    """``12 minutes`` (truncated), ``3.5 hours`` or ``2.0 days``."""
    return (
        F.when(hours < 1, F.concat((hours * 60).cast("long").cast("string"), F.lit(" minutes")))
        .when(hours < 24, F.concat(one_decimal(hours), F.lit(" hours")))
        .when(hours.isNotNull(), F.concat(one_decimal(hours / 24), F.lit(" days")))
    )


def duration_band(hours: Column) -> Column:
    """The three bands of ``format_duration`` as a category."""
    return (
        F.when(hours < 1, "under 1 hour")
        .when(hours < 24, "under 1 day")
        .when(hours.isNotNull(), "days")
    )


def parse_duration(text: Column) -> Column:
    """Seconds of a text such as ``1h30m45s``: the first number before each unit,
    in any case; null when nothing or zero is found."""

    def part(unit: str, seconds: int) -> Column:
        digits = F.nullif(F.regexp_extract(text, rf"(?i)(\d+){unit}", 1), F.lit(""))
        return F.coalesce(digits.cast("double"), F.lit(0.0)) * F.lit(float(seconds))

    total = part("h", 3600) + part("m", 60) + part("s", 1)
    return F.when(total > 0, total)
