"""Normalisation shared by every operator: names, clock values, numbers, calendar days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A netflow clock below this is in seconds, a log clock above it is in milliseconds.
CLOCK_SWITCH = 100_000_000_000
DAY_S = 86_400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name(c: Column | str) -> Column:
    """Lower case without surrounding spaces; blank becomes null."""
    return F.nullif(F.lower(F.trim(col(c))), F.lit(""))


def flow_ms(c: Column | str) -> Column:
    """Milliseconds since the epoch of a flow clock; null, 0 and negative mean no time."""
    c = col(c)
    return F.when(c >= CLOCK_SWITCH, c).when(c >= 1, c * 1000)


def log_s(c: Column | str) -> Column:
    """Seconds since the epoch of a log clock; values in milliseconds lose their fraction."""
    c = col(c)
    return F.when(c > CLOCK_SWITCH, F.floor(c / 1000)).otherwise(c)


def day_of_s(seconds: Column | str) -> Column:
    """Days since 1970-01-01 (UTC) of epoch seconds."""
    return F.floor(col(seconds) / DAY_S).cast("int")


def day_of_ms(ms: Column | str) -> Column:
    return F.floor(col(ms) / (DAY_S * 1000)).cast("int")


def yyyymmdd(day: Column | str) -> Column:
    """A day number as the integer yyyymmdd."""
    d = F.date_from_unix_date(col(day))
    return (F.year(d) * 10000 + F.month(d) * 100 + F.day(d)).cast("bigint")


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def count_of(c: Column | str) -> Column:
    """A count column: null and negative read as 0."""
    return F.greatest(F.coalesce(col(c), F.lit(0)), F.lit(0)).cast("bigint")


def div(a: Column | str, b: Column | str) -> Column:
    """Quotient as double; null where the divisor is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))
