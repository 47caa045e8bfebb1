"""Time arithmetic on TIMESTAMP_NTZ columns.

All differences are computed with ``timestampdiff`` on NTZ values, which
never consults the session time zone (a cast to TIMESTAMP would shift by an
hour across daylight-saving changes).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
DAYS_PER_YEAR = 365.25

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def elapsed_micros(start, end) -> Column:
    """``end - start`` in microseconds (bigint)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def elapsed_days(start, end) -> Column:
    """Whole days of ``end - start``, floored: 23:00 -> 01:00 next day is 0,
    a difference of -2 hours is -1 (not the calendar difference of
    ``datediff``)."""
    return F.floor(elapsed_micros(start, end) / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def fractional_days(start, end, digits: int = 2) -> Column:
    """Elapsed days as a double rounded to ``digits`` (stay-length style)."""
    return F.round(elapsed_micros(start, end) / F.lit(float(MICROS_PER_DAY)), digits)


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of an NTZ timestamp (time-zone free)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _c(ts))


def add_days(ts, n) -> Column:
    """``ts + n`` days for an integer column / literal ``n``."""
    n_col = _c(n) if not isinstance(n, int) else F.lit(n)
    return _c(ts) + F.make_dt_interval(days=n_col.cast("int"))


def years_between(start, end) -> Column:
    """Whole elapsed days / 365.25 (age at an event)."""
    return elapsed_days(start, end) / F.lit(DAYS_PER_YEAR)


def parse_timestamp(col, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text -> TIMESTAMP_NTZ; unparsable text becomes NULL (like ``NaT``)."""
    return F.try_to_timestamp(_c(col), F.lit(fmt)).cast("timestamp_ntz")
