"""Row-level column expressions: indicators, thresholds, bins, clamps,
normalisations, cyclical encodings and small text helpers.

Everything here returns a ``Column`` built from JVM-side functions, so it
stays inside whole-stage code generation and runs unchanged on streaming
DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def indicator(cond: Column) -> Column:
    """Boolean -> 0/1 int, NULL -> 0 (pandas ``astype(int)`` of a comparison)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def equals_flag(col, value) -> Column:
    return indicator(_c(col) == F.lit(value))


def in_flag(col, values: Sequence) -> Column:
    return indicator(_c(col).isin(list(values)))


_OPS = {
    ">": lambda c, t: c > t,
    ">=": lambda c, t: c >= t,
    "<": lambda c, t: c < t,
    "<=": lambda c, t: c <= t,
    "==": lambda c, t: c == t,
    "!=": lambda c, t: c != t,
}


def threshold_flag(col, op: str, value) -> Column:
    """``(col <op> value)`` as 0/1, NULL -> 0."""
    return indicator(_OPS[op](_c(col), F.lit(value)))


def cut(col, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed binning with an open lower bound: ``(e0, e1] -> labels[0]``,
    ``(e1, e2] -> labels[1]`` ...; values outside ``(e0, e_last]`` and NULL give
    NULL. (``Bucketizer`` is left-closed, which moves every edge value.)"""
    if len(edges) != len(labels) + 1:
        raise ValueError("need len(edges) == len(labels) + 1")
    c = _c(col)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def clamp(col, lo=None, hi=None) -> Column:
    """``min(max(x, lo), hi)``; NULL stays NULL (``greatest``/``least`` would
    otherwise skip a NULL argument and return the bound)."""
    c = _c(col)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def scaled_cap(col, divisor: float, cap: float | None = 1.0) -> Column:
    """``min(x / divisor, cap)`` (``cap=None`` leaves it uncapped)."""
    v = _c(col) / F.lit(float(divisor))
    return v if cap is None else clamp(v, hi=cap)


def abnormality(col, ref: float, scale: float, direction: str = "above",
                cap: float | None = 1.0) -> Column:
    """Continuous distance beyond a reference value, ``min(max(x-ref,0)/scale, cap)``
    (``direction='below'`` uses ``ref-x``)."""
    c = _c(col)
    dist = (c - F.lit(ref)) if direction == "above" else (F.lit(ref) - c)
    v = F.greatest(dist, F.lit(0.0)) / F.lit(float(scale))
    if cap is not None:
        v = F.least(v, F.lit(float(cap)))
    # greatest / least skip NULL arguments: keep a missing value missing
    return F.when(c.isNull(), F.lit(None)).otherwise(v)


def cyclical(col, period: float) -> tuple[Column, Column]:
    """``(sin(2*pi*x/period), cos(2*pi*x/period))``."""
    ang = F.lit(2 * math.pi) * _c(col) / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


def weekday_monday0(ts) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def weekend_flag(ts) -> Column:
    return indicator(F.weekday(_c(ts)) >= 5)


def season_flag(ts, months: Sequence[int] = (12, 1, 2)) -> Column:
    return in_flag(F.month(_c(ts)), months)


def last_token(col, sep: str = " ") -> Column:
    """Last whitespace-separated token (``s.split()[-1]``), e.g. a dose unit."""
    parts = F.split(F.trim(_c(col)), "\\s+" if sep == " " else sep)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def zero_pad(col, width: int) -> Column:
    """Left-pad an integer id with zeros (``f'{n:0{width}d}'``)."""
    return F.lpad(_c(col).cast("string"), width, "0")


def first_match_tag(col, rules: Sequence[tuple[str, str]], default=None) -> Column:
    """Ordered first-match tagging: ``rules`` is ``[(substring, tag), ...]``;
    the first rule whose substring occurs in ``col`` wins."""
    c = _c(col)
    out = None
    for needle, tag in rules:
        cond = c.contains(needle)
        out = F.when(cond, F.lit(tag)) if out is None else out.when(cond, F.lit(tag))
    return out.otherwise(F.lit(default)) if default is not None else out


def safe_ratio(num, den, default=0.0) -> Column:
    """``num / den`` with a zero or NULL denominator mapped to ``default``."""
    return F.coalesce(F.try_divide(_c(num), _c(den)), F.lit(default))
