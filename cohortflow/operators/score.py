"""Rule-based risk scoring: additive points, tiers, reason codes and
recommendation lookup. Pure column expressions (streaming-safe) except the
lookup, which joins a bounded literal table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tier names and cut-offs of the reference's risk form.
TIER_CUTS = [(0.7, "High Risk"), (0.4, "Medium Risk")]
TIER_DEFAULT = "Low Risk"
NO_FACTOR = "No major risk factors identified"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def banded_points(col, bands: Sequence[tuple[float, float]]) -> Column:
    """``bands = [(threshold, points), ...]`` checked in order with ``>``:
    the first threshold exceeded gives its points, otherwise 0."""
    c = _c(col)
    out = None
    for thr, pts in bands:
        out = (F.when(c > F.lit(thr), F.lit(pts)) if out is None
               else out.when(c > F.lit(thr), F.lit(pts)))
    return out.otherwise(F.lit(0))


def additive_score(banded: Mapping[str, Sequence[tuple[float, float]]],
                   counts: Sequence[str] = (), flags: Mapping[str, float] | None = None,
                   divisor: float = 10.0, cap: float = 0.95) -> Column:
    """``min(points / divisor, cap)``: banded points per column, raw count
    columns added as points, and 0/1 flag columns times their points."""
    pts = F.lit(0)
    for col, bands in banded.items():
        pts = pts + banded_points(col, bands)
    for col in counts:
        pts = pts + F.coalesce(_c(col), F.lit(0))
    for col, p in (flags or {}).items():
        pts = pts + F.when(_c(col).cast("boolean"), F.lit(p)).otherwise(F.lit(0))
    return F.least(pts / F.lit(float(divisor)), F.lit(float(cap)))


def risk_tier(score, cuts: Sequence[tuple[float, str]] = TIER_CUTS,
              default: str = TIER_DEFAULT) -> Column:
    """First cut-off with ``score >= cut`` gives the tier."""
    s = _c(score)
    out = None
    for cut, name in cuts:
        out = F.when(s >= F.lit(cut), F.lit(name)) if out is None else out.when(s >= F.lit(cut), F.lit(name))
    return out.otherwise(F.lit(default))


def reason_codes(rules: Sequence[tuple[Column, str]], default: str = NO_FACTOR) -> Column:
    """Array of the texts whose condition holds, in rule order; a one-element
    default when none holds."""
    arr = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]))
    return F.when(F.size(arr) == 0, F.array(F.lit(default))).otherwise(arr)


def lookup_table(spark: SparkSession, mapping: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A literal ``(key, value)`` table from a Python mapping: its size is the
    mapping's length, so broadcasting it is always safe."""
    return spark.createDataFrame(list(mapping.items()), f"{key} string, {value} string")


def attach_lookup(df: DataFrame, col: str, table: DataFrame, key: str, value: str,
                  default: str | None = None, out: str | None = None,
                  bounded: bool = False) -> DataFrame:
    """Left join to a code -> text table with a default for unknown codes.
    ``bounded=True`` broadcasts the table: say so only of literal tables
    (:func:`lookup_table`); otherwise the optimizer picks the join by size."""
    t = table.withColumnRenamed(key, "_lk_key").withColumnRenamed(value, "_lk_val")
    t = F.broadcast(t) if bounded else t
    res = df.join(t, df[col] == t["_lk_key"], "left")
    val = F.col("_lk_val") if default is None else F.coalesce(F.col("_lk_val"), F.lit(default))
    return res.withColumn(out or value, val).drop("_lk_key", "_lk_val")
