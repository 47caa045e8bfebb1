"""Exact and approximate quantiles without funnelling a column into one task.

Spark's exact ``percentile`` aggregate merges a map of every distinct value
into a single final buffer, which does not scale to a continuous column of
billions of rows. :func:`exact_quantiles` instead narrows a bracket around
each target rank with distributed histogram passes: every pass is one
``groupBy(target, bin).count()`` over all columns and ranks (map-side combined,
output at most ``targets x bins`` rows), the driver only reads those counts, and once a
bracket holds at most ``final_rows`` rows (or a single distinct value) those
rows are fetched and the exact order statistic is taken. Results use linear
interpolation between the two closest ranks (NumPy / pandas default,
DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def approx_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                     accuracy: int = 10000) -> list[float | None]:
    """``percentile_approx`` (mergeable sketch, bounded memory per task)."""
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), list(probs), accuracy)).first()
    return list(row[0]) if row[0] is not None else [None] * len(probs)


# Brackets are cut by sign first, then evenly in the logarithm of the magnitude
# while they span more than a few powers of two, then evenly: so every double
# is reached in a small number of passes, whatever the range of the column.
_WIDE = 4.0
_LEAST = 5e-324


def _bin(x, lo: float, hi: float, bins: int):
    """Bin of a value of ``[lo, hi]``: never decreasing, and not the same for both ends."""
    if lo < 0 < hi or math.isinf(lo) or math.isinf(hi) or lo == 0 or hi == 0:
        return (F.when(x == float("-inf"), 0).when(x < 0, 1).when(x == 0, 2)
                .when(x < float("inf"), 3).otherwise(4))
    near, far = sorted((abs(lo), abs(hi)))
    if far / near > _WIDE:
        width = (math.log2(far) - math.log2(near)) / bins
        at = F.floor((F.log2(F.abs(x)) - F.lit(math.log2(near))) / F.lit(width))
        at = at if lo > 0 else F.lit(bins) - at
    else:
        at = F.floor((x - F.lit(lo)) / F.lit(max((hi - lo) / bins, _LEAST)))
    return F.greatest(F.lit(0), F.least(at, F.lit(bins))).cast("int")


def _order_stats(data: DataFrame, bounds: dict, ranks: dict, bins: int, final_rows: int) -> dict:
    """Order statistics of several columns at once: ``{(column, rank): value}``.
    Each pass narrows the brackets of all open ranks of all columns."""
    state = {(c, r): (*bounds[c], 0) for c, rs in ranks.items() for r in set(rs)}
    found: dict = {}
    while len(found) < len(state):
        open_ = {k: s for k, s in state.items() if k not in found}
        brackets = sorted({(c, s[0], s[1]) for (c, _), s in open_.items()})
        cases = []
        for i, (c, lo, hi) in enumerate(brackets):
            x = F.col(f"_q_{c}")
            cases.append(F.when(x.between(F.lit(lo), F.lit(hi)), F.struct(
                F.lit(i).alias("k"), _bin(x, lo, hi, bins).alias("b"), x.alias("x"))))
        counts = (data.select(F.explode(F.array_compact(F.array(*cases))).alias("t"))
                  .groupBy("t.k", "t.b").agg(F.count(F.lit(1)).alias("n"), F.min("t.x").alias("mn"),
                                             F.max("t.x").alias("mx")).collect())
        by_bracket: dict[int, list] = {}
        for row in sorted(counts, key=lambda z: z["b"]):
            by_bracket.setdefault(row["k"], []).append(row)
        fetch: dict = {}
        for (c, r), (lo, hi, below) in open_.items():
            for row in by_bracket[brackets.index((c, lo, hi))]:
                if below + row["n"] > r:
                    state[c, r] = (row["mn"], row["mx"], below)
                    if row["mn"] == row["mx"]:
                        found[c, r] = row["mn"]
                    elif row["n"] <= final_rows:
                        fetch.setdefault((c, row["mn"], row["mx"], below), []).append(r)
                    break
                below += row["n"]
        for (c, lo, hi, below), rs in fetch.items():
            x = F.col(f"_q_{c}")
            vals = sorted(v[0] for v in data.filter(x.between(F.lit(lo), F.lit(hi))).select(x).collect())
            found.update({(c, r): vals[r - below] for r in rs})
    return found


def exact_quantiles_of(df: DataFrame, probs: Mapping[str, Sequence[float]], bins: int = 1024,
                       final_rows: int = 50_000, materialize: bool = True) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns (NULL / NaN
    ignored), refined together: a pass serves every column and every rank.
    ``materialize=False`` when ``df`` already reads a written table."""
    from ..session import cut_lineage
    cols = list(probs)
    x = [F.col(c).cast("double") for c in cols]
    # the refinement reads the columns several times: write these once
    # instead of recomputing the upstream plan for every pass
    data = df.select(*[F.when(~F.isnan(v), v + F.lit(0.0)).alias(f"_q_{i}") for i, v in enumerate(x)])
    if materialize:
        data = cut_lineage(data, "quantile")
    one = data.agg(*[a for i in range(len(cols)) for a in (
        F.count(f"_q_{i}").alias(f"n{i}"), F.min(f"_q_{i}").alias(f"lo{i}"), F.max(f"_q_{i}").alias(f"hi{i}"))]).first()
    n = {i: one[f"n{i}"] for i in range(len(cols)) if one[f"n{i}"]}
    pos = {i: [(n[i] - 1) * float(p) for p in probs[cols[i]]] for i in n}
    ranks = {i: [r for v in pos[i] for r in (math.floor(v), min(math.floor(v) + 1, n[i] - 1))] for i in n}
    stats = _order_stats(data, {i: (one[f"lo{i}"], one[f"hi{i}"]) for i in n}, ranks, bins, final_rows)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = [None] * len(probs[c])
        for k, v in enumerate(pos.get(i, [])):
            low, high = stats[i, math.floor(v)], stats[i, min(math.floor(v) + 1, n[i] - 1)]
            out[c][k] = low if low == high else low + (v - math.floor(v)) * (high - low)
    return out


def order_statistics(df: DataFrame, ranks: Mapping[str, Sequence[int]], bins: int = 1024,
                     final_rows: int = 50_000) -> dict[str, list[float]]:
    """Values of the given ranks (from 0) of each column, NULL and NaN left out.
    ``df`` should read a written table: it is passed over several times."""
    cols = list(ranks)
    if not any(ranks.values()):
        return {c: [] for c in cols}
    data = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0)).alias(f"_q_{i}")
                       for i, c in enumerate(cols)])
    one = data.agg(*[a for i in range(len(cols)) for a in (F.min(f"_q_{i}").alias(f"lo{i}"), F.max(f"_q_{i}").alias(f"hi{i}"))]).first()
    asked = {i: list(ranks[c]) for i, c in enumerate(cols) if ranks[c]}
    found = _order_stats(data, {i: (one[f"lo{i}"], one[f"hi{i}"]) for i in asked}, asked, bins, final_rows)
    return {c: [found[i, r] for r in asked.get(i, [])] for i, c in enumerate(cols)}


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], bins: int = 1024,
                    final_rows: int = 50_000, materialize: bool = True) -> list[float | None]:
    """:func:`exact_quantiles_of` for one column."""
    return exact_quantiles_of(df, {col: list(probs)}, bins, final_rows, materialize)[col]


def quantiles(df: DataFrame, col: str, probs: Sequence[float], method: str = "exact",
              accuracy: int = 10000, materialize: bool = True) -> list[float | None]:
    """``method='exact'`` (distributed refinement) or ``'approx'``."""
    if method == "approx":
        return approx_quantiles(df, col, probs, accuracy)
    return exact_quantiles(df, col, probs, materialize=materialize)
