"""Profiling and data-quality operators: counts, frequencies, shares,
summary statistics, group comparisons, duplicate / validity checks,
breakdowns and histograms.

Global shares divide by totals computed on the *aggregated* table (a few
rows per category), never by a window over raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cut
from ..functions.quantiles import approx_quantiles, exact_quantiles_of


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_share(g: DataFrame, count_col: str = "n", share: str = "pct", digits: int = 4) -> DataFrame:
    """Share of each row's count in the column total. The total is a 1-row
    aggregate of the (already aggregated) table, broadcast to it, so even a
    high-cardinality breakdown never funnels through one task."""
    total = g.agg(F.sum(count_col).alias("_tot"))
    return (g.crossJoin(F.broadcast(total))
             .withColumn(share, F.round(F.col(count_col) * 100.0 / F.col("_tot"), digits))
             .drop("_tot"))


def _stack(pairs: Sequence[tuple[str, Column]], name_col: str, value_col: str,
           value_type: str = "double") -> Column:
    """``stack`` expression turning ``[(label, column), ...]`` into rows."""
    args = []
    for label, col in pairs:
        args += [F.lit(label), col.cast(value_type)]
    return F.stack(F.lit(len(pairs)), *args).alias(name_col, value_col)


def missing_report(df: DataFrame, cols: Sequence[str] | None = None,
                   only_missing: bool = False) -> DataFrame:
    """``(column_name, n_missing, pct_missing)`` in one pass over all columns.
    Floating NaN counts as missing."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    def miss(c):
        cond = F.col(c).isNull()
        if types[c] in ("double", "float"):
            cond = cond | F.isnan(F.col(c))
        return F.count_if(cond)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[miss(c).alias(f"_m{i}") for i, c in enumerate(cols)])
    out = one.select(F.col("_n"), _stack([(c, F.col(f"_m{i}")) for i, c in enumerate(cols)],
                                         "column_name", "n_missing", "bigint"))
    out = out.select("column_name", "n_missing",
                     F.round(F.col("n_missing") * 100.0 / F.col("_n"), 4).alias("pct_missing"))
    return out.filter(F.col("n_missing") > 0) if only_missing else out


def group_sizes(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def group_size_summary(df: DataFrame, key: str, min_count: int = 1,
                       denominator: DataFrame | None = None, denominator_key: str | None = None
                       ) -> DataFrame:
    """One row: ``n_groups``, ``mean_size``, ``max_size``, ``n_above`` (groups
    with more than ``min_count`` rows) and ``pct_above`` (of ``n_groups``, or
    of the distinct keys of ``denominator`` when given, e.g. all entities
    including those without events)."""
    g = group_sizes(df, key)
    out = g.agg(F.count(F.lit(1)).alias("n_groups"), F.avg("n").alias("mean_size"),
                F.max("n").alias("max_size"), F.count_if(F.col("n") > min_count).alias("n_above"))
    if denominator is not None:
        den = denominator.agg(F.count_distinct(denominator_key or key).alias("_den"))
        out = out.crossJoin(F.broadcast(den))  # 1 row x 1 row
    else:
        out = out.withColumn("_den", F.col("n_groups"))
    return out.select("n_groups", F.round("mean_size", 6).alias("mean_size"), "max_size",
                      "n_above", F.round(F.col("n_above") * 100.0 / F.col("_den"), 4).alias("pct_above"))


def frequency(df: DataFrame, col: str, top: int | None = None, normalize: bool = True,
              name: str = "n", share: str = "pct") -> DataFrame:
    """Value counts, descending (ties by value), with the share of all rows
    in percent; ``top`` keeps the k most frequent (TakeOrderedAndProject)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    if normalize:
        g = with_share(g, name, share)
    g = g.orderBy(F.desc(name), F.asc(col))
    return g.limit(top) if top else g


def rate(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Percentage of rows satisfying each condition, one pass, long form
    ``(measure, pct)``."""
    one = df.agg(*[F.avg(F.coalesce(c.cast("double"), F.lit(0.0))).alias(f"_r{i}")
                   for i, c in enumerate(conditions.values())])
    return one.select(_stack([(k, F.round(F.col(f"_r{i}") * 100.0, 4))
                              for i, k in enumerate(conditions)], "measure", "pct"))


def global_stats(df: DataFrame, col: str, median: float | None = None) -> DataFrame:
    """``n, min, max, mean`` (+ ``median`` if given from :func:`quantiles`)."""
    out = df.agg(F.count(col).alias("n"), F.min(col).cast("double").alias("min_value"),
                 F.max(col).cast("double").alias("max_value"),
                 F.round(F.avg(col), 6).alias("mean_value"))
    if median is not None:
        out = out.withColumn("median_value", F.lit(float(median)))
    return out


def describe(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """``count, mean, std, min, 25%, 50%, 75%, max`` per column (long form
    ``(column_name, statistic, value)``), sample std, linear quartiles."""
    from ..session import cut_lineage
    if method == "exact":
        df = cut_lineage(df.select(*cols), "describe")  # read by every column's refinement
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"),
                 F.stddev_samp(c).alias(f"std{i}"), F.min(c).alias(f"min{i}"),
                 F.max(c).alias(f"max{i}")]
    one = df.agg(*aggs)
    pairs, probs = [], [0.25, 0.5, 0.75]
    found = (exact_quantiles_of(df, {c: probs for c in cols}, materialize=False) if method == "exact"
             else {c: approx_quantiles(df, c, probs) for c in cols})
    for i, c in enumerate(cols):
        q = found[c]
        pairs += [(f"{c}|count", F.col(f"n{i}")), (f"{c}|mean", F.col(f"mean{i}")),
                  (f"{c}|std", F.col(f"std{i}")), (f"{c}|min", F.col(f"min{i}")),
                  (f"{c}|25%", F.lit(q[0])), (f"{c}|50%", F.lit(q[1])), (f"{c}|75%", F.lit(q[2])),
                  (f"{c}|max", F.col(f"max{i}"))]
    st = one.select(_stack(pairs, "_k", "value"))
    return st.select(F.split("_k", r"\|")[0].alias("column_name"),
                     F.split("_k", r"\|")[1].alias("statistic"), F.round("value", 6).alias("value"))


def grouped_stats(df: DataFrame, by: str, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Per-group mean and sample std of each column, rounded."""
    aggs = []
    for c in cols:
        aggs += [F.round(F.avg(c), digits).alias(f"{c}_mean"),
                 F.round(F.stddev_samp(c), digits).alias(f"{c}_std")]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *aggs)


def two_group_compare(df: DataFrame, group_col: str, cols: Sequence[str],
                      groups: tuple = (0, 1)) -> DataFrame:
    """Long form ``(feature, mean_a, mean_b, difference, pct_difference)``:
    conditional means in one pass (pct relative to group a)."""
    a, b = groups
    g = F.col(group_col)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.when(g == F.lit(a), F.col(c))).alias(f"a{i}"),
                 F.avg(F.when(g == F.lit(b), F.col(c))).alias(f"b{i}")]
    one = df.agg(*aggs)
    st = one.select(F.stack(F.lit(len(cols)), *[x for i, c in enumerate(cols) for x in (
        F.lit(c), F.col(f"a{i}").cast("double"), F.col(f"b{i}").cast("double"))])
        .alias("feature", "mean_a", "mean_b"))
    return st.select("feature", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
                     F.round(F.col("mean_b") - F.col("mean_a"), 6).alias("difference"),
                     F.round(F.try_divide(F.col("mean_b") - F.col("mean_a"), F.col("mean_a")) * 100.0, 4)
                     .alias("pct_difference"))


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier row on ``cols``: ``count - count_distinct``."""
    distinct = df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("_d"))
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return total.crossJoin(F.broadcast(distinct)).select("n_rows", F.col("_d").alias("n_distinct"),
                                            (F.col("n_rows") - F.col("_d")).alias("n_duplicates"))


def orphan_count(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (``left_anti``)."""
    orphans = child.join(parent.select(F.col(parent_key).alias("_pk")),
                         child[child_key] == F.col("_pk"), "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("n_orphans"))


def breakdown(df: DataFrame, category: Column | str, name: str = "category") -> DataFrame:
    """``(category, n, pct)`` over all rows; NULL is its own category."""
    g = df.select(_c(category).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return with_share(g, "n", "pct")


def band_breakdown(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    return breakdown(df, cut(F.col(col), edges, labels), "band")


def calendar_breakdown(df: DataFrame, ts: str) -> DataFrame:
    """``(part, value, n)`` for year, month and weekday (Monday = 0) in one
    scan: the three group keys are produced by ``stack`` and grouped once."""
    parts = df.select(F.stack(F.lit(3), F.lit("year"), F.year(ts), F.lit("month"), F.month(ts),
                              F.lit("weekday"), F.weekday(ts)).alias("part", "value"))
    return parts.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


def flag_prevalence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """``(flag, pct)`` = mean of each 0/1 flag in percent."""
    return rate(df, {f: F.col(f) == 1 for f in flags}).withColumnRenamed("measure", "flag")


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Fixed-width histogram over ``[min, max]`` (last bin closed, as NumPy):
    ``(bin, lower, upper, n)``. The bounds are fitted first (two scalars) and
    then literals of the plan."""
    x = F.col(col).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    lo, hi = (lo, hi) if lo is not None else (0.0, 0.0)
    width = (hi - lo) / float(bins)
    b = F.lit(0) if width == 0 else F.least(F.floor((F.col("_x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    g = df.select(x.alias("_x")).filter(F.col("_x").isNotNull()).groupBy(b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    return g.select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lower"),
                    F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("upper"), "n")


def best_by(df: DataFrame, key: str, metric: str, largest: bool = True) -> DataFrame:
    """The ``key`` with the largest (or smallest) ``metric``, ties to the
    smallest key: one aggregate, no sort."""
    sign = -F.col(metric) if largest else F.col(metric)
    best = df.filter(F.col(metric).isNotNull()).agg(F.min_by(F.struct(F.col(key).alias("k"), F.col(metric).alias("m")),
                                                             F.struct(sign, F.col(key))).alias("b"))
    return best.select(F.col("b.k").alias(key), F.col("b.m").alias(metric))


def ranked(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """Dense 1..n numbering of a *small* result (metric tables, top-k)."""
    return df.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in first-seen order: ``(value, first_position)``."""
    return df.groupBy(value).agg(F.min(position).alias("first_position"))
