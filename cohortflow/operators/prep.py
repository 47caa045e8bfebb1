"""Feature-matrix preparation: imputation, deterministic hash split and
folds, scaling, class weights, vector assembly and univariate selection.

Statistics are fitted on ``fit_df`` (the training rows by default in the
model helpers) and applied to any frame: fitting returns a handful of
scalars, applying is a per-row column expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import approx_quantiles, exact_quantiles_of, order_statistics


def hash_unit(key, seed: int = 42, salt: str = "") -> Column:
    """Deterministic pseudo-uniform value in [0, 1) from a key: the first 8
    hex digits of ``md5(key#seed[#salt])`` (the same string in every engine,
    so splits are reproducible outside Spark)."""
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(k.cast("string"), F.lit(f"#{seed}{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(16 ** 8))


def hash_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42,
               out: str = "split") -> DataFrame:
    """``split = 'test'`` for about ``test_fraction`` of keys, else
    ``'train'``. Independent of partitioning and re-runs, approximately
    stratified for any label, no shuffle."""
    return df.withColumn(out, F.when(hash_unit(key, seed) < F.lit(test_fraction), "test")
                         .otherwise("train"))


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold id in ``0..k-1`` from the key hash (folds are disjoint and cover
    every row)."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), 1, 8),
               16, 10).cast("bigint")
    return df.withColumn(out, (h % F.lit(k)).cast("int"))


def _hash52(key: str, seed: int) -> Column:
    """52 bits of ``md5(key#seed)`` as a double: exact, and hardly ever tied."""
    text = F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double")


def _stratum_cuts(df: DataFrame, key: str, label: str, seed: int, ranks) -> list[tuple[object, list[float]]]:
    """For each value of ``label`` the hashes at ``ranks(count)``: the exact
    order statistics of all strata come from the same few passes; the driver holds a few numbers a stratum."""
    from ..session import cut_lineage
    base = cut_lineage(df.select(label, _hash52(key, seed).alias("_h")), "strata")
    counts = base.groupBy(label).agg(F.count("_h").alias("n")).collect()
    wide = base.select(*[F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.col("_h")).alias(f"s{i}")
                         for i, r in enumerate(counts)])
    found = order_statistics(wide, {f"s{i}": ranks(r["n"]) for i, r in enumerate(counts)})
    return [(r[label], found[f"s{i}"]) for i, r in enumerate(counts)]


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """``split = 'test'`` for exactly ``round(n * test_fraction)`` rows of every
    value of ``label`` (those with the smallest key hashes), else ``'train'``.
    A threshold per stratum decides, so no row-level order is formed; keys whose
    hashes tie at it go to the same side."""
    def at(n):
        k = int(n * test_fraction + 0.5)
        return [k - 1] if k else []
    is_test = F.lit(False)
    for value, cut in _stratum_cuts(df, key, label, seed, at):
        if cut:
            is_test |= F.col(label).eqNullSafe(F.lit(value)) & (_hash52(key, seed) <= F.lit(cut[0]))
    return df.withColumn(out, F.when(is_test, "test").otherwise("train"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold ``0..k-1`` with equal shares (to one row) of every value of ``label``:
    thresholds per stratum at its k-quantiles by rank of the key hash."""
    fold = F.lit(0)
    for value, cuts in _stratum_cuts(df, key, label, seed, lambda n: [n * i // k for i in range(1, k)] if n else []):
        mine = sum([(_hash52(key, seed) >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
        fold = F.when(F.col(label).eqNullSafe(F.lit(value)), mine).otherwise(fold)
    return df.withColumn(out, fold.cast("int"))


def fit_fill_values(df: DataFrame, policy: Mapping[str, object], method: str = "exact"
                    ) -> dict[str, float]:
    """Resolve ``{col: 'median' | 'mean' | constant}`` to fill values."""
    values: dict[str, float] = {}
    means = [c for c, p in policy.items() if p == "mean"]
    if means:
        row = df.agg(*[F.avg(c).alias(c) for c in means]).first()
        values.update({c: row[c] for c in means})
    medians = [c for c, p in policy.items() if p == "median"]
    if medians and method == "approx":
        # every approximate median in one aggregate (one job)
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10000).alias(c)
                       for c in medians]).first()
        values.update({c: row[c] for c in medians})
    elif medians:
        values.update({c: q[0] for c, q in exact_quantiles_of(df, {c: [0.5] for c in medians}).items()})
    for c, p in policy.items():
        if p not in ("median", "mean"):
            values[c] = p
    return values


def gapped(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Those of ``cols`` that are NULL or NaN in some row: one aggregate, one row."""
    one = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"g{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if one[f"g{i}"]]


def impute(df: DataFrame, policy: Mapping[str, object], fit_df: DataFrame | None = None,
           method: str = "exact", values: Mapping[str, float] | None = None) -> DataFrame:
    """Fill NULL (and NaN) per column by a median / mean fitted on ``fit_df``
    or by a constant (mid-point median, as pandas / NumPy). Pass ``values``
    (from :func:`fit_fill_values`) to apply an existing fit."""
    vals = values if values is not None else fit_fill_values(
        fit_df if fit_df is not None else df, policy, method)
    cols = []
    for c in df.columns:
        if c in vals and vals[c] is not None:
            x = F.col(c)
            cols.append(F.when(x.isNull() | F.isnan(x), F.lit(float(vals[c]))).otherwise(x).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """``{col: (mean, population std)}`` in one aggregate."""
    row = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standardize(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None,
                suffix: str = "", stats: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """``(x - mean) / std_pop`` (population std as scikit-learn; a constant
    column divides by 1). ``stats`` (from :func:`fit_standard`) applies an
    existing fit."""
    st = stats if stats is not None else fit_standard(fit_df if fit_df is not None else df, cols)
    return df.select(*[c for c in df.columns if not (suffix == "" and c in st)],
                     *[((F.col(c) - F.lit(st[c][0])) / F.lit(st[c][1] or 1.0)).alias(c + suffix)
                       for c in cols])


def robust_scale(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None,
                 method: str = "exact", suffix: str = "") -> DataFrame:
    """``(x - median) / (q75 - q25)``; a zero IQR divides by 1."""
    f = fit_df if fit_df is not None else df
    probs = [0.25, 0.5, 0.75]
    found = (exact_quantiles_of(f, {c: probs for c in cols}) if method == "exact"
             else {c: approx_quantiles(f, c, probs) for c in cols})
    out = df
    for c in cols:
        q25, q50, q75 = found[c]
        iqr = (q75 - q25) or 1.0
        out = out.withColumn(c + suffix, (F.col(c) - F.lit(q50)) / F.lit(iqr))
    return out


def min_max_scale(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None,
                  suffix: str = "") -> DataFrame:
    """``(x - min) / (max - min)``; a constant column becomes 0."""
    f = fit_df if fit_df is not None else df
    row = f.agg(*[x for c in cols for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    out = df
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        rng = (hi - lo) if (hi is not None and lo is not None and hi != lo) else None
        out = out.withColumn(c + suffix, (F.col(c) - F.lit(lo)) / F.lit(rng) if rng else
                             F.when(F.col(c).isNotNull(), F.lit(0.0)))
    return out


class FoldPreparation:
    """Filling and scaling inside cross-validation: what each fold's training side (all rows of the other folds) says of each feature.

    One aggregate gives every fold's count, mean and squared deviations; those of a training side are the other folds' put
    together, its filled rows included. The medians of all sides come from the same passes. The driver holds a few
    numbers a fold and feature; ``policy`` is that of :func:`fit_fill_values`."""

    def __init__(self, df: DataFrame, cols: Sequence[str], fold: str, policy: Mapping[str, object], scale: bool = True):
        self.cols, self.fold = list(cols), fold
        x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in self.cols}
        rows = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *[a for i, c in enumerate(self.cols) for a in (
            F.count(x[c]).alias(f"n{i}"), F.avg(x[c]).alias(f"m{i}"), (F.var_pop(x[c]) * F.count(x[c])).alias(f"d{i}"))]).collect()
        self.folds = sorted(r[fold] for r in rows)
        gaps = [c for i, c in enumerate(self.cols) if any(r[f"n{i}"] < r["n"] for r in rows)]
        medians = [c for c in gaps if policy.get(c) == "median"]
        wide = df.select(*[F.when(F.col(fold) != f, x[c]).alias(f"{k}_{i}") for i, c in enumerate(medians) for k, f in enumerate(self.folds)])
        found = exact_quantiles_of(wide, {c: [0.5] for c in wide.columns}) if medians else {}
        self.fills: dict = {f: {} for f in self.folds}
        self.scales: dict = {f: {} for f in self.folds}
        for k, f in enumerate(self.folds):
            for i, c in enumerate(self.cols):
                parts = [(r[f"n{i}"], r[f"m{i}"], r[f"d{i}"]) for r in rows if r[fold] != f and r[f"n{i}"]]
                n, mean, dev = _together(parts)
                want = policy.get(c)
                fill = found[f"{k}_{medians.index(c)}"][0] if c in medians else mean if want == "mean" else None if want == "median" else want
                missing = sum(r["n"] - r[f"n{i}"] for r in rows if r[fold] != f)
                if fill is not None and c in gaps:
                    self.fills[f][c] = float(fill)
                    n, mean, dev = _together([*parts, (missing, float(fill), 0.0)] if missing else parts)
                if scale:
                    self.scales[f][c] = (mean, (dev / n) ** 0.5 if n else None)

    def rows(self, df: DataFrame, f) -> DataFrame:
        """``df`` filled and scaled as fold ``f``'s training side says."""
        out = impute(df, {}, values=self.fills[f])
        return standardize(out, self.cols, stats=self.scales[f]) if self.scales[f] else out

    def matrix(self, df: DataFrame, f, key: str, label: str) -> DataFrame:
        """``(key, label, features)`` of :meth:`rows`."""
        out = self.rows(df, f).select(key, F.col(label).cast("double").alias(label), *self.cols)
        return assemble(out, self.cols).select(key, label, "features")

    def table(self, spark) -> DataFrame:
        """``(fold, feature, fill, mean, std)``: one row a fold and feature."""
        data = [(f, c, self.fills[f].get(c), *self.scales[f].get(c, (None, None))) for f in self.folds for c in self.cols]
        return spark.createDataFrame(data, "fold int, feature string, fill double, mean double, std double")


def _together(parts: Sequence[tuple[int, float, float]]) -> tuple[int, float | None, float]:
    """Count, mean and squared deviations of groups of rows put together."""
    n = sum(p[0] for p in parts)
    if not n:
        return 0, None, 0.0
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k * n_c)``: ``(label, n, weight)``, one row per
    class (k rows)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return g.crossJoin(F.broadcast(tot)).select(
        label, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")  # one row per class


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Dense feature vector; NULLs must be imputed first (``handleInvalid='error'``)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def anova_f(df: DataFrame, cols: Sequence[str], label: str, digits: int = 4) -> DataFrame:
    """One-way ANOVA F statistic of each feature across the label classes
    (``f_classif``): ``(feature, f_value)``. Per-class count, mean and
    population variance come from one ``groupBy(label)`` (k rows), the
    F ratio ``(SSB/(k-1)) / (SSW/(n-k))`` from a second tiny aggregate."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"),
                              *[x for i, c in enumerate(cols) for x in (
                                  F.avg(c).alias(f"_m{i}"), F.var_pop(c).alias(f"_v{i}"))])
    tot = df.agg(F.count(F.lit(1)).alias("_total"), *[F.avg(c).alias(f"_g{i}") for i, c in enumerate(cols)])
    j = g.crossJoin(F.broadcast(tot))
    aggs = [F.count(F.lit(1)).alias("_k"), F.first("_total").alias("_total")]
    for i, _ in enumerate(cols):
        aggs += [F.sum(F.col("_n") * F.pow(F.col(f"_m{i}") - F.col(f"_g{i}"), 2)).alias(f"_ssb{i}"),
                 F.sum(F.col("_n") * F.col(f"_v{i}")).alias(f"_ssw{i}")]
    one = j.agg(*aggs)
    fcols = [(c, F.try_divide(F.col(f"_ssb{i}") / (F.col("_k") - 1),
                              F.col(f"_ssw{i}") / (F.col("_total") - F.col("_k"))))
             for i, c in enumerate(cols)]
    st = one.select(F.stack(F.lit(len(cols)), *[x for c, v in fcols for x in (F.lit(c), v.cast("double"))])
                    .alias("feature", "f_value"))
    return st.select("feature", F.round("f_value", digits).alias("f_value"))


def select_k_best(df: DataFrame, cols: Sequence[str], label: str, k: int = 30,
                  out: str = "selected") -> tuple[DataFrame, list[str]]:
    """Top-``k`` features by ANOVA F, best first (ties by name; ``k`` capped at the
    feature count), and ``df`` with them assembled in that order."""
    scores = anova_f(df, cols, label, digits=12).collect()  # one row per feature
    order = sorted(scores, key=lambda r: (-(r["f_value"] if r["f_value"] is not None else -1.0), r["feature"]))
    chosen = [r["feature"] for r in order[:k]]
    return assemble(df, chosen, out), chosen
