"""Model, ensemble and comparison queries.

Trained-model outputs depend on random seeds and are checked by rows and
properties; the ensemble / comparison operators also run on fixed rule-based
scores, where they are exact and oracle-checked."""

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import models as M
from ..operators.prep import FoldPreparation, fit_fill_values, fit_standard, gapped, impute, standardize, stratified_folds, stratified_split
from ..session import cut_lineage, deal
from .q_cohort import cohort_features
from .q_eval import SCORE_CTE, score_table
from .registry import register

BASE_MODELS = ["logistic_regression", "random_forest", "gradient_boosting"]
_NON_FEATURES = {"o_custkey", "o_orderkey", "label", "gap_days", "age_band", "los_band", "risk_tier",
                 "rule_score"}
# The reference's baseline metrics for the improvement report.
BASELINE = {"roc_auc": 0.577, "f1": 0.057, "accuracy": 0.830}


def base_fits(train):
    return M.fit_models(train, BASE_MODELS)


def raw_data(spark, sf):
    """The cohort's features split 80/20 within each class: (training rows, test rows, columns, fill policy)."""
    cf = cohort_features(spark, sf)
    cols = [c for c, t in cf.dtypes if c not in _NON_FEATURES and t in ("int", "bigint", "double")]
    policy = {c: "median" for c in cols}
    policy["days_since_last"] = 365.0
    policy["rate_per_year"] = 0.0
    base = cut_lineage(cf.select("o_orderkey", "label", *cols), "cohort")
    split = stratified_split(base, "o_orderkey", "label", 0.2)
    return (split.filter(F.col("split") == "train").drop("split"), split.filter(F.col("split") == "test").drop("split"), cols, policy)


def matrices(train_raw, test_raw, cols, policy):
    """Both sides filled with the training rows' medians and standardised with their mean and population deviation
    (constant columns: by 1), as the reference scales its matrix before fitting."""
    # the others need no fill value, and an exact median is several passes
    gaps = gapped(train_raw.unionByName(test_raw), cols)
    fill = fit_fill_values(train_raw, {c: policy[c] for c in gaps if c in policy})
    train, test = (impute(rows, policy, values=fill) for rows in (train_raw, test_raw))
    scale = fit_standard(train, cols)
    # every fit, fold and score reads the matrix, so it is written once
    return [M.training_matrix(standardize(rows, cols, stats=scale), "o_orderkey", "label", cols, materialize=True) for rows in (train, test)]


def model_data(spark, sf):
    """Filled and scaled cohort matrices: (train, test, cols)."""
    train_raw, test_raw, cols, policy = raw_data(spark, sf)
    return *matrices(train_raw, test_raw, cols, policy), cols


def folded(train_raw, cols, policy):
    """Training rows in five stratified folds, and what each fold's training side says: (rows, preparation)."""
    rows = cut_lineage(deal(stratified_folds(train_raw, "o_orderkey", "label", 5, out="fold")), "folds")
    return rows, FoldPreparation(rows, cols, "fold", policy)


@register("trained_model_scores")
def q_model_scores(spark, sf):
    train, test, _ = model_data(spark, sf)
    return M.score_models(base_fits(train), test, "o_orderkey")


@register("trained_model_comparison")
def q_model_comparison(spark, sf):
    train, test, _ = model_data(spark, sf)
    scores = cut_lineage(M.score_models(base_fits(train), test, "o_orderkey"), "scores")
    return EV.model_comparison(M.metrics_long(scores), ["accuracy", "f1", "roc_auc"])


@register("tree_preset_scores")
def q_presets(spark, sf):
    train, test, _ = model_data(spark, sf)
    return M.score_models(M.fit_models(train, ["enhanced_rf", "extra_trees"]), test, "o_orderkey")


@register("neural_network_scores")
def q_mlp(spark, sf):
    train, test, _ = model_data(spark, sf)
    names = ["neural_network", *(f"nn_{n}" for n in M.NETWORK_LAYOUTS)]
    return M.score_models(M.fit_models(train, names), test, "o_orderkey")


@register("trained_soft_vote")
def q_trained_vote(spark, sf):
    train, test, _ = model_data(spark, sf)
    scores = cut_lineage(M.score_models(base_fits(train), test, "o_orderkey"), "scores")
    return M.soft_vote(scores, "o_orderkey", BASE_MODELS)


#: Candidates of the stack: every tree model that is not one of the 200-round boosting presets, and the linear one. The presets
#: take about a minute a fit (README), which five folds would make into a quarter of an hour for each.
STACK_CANDIDATES = [*BASE_MODELS, "enhanced_rf", "extra_trees"]


@register("stacking_scores")
def q_stacking(spark, sf):
    """The best three of five candidates by out-of-fold AUC, stacked; filling and scaling inside the folds."""
    train_raw, test_raw, cols, policy = raw_data(spark, sf)
    rows, prepare = folded(train_raw, cols, policy)
    oof = cut_lineage(M.out_of_fold(rows, "o_orderkey", STACK_CANDIDATES, prepare=prepare), "out-of-fold")
    best = M.best_by_auc(oof, top=3)
    train, test = matrices(train_raw, test_raw, cols, policy)
    return M.stacking(train, test, "o_orderkey", best, oof=oof.filter(F.col("model").isin(best)))


@register("cross_validation_summary")
def q_cv(spark, sf):
    train_raw, _, cols, policy = raw_data(spark, sf)
    rows, prepare = folded(train_raw, cols, policy)
    return M.cross_validate(rows, "o_orderkey", BASE_MODELS, prepare=prepare)


_FOLD_FEATURES = {"item_a_last": "median", "item_n_mean": "median", "ratio_r_a": "median", "item_r_std": 0.0, "item_a_min": "mean", "total_measurements": "median"}


def _fold_sql():
    from .q_prep import MD5_52
    from .q_profile import _MEAS, LABEL_CTE
    fills = {c: {"median": f"quantile_cont({c}, 0.5)", "mean": f"avg({c})"}.get(how, f"CAST({how} AS DOUBLE)") for c, how in _FOLD_FEATURES.items()}
    each = ", ".join(f"{fill} AS fill_{c}" for c, fill in fills.items())
    gaps = ", ".join(f"count(*) > count({c}) AS gap_{c}" for c in fills)
    parts = [f"""SELECT f AS fold, '{c}' AS feature, any_value(CASE WHEN gap_{c} THEN fill_{c} END) AS fill, avg(coalesce({c}, fill_{c})) AS mean,
  stddev_pop(coalesce({c}, fill_{c})) AS std FROM tr JOIN fl USING (f), gp GROUP BY f""" for c in fills]
    return f"""WITH {LABEL_CTE},
m AS ({_MEAS}),
r AS (SELECT m.*, row_number() OVER (PARTITION BY label ORDER BY {MD5_52.format(k='o_orderkey')}) - 1 AS i, count(*) OVER (PARTITION BY label) AS n_
      FROM lb JOIN m ON m.l_orderkey = lb.o_orderkey),
fd AS MATERIALIZED (SELECT *, CAST((i >= n_ * 1 // 5)::INT + (i >= n_ * 2 // 5)::INT + (i >= n_ * 3 // 5)::INT + (i >= n_ * 4 // 5)::INT AS INTEGER) AS fold FROM r),
f AS (SELECT DISTINCT fold AS f FROM fd),
tr AS MATERIALIZED (SELECT f, fd.* FROM f JOIN fd ON fd.fold <> f.f),
fl AS MATERIALIZED (SELECT f, {each} FROM tr GROUP BY f), gp AS (SELECT {gaps} FROM fd)
SELECT fold, feature, round(fill, 6) AS fill, round(mean, 6) AS mean, round(std, 6) AS std FROM ({' UNION ALL '.join(parts)})"""


@register("fold_statistics", sql=_fold_sql())
def q_fold_statistics(spark, sf):
    """Fill value, mean and deviation of each feature on the training side of each of five stratified folds."""
    from .q_children import q_measured
    from .q_profile import _labelled
    rows = _labelled(spark, sf).select("o_orderkey", "label").join(
        q_measured(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), *_FOLD_FEATURES), "o_orderkey")
    rows = cut_lineage(stratified_folds(cut_lineage(rows, "measured"), "o_orderkey", "label", 5, out="fold"), "folds")
    out = FoldPreparation(rows, list(_FOLD_FEATURES), "fold", _FOLD_FEATURES).table(spark)
    return out.select("fold", "feature", *[F.round(c, 6).alias(c) for c in ("fill", "mean", "std")])


def _categories(cols):
    """Every feature in one of eight categories, by its name."""
    kinds = [("history", ("prior", "days_since", "avg_prior", "had_prior", "frequent", "rate_per")),
             ("measurements", ("item_", "has_item", "ratio_", "total_meas", "n_item")),
             ("intensive", ("r_", "has_r", "max_r")),
             ("drugs", ("has_class", "total_drugs", "drug", "guideline", "optimal", "poly", "n_drug", "class_")),
             ("codes", ("has_group", "has_sub", "total_codes", "primary", "group_", "complexity", "combo", "n_codes", "has_")),
             ("demographics", ("age", "segment")), ("stay", ("los", "urgent", "status")),
             ("calendar", ("admit", "weekend", "winter", "month", "weekday"))]
    out = {name: [] for name, _ in kinds}
    for c in cols:
        out[next((name for name, heads in kinds if c.startswith(heads)), "codes")].append(c)
    return out


@register("feature_importance_top")
def q_importance(spark, sf):
    train, _, cols = model_data(spark, sf)
    fit = M.fit_models(train, ["random_forest"])["random_forest"]
    return M.feature_importance(fit, cols, spark, top=20, categories=_categories(cols))


@register("importance_by_category")
def q_importance_cat(spark, sf):
    """Summed |coefficient| / tree importance per feature category, for the
    gradient-boosting and logistic-regression fits."""
    train, _, cols = model_data(spark, sf)
    fits = M.fit_models(train, ["gradient_boosting", "logistic_regression"])
    parts = [M.importance_by_category(M.feature_importance(fits[m], cols, spark, categories=_categories(cols)))
             .withColumn("model", F.lit(m)) for m in ("gradient_boosting", "logistic_regression")]
    return parts[0].unionByName(parts[1])


@register("selected_features")
def q_selected(spark, sf):
    """Top-30 features by ANOVA F on the training rows (printed, not used for
    training in the reference)."""
    from ..operators.prep import select_k_best
    from pyspark.ml.functions import vector_to_array
    train, _, cols = model_data(spark, sf)
    arr = train.select("o_orderkey", "label", vector_to_array("features").alias("_v"))
    wide = arr.select("o_orderkey", "label", *[F.col("_v")[i].alias(c) for i, c in enumerate(cols)])
    _, chosen = select_k_best(wide, cols, "label", k=30)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "position int, feature string")


# ---------------------------------------------------------------- fixed scores

def fixed_scores(spark, sf):
    t = score_table(spark, sf)
    comps = {"rule": F.col("score"), "age_only": F.round(F.least(F.col("age") / 100.0, F.lit(1.0)), 4),
             "stay_only": F.round(F.least(F.col("los_days") / 10.0, F.lit(1.0)), 4)}
    parts = [t.select("o_orderkey", F.lit(n).alias("model"), "label", c.alias("score")) for n, c in comps.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FIXED_CTE = f"""{SCORE_CTE},
fx AS (SELECT o_orderkey, 'rule' AS model, label, score FROM st
       UNION ALL SELECT o_orderkey, 'age_only', label, round(least(age / 100.0, 1.0), 4) FROM st
       UNION ALL SELECT o_orderkey, 'stay_only', label, round(least(los_days / 10.0, 1.0), 4) FROM st)"""

_VOTE_SQL = f"""WITH {FIXED_CTE}
SELECT o_orderkey, 'soft_vote' AS model, first(label) AS label, round(avg(score), 6) AS score,
       CAST(avg(score) > 0.5 AS INTEGER) AS prediction
FROM fx GROUP BY o_orderkey"""


@register("soft_vote_fixed", sql=_VOTE_SQL)
def q_vote(spark, sf):
    v = M.soft_vote(fixed_scores(spark, sf), "o_orderkey")
    return v.withColumn("score", F.round("score", 6))


_AUC_BY_MODEL = """
s AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM fx GROUP BY model, score),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
                coalesce(sum(pos) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below
      FROM s),
t AS (SELECT model, sum(pos) AS P, sum(neg) AS N FROM s GROUP BY model),
r AS (SELECT c.model, round(CAST(sum(pos * (neg_below + 0.5 * neg)) AS DOUBLE) / CAST(max(P) * max(N) AS DOUBLE), 6) AS roc_auc,
             round(sum(pos / P * ((P - pos_below) / (P + N - pos_below - neg_below))), 6) AS average_precision
      FROM c JOIN t ON t.model = c.model GROUP BY c.model)"""


@register("auc_weighted_vote_fixed", sql=f"""
WITH {FIXED_CTE}, {_AUC_BY_MODEL}
SELECT o_orderkey, 'auc_weighted' AS model, first(label) AS label,
       round(sum(roc_auc * score) / sum(roc_auc), 6) AS score,
       CAST(sum(roc_auc * score) / sum(roc_auc) > 0.5 AS INTEGER) AS prediction
FROM fx JOIN r ON r.model = fx.model GROUP BY o_orderkey
""")
def q_weighted(spark, sf):
    fx = fixed_scores(spark, sf)
    aucs = {r["model"]: r["roc_auc"] for r in EV.ranking_metrics(fx, "label", "score", ["model"]).collect()}
    v = M.soft_vote(fx, "o_orderkey", weights=aucs, name="auc_weighted")
    return v.withColumn("score", F.round("score", 6))


def _metrics_sql():
    from .q_eval import METRICS_SQL
    return f"""
cm AS (SELECT model, count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp,
              count(*) FILTER (WHERE label <> 1 AND score > 0.5) AS fp,
              count(*) FILTER (WHERE label <> 1 AND score <= 0.5) AS tn,
              count(*) FILTER (WHERE label = 1 AND score <= 0.5) AS fn FROM fx GROUP BY model),
mm AS (SELECT model, {METRICS_SQL} FROM cm)"""


@register("model_comparison_fixed", sql=f"""
WITH {FIXED_CTE}, {_AUC_BY_MODEL}, {_metrics_sql()}
SELECT mm.model, round(accuracy, 4) AS accuracy, round(f1, 4) AS f1, round(sensitivity, 4) AS sensitivity,
       round(specificity, 4) AS specificity, round(roc_auc, 4) AS roc_auc,
       round(average_precision, 4) AS average_precision
FROM mm JOIN r ON r.model = mm.model
""")
def q_comparison(spark, sf):
    return EV.model_comparison(M.metrics_long(fixed_scores(spark, sf)),
                               ["accuracy", "f1", "sensitivity", "specificity", "roc_auc", "average_precision"])


@register("relative_improvement_fixed", sql=f"""
WITH {FIXED_CTE}, {_AUC_BY_MODEL}, {_metrics_sql()},
lg AS (SELECT model, 'roc_auc' AS metric, roc_auc AS value FROM r
       UNION ALL SELECT model, 'f1', f1 FROM mm UNION ALL SELECT model, 'accuracy', accuracy FROM mm),
b AS (SELECT * FROM (VALUES ('roc_auc', 0.577), ('f1', 0.057), ('accuracy', 0.830)) v(metric, baseline))
SELECT model, lg.metric, value, CAST(baseline AS DOUBLE) AS baseline,
       round((value - baseline) / baseline * 100.0, 4) AS improvement_pct,
       CASE WHEN (value - baseline) / baseline * 100.0 > 5 THEN 'significant'
            WHEN (value - baseline) / baseline * 100.0 > 0 THEN 'modest' ELSE 'none' END AS verdict
FROM lg JOIN b ON b.metric = lg.metric
""")
def q_improvement(spark, sf):
    long = M.metrics_long(fixed_scores(spark, sf)).filter(F.col("metric").isin(list(BASELINE)))
    return EV.relative_improvement(long, BASELINE)


@register("boosting_preset_scores")
def q_boosting_presets(spark, sf):
    """The 200-round gradient-boosting presets (enhanced GBM and the stand-ins
    for the external boosting engines), fitted concurrently."""
    train, test, _ = model_data(spark, sf)
    names = ["enhanced_gbm", "xgboost_preset", "lightgbm_preset", "catboost_preset"]
    return M.score_models(M.fit_models(train, names), test, "o_orderkey")


@register("catboost_preset_scores")
def q_catboost_preset(spark, sf):
    """The 200-round preset alone: the one fit whose time the material studied publishes."""
    train, test, _ = model_data(spark, sf)
    return M.score_models(M.fit_models(train, ["catboost_preset"]), test, "o_orderkey")


def _features(matrix, cols, *keep):
    from pyspark.ml.functions import vector_to_array
    v = matrix.withColumn("_v", vector_to_array("features"))
    return cut_lineage(v.select("o_orderkey", F.col("label").cast("int").alias("label"), *keep, *[F.col("_v")[i].alias(c) for i, c in enumerate(cols)]), "features")


@register("second_order_boosting_scores")
def q_second_order(spark, sf):
    """Boosting by gradient and hessian sums, the reference's 200 rounds: level by level, best first, and symmetric, side by side."""
    from concurrent.futures import ThreadPoolExecutor

    from ..operators.boosting import fit_boosted, score_boosted
    train, test, cols = model_data(spark, sf)
    train, test = _features(train, cols), _features(test, cols)
    kinds = {"levels": {"depth": 4}, "best_first": {"depth": 4, "leaves": 8}, "symmetric": {"depth": 4, "symmetric": True, "columns": 1.0}}
    with ThreadPoolExecutor(max_workers=len(kinds)) as pool:
        fits = dict(zip(kinds, pool.map(lambda how: fit_boosted(train, "label", cols, **how), kinds.values()), strict=True))
    parts = [score_boosted(test, fit, "o_orderkey", name=name) for name, fit in fits.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("weighted_network_scores")
def q_weighted_network(spark, sf):
    """A network trained with balanced class weights and a validation split."""
    from ..operators.networks import fit_network, score_network
    from ..operators.prep import with_class_weights
    train, test, cols = model_data(spark, sf)
    rows = with_class_weights(_features(train, cols), "label")
    net = fit_network(rows, "o_orderkey", "label", cols, steps=40, weight="weight", patience=10)
    return score_network(_features(test, cols), net, "o_orderkey")
