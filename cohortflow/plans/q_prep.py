"""Matrix-preparation queries."""

from pyspark.sql import functions as F

from ..operators import prep as PR
from ..sources.io import read_parquet
from .q_children import q_measured
from .q_eval import SCORE_CTE, score_table
from .q_profile import LABEL_CTE, _MEAS, _labelled
from .registry import register

MD5_UNIT = "(CAST(('0x' || substring(md5(CAST({k} AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) / 4294967296.0)"
MD5_INT = "CAST(('0x' || substring(md5(CAST({k} AS VARCHAR) || '#42'), 1, 8)) AS BIGINT)"


@register("hash_split_summary", sql=f"""
WITH {LABEL_CTE}
SELECT CASE WHEN {MD5_UNIT.format(k='o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END AS split, label,
       count(*) AS n
FROM lb GROUP BY split, label
""")
def q_split(spark, sf):
    lb = PR.hash_split(_labelled(spark, sf), "o_orderkey", 0.2)
    return lb.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("kfold_assignment", sql=f"""
WITH {LABEL_CTE}
SELECT CAST({MD5_INT.format(k='o_orderkey')} % 5 AS INTEGER) AS fold, count(*) AS n,
       CAST(sum(label) AS BIGINT) AS positives
FROM lb GROUP BY fold
""")
def q_folds(spark, sf):
    lb = PR.hash_folds(_labelled(spark, sf), "o_orderkey", 5)
    return lb.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives"))


MD5_52 = "CAST(('0x' || substring(md5(CAST({k} AS VARCHAR) || '#42'), 1, 13)) AS BIGINT)"


@register("stratified_split", sql=f"""
WITH {LABEL_CTE},
r AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY {MD5_52.format(k='o_orderkey')}) AS i,
             count(*) OVER (PARTITION BY label) AS n FROM lb)
SELECT o_orderkey, label, CASE WHEN i <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r
""")
def q_stratified_split(spark, sf):
    """Exactly a fifth of each class, to one row."""
    lb = _labelled(spark, sf).select("o_orderkey", "label")
    return PR.stratified_split(lb, "o_orderkey", "label", 0.2)


@register("stratified_folds", sql=f"""
WITH {LABEL_CTE},
r AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY {MD5_52.format(k='o_orderkey')}) - 1 AS i,
             count(*) OVER (PARTITION BY label) AS n FROM lb)
SELECT o_orderkey, label, CAST((i >= n * 1 // 5)::INT + (i >= n * 2 // 5)::INT + (i >= n * 3 // 5)::INT
                               + (i >= n * 4 // 5)::INT AS INTEGER) AS fold FROM r
""")
def q_stratified_folds(spark, sf):
    lb = _labelled(spark, sf).select("o_orderkey", "label")
    return PR.stratified_folds(lb, "o_orderkey", "label", 5)


_IMP = {"item_a_last": "median", "item_n_mean": "median", "ratio_r_a": "median", "item_r_std": 0.0,
        "item_a_min": "mean"}


@register("median_imputation", sql=f"""
WITH m AS ({_MEAS})
SELECT l_orderkey,
  round(coalesce(item_a_last, (SELECT quantile_cont(item_a_last, 0.5) FROM m)), 6) AS item_a_last,
  round(coalesce(item_n_mean, (SELECT quantile_cont(item_n_mean, 0.5) FROM m)), 6) AS item_n_mean,
  round(coalesce(ratio_r_a, (SELECT quantile_cont(ratio_r_a, 0.5) FROM m)), 6) AS ratio_r_a,
  round(coalesce(item_r_std, 0.0), 6) AS item_r_std,
  round(coalesce(item_a_min, (SELECT avg(item_a_min) FROM m)), 6) AS item_a_min
FROM m
""")
def q_impute(spark, sf):
    m = q_measured(spark, sf).select("l_orderkey", *_IMP)
    out = PR.impute(m, _IMP)
    return out.select("l_orderkey", *[F.round(c, 6).alias(c) for c in _IMP])


@register("standardized_values", sql="""
WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer)
SELECT c_custkey, round((c_acctbal - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS c_acctbal_z FROM customer, s
""")
def q_standard(spark, sf):
    c = read_parquet(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = PR.standardize(c, ["c_acctbal"], suffix="_z")
    return out.select("c_custkey", F.round("c_acctbal_z", 6).alias("c_acctbal_z"))


@register("robust_scaled_values", sql="""
WITH s AS (SELECT quantile_cont(c_acctbal, 0.5) AS med,
                  quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer)
SELECT c_custkey, round((c_acctbal - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) AS c_acctbal_r FROM customer, s
""")
def q_robust(spark, sf):
    c = read_parquet(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = PR.robust_scale(c, ["c_acctbal"], suffix="_r")
    return out.select("c_custkey", F.round("c_acctbal_r", 6).alias("c_acctbal_r"))


@register("min_max_scaled_values", sql="""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice_mm FROM orders, s
""")
def q_minmax(spark, sf):
    o = read_parquet(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = PR.min_max_scale(o, ["o_totalprice"], suffix="_mm")
    return out.select("o_orderkey", F.round("o_totalprice_mm", 6).alias("o_totalprice_mm"))


@register("class_weight_table", sql="""
WITH g AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
SELECT quality, n, round((SELECT sum(n) FROM g) / ((SELECT count(*) FROM g) * n), 6) AS weight FROM g
""")
def q_weights(spark, sf):
    w = PR.class_weights(read_parquet(spark, sf, "labels"), "quality")
    return w.select("quality", "n", F.round("weight", 6).alias("weight"))


_ANOVA = ["age", "los_days", "urgent", "large", "o_totalprice"]


def _anova_sql():
    parts = []
    for c in _ANOVA:
        parts.append(f"""SELECT '{c}' AS feature, round((SELECT sum(n * pow(m - g, 2)) / (count(*) - 1) FROM
              (SELECT label, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM st GROUP BY label),
              (SELECT avg({c}) AS g FROM st))
           / (SELECT sum(n * v) / ((SELECT count(*) FROM st) - count(*)) FROM
              (SELECT label, count(*) AS n, var_pop({c}) AS v FROM st GROUP BY label)), 4) AS f_value""")
    return f"WITH {SCORE_CTE} " + " UNION ALL ".join(parts)


@register("anova_feature_scores", sql=_anova_sql())
def q_anova(spark, sf):
    t = score_table(spark, sf)
    return PR.anova_f(t, _ANOVA, "label")


@register("selected_features_fixed", sql=f"""
SELECT CAST(row_number() OVER (ORDER BY f_value DESC, feature) AS INTEGER) AS position, feature FROM ({_anova_sql()}) f
""")
def q_selected_fixed(spark, sf):
    """Features in falling order of F; position 1 tells the classes apart best."""
    _, chosen = PR.select_k_best(score_table(spark, sf), _ANOVA, "label", k=30)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "position int, feature string")
