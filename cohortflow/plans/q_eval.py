"""Scoring, evaluation and risk-stratification queries.

Score binding: the non-last order events with their 30-day label and a rule
score from age, stay length, urgency and order size (many ties, which
exercises the tie handling of every metric)."""

from pyspark.sql import functions as F

from ..functions.time import elapsed_days, years_between
from ..operators import evaluate as EV
from ..operators.label import readmission_label
from ..operators.score import (additive_score, attach_lookup, lookup_table, reason_codes,
                               risk_tier)
from .bindings import days_sql, orders_events
from .q_cohort import CUSTOMER_SQL, customer_entities
from .q_profile import LABEL_CTE
from .registry import register


def score_table(spark, sf):
    lb = readmission_label(orders_events(spark, sf), "o_custkey", "o_orderkey", "o_orderdate",
                           "o_enddate")
    lb = lb.join(customer_entities(spark, sf), lb.o_custkey == F.col("c_custkey"), "left")
    age = years_between("c_birth", "o_orderdate")
    los = elapsed_days("o_orderdate", "o_enddate")
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    big = (F.col("o_totalprice") > 300000).cast("int")
    t = lb.select("o_orderkey", "label", F.round(age, 6).alias("age"), los.alias("los_days"),
                  urgent.alias("urgent"), big.alias("large"), "o_totalprice")
    score = additive_score({"age": [(75, 2), (65, 1)], "los_days": [(7, 2), (3, 1)]},
                           flags={"urgent": 1, "large": 1})
    return t.withColumn("score", F.round(score, 4))


SCORE_CTE = f"""{LABEL_CTE},
cu AS ({CUSTOMER_SQL}),
st0 AS (SELECT lb.o_orderkey, lb.label, round({days_sql('cu.c_birth', 'lb.o_orderdate')} / 365.25, 6) AS age,
               lb.los_days, CAST(lb.o_orderpriority = '1-URGENT' AS INTEGER) AS urgent,
               CAST(lb.o_totalprice > 300000 AS INTEGER) AS large, lb.o_totalprice
        FROM lb LEFT JOIN cu ON cu.c_custkey = lb.o_custkey),
st AS (SELECT *, round(least((CASE WHEN age > 75 THEN 2 WHEN age > 65 THEN 1 ELSE 0 END
                        + CASE WHEN los_days > 7 THEN 2 WHEN los_days > 3 THEN 1 ELSE 0 END
                        + urgent + large) / 10.0, 0.95), 4) AS score FROM st0)"""


def _metric_sql(pred):
    return f"""
c AS (SELECT count(*) FILTER (WHERE label = 1 AND {pred}) AS tp, count(*) FILTER (WHERE label <> 1 AND {pred}) AS fp,
             count(*) FILTER (WHERE label <> 1 AND NOT {pred}) AS tn, count(*) FILTER (WHERE label = 1 AND NOT {pred}) AS fn
      FROM st)
SELECT tp, fp, tn, fn, {METRICS_SQL} FROM c"""


def _r(a, b):
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0), 6)"


METRICS_SQL = ", ".join([
    f"{_r('tp + tn', 'tp + fp + tn + fn')} AS accuracy", f"{_r('2 * tp', '2 * tp + fp + fn')} AS f1",
    f"{_r('tp', 'tp + fn')} AS sensitivity", f"{_r('tn', 'tn + fp')} AS specificity",
    f"{_r('tp', 'tp + fp')} AS ppv", f"{_r('tn', 'tn + fn')} AS npv",
    f"{_r('fp', 'fp + tn')} AS fpr", f"{_r('fn', 'fn + tp')} AS fnr"])


@register("score_binary_metrics", sql=f"WITH {SCORE_CTE}, {_metric_sql('score >= 0.5')}")
def q_binary(spark, sf):
    return EV.binary_metrics(score_table(spark, sf), "label", "score", 0.5)


@register("score_class_report", sql=f"""
WITH {SCORE_CTE},
p AS (SELECT label, CAST(score >= 0.5 AS INTEGER) AS pred FROM st),
k AS (SELECT cls, count(*) FILTER (WHERE label = cls AND pred = cls) AS tp, count(*) FILTER (WHERE pred = cls) AS pp,
             count(*) FILTER (WHERE label = cls) AS s
      FROM p, (SELECT unnest([0, 1]) AS cls) GROUP BY cls),
m AS (SELECT cls, coalesce(tp / nullif(pp, 0), 0.0) AS pr, coalesce(tp / nullif(s, 0), 0.0) AS rc, s FROM k),
f AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0) AS f1 FROM m)
SELECT CAST(cls AS VARCHAR) AS class_name, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1,
       CAST(s AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), CAST(sum(s) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * s) / sum(s), 6), round(sum(rc * s) / sum(s), 6),
       round(sum(f1 * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM f
""")
def q_class_report(spark, sf):
    t = EV.predictions(score_table(spark, sf), "score", 0.5)
    return EV.class_report(t, "label", "prediction")


RANK_SQL = """
s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM st GROUP BY score),
c AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
                coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM s),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM s)"""


@register("score_ranking_metrics", sql=f"""
WITH {SCORE_CTE}, {RANK_SQL}
SELECT round(CAST(sum(pos * (neg_below + 0.5 * neg)) AS DOUBLE) / CAST(max(P) * max(N) AS DOUBLE), 6) AS roc_auc,
       round(sum(pos / P * ((P - pos_below) / (P + N - pos_below - neg_below))), 6) AS average_precision
FROM c, t
""")
def q_ranking(spark, sf):
    return EV.ranking_metrics(score_table(spark, sf), "label", "score")


@register("score_threshold_sweep", sql=f"""
WITH {SCORE_CTE},
c AS (SELECT threshold,
        count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE label <> 1 AND score >= threshold) AS fp,
        count(*) FILTER (WHERE label <> 1 AND score < threshold) AS tn, count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn
      FROM st, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold) GROUP BY threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, tn, fn, {METRICS_SQL} FROM c
""")
def q_sweep(spark, sf):
    return EV.threshold_sweep(score_table(spark, sf), "label", "score")


@register("score_quartile_groups", sql=f"""
WITH {SCORE_CTE},
q AS (SELECT quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3 FROM st),
g AS (SELECT CASE WHEN score <= q1 THEN 'Low Risk' WHEN score <= q2 THEN 'Medium-Low Risk'
                  WHEN score <= q3 THEN 'Medium-High Risk' ELSE 'High Risk' END AS risk_group, label FROM st, q),
names AS (SELECT unnest(['Low Risk', 'Medium-Low Risk', 'Medium-High Risk', 'High Risk']) AS risk_group),
a AS (SELECT names.risk_group, count(g.label) AS n, CAST(coalesce(sum(g.label), 0) AS BIGINT) AS events
      FROM names LEFT JOIN g ON g.risk_group = names.risk_group GROUP BY names.risk_group)
SELECT risk_group, n, events, round(coalesce(events / nullif(n, 0), 0.0), 6) AS rate,
       round(n * 100.0 / (SELECT count(*) FROM st), 4) AS pct FROM a
""")
def q_quartiles(spark, sf):
    return EV.quartile_groups(score_table(spark, sf), "label", "score")


CAPTURE_SQL = """
p AS (SELECT quantile_cont(score, 0.8) AS thr FROM st),
k AS (SELECT max(thr) AS thr, count(*) FILTER (WHERE score >= thr) AS n_top,
             count(*) FILTER (WHERE score >= thr AND label = 1) AS events_top,
             count(*) FILTER (WHERE label = 1) AS ev, count(*) AS n FROM st, p)"""


@register("score_top20_capture", sql=f"""
WITH {SCORE_CTE}, {CAPTURE_SQL}
SELECT round(thr, 6) AS threshold, n_top, events_top, round(coalesce(events_top / nullif(n_top, 0), 0.0), 6) AS rate_top,
       round(coalesce(events_top / nullif(ev, 0), 0.0), 6) AS capture,
       round(CAST(n_top AS DOUBLE) / nullif(CAST(events_top AS DOUBLE), 0), 6) AS nns,
       round(n_top * 100.0 / n, 4) AS pct_population FROM k
""")
def q_capture(spark, sf):
    return EV.top_fraction_capture(score_table(spark, sf), "label", "score", 0.2)


@register("score_cost_benefit", sql=f"""
WITH {SCORE_CTE}, {CAPTURE_SQL}
SELECT round(events_top * 0.3, 6) AS prevented, round(events_top * 0.3 * 15000, 2) AS savings,
       round(n_top * 500.0, 2) AS intervention_cost, round(events_top * 0.3 * 15000 - n_top * 500.0, 2) AS net_benefit,
       round((events_top * 0.3 * 15000 - n_top * 500.0) / nullif(n_top * 500.0, 0) * 100.0, 4) AS roi_pct FROM k
""")
def q_cost(spark, sf):
    return EV.cost_benefit(EV.top_fraction_capture(score_table(spark, sf), "label", "score", 0.2))


_PROFILE = ["age", "los_days", "o_totalprice", "urgent"]


@register("score_high_low_profile", sql=f"""
WITH {SCORE_CTE},
q AS (SELECT quantile_cont(score, 0.8) AS qh, quantile_cont(score, 0.2) AS ql FROM st),
a AS (SELECT {', '.join(f"avg({c}) FILTER (WHERE score >= qh) AS h_{c}, avg({c}) FILTER (WHERE score <= ql) AS l_{c}" for c in _PROFILE)}
      FROM st, q)
{' UNION ALL '.join(f"SELECT '{c}' AS feature, round(h_{c}, 6) AS mean_high, round(l_{c}, 6) AS mean_low, round(round(h_{c}, 6) - round(l_{c}, 6), 6) AS difference FROM a" for c in _PROFILE)}
""")
def q_profile(spark, sf):
    return EV.high_low_profile(score_table(spark, sf), "score", _PROFILE)


# neutral texts of this binding
RECOMMENDATIONS = {"High Risk": "call within days", "Medium Risk": "call within a week", "Low Risk": "no call needed"}


@register("rule_score_tiers", sql=f"""
WITH {SCORE_CTE}
SELECT o_orderkey, score,
       CASE WHEN score >= 0.7 THEN 'High Risk' WHEN score >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_tier,
       CASE WHEN score >= 0.7 THEN '{RECOMMENDATIONS["High Risk"]}'
            WHEN score >= 0.4 THEN '{RECOMMENDATIONS["Medium Risk"]}'
            ELSE '{RECOMMENDATIONS["Low Risk"]}' END AS recommendation,
       CASE WHEN age > 75 OR los_days > 7 OR urgent = 1 OR large = 1 THEN
         array_to_string(list_filter([CASE WHEN age > 75 THEN 'Advanced age' END,
                                      CASE WHEN los_days > 7 THEN 'Extended stay' END,
                                      CASE WHEN urgent = 1 THEN 'Urgent event' END,
                                      CASE WHEN large = 1 THEN 'Large order' END], lambda x: x IS NOT NULL), '; ')
       ELSE 'No major risk factors identified' END AS reasons
FROM st
""")
def q_tiers(spark, sf):
    t = score_table(spark, sf).withColumn("risk_tier", risk_tier("score"))
    reasons = reason_codes([(F.col("age") > 75, "Advanced age"), (F.col("los_days") > 7, "Extended stay"),
                            (F.col("urgent") == 1, "Urgent event"), (F.col("large") == 1, "Large order")])
    t = t.withColumn("reasons", F.array_join(reasons, "; "))
    rec = lookup_table(spark, RECOMMENDATIONS, "tier", "recommendation")
    t = attach_lookup(t, "risk_tier", rec, "tier", "recommendation", bounded=True)  # three literal rows
    return t.select("o_orderkey", "score", "risk_tier", "recommendation", "reasons")
