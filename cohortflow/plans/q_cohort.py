"""The flagship cohort feature table and the rule-score queries."""

from pyspark.sql import functions as F

from ..functions.expr import cut, cyclical, equals_flag, indicator, season_flag, threshold_flag
from ..functions.fixed import AGE_EDGES, AGE_LABELS, LOS_EDGES, LOS_LABELS
from ..functions.time import DAYS_PER_YEAR, add_days, elapsed_days, years_between
from ..operators.children import aggregate_children, attach, measured_spec, subset_spec
from ..operators.history import history_features
from ..operators.score import additive_score, risk_tier
from ..sources.io import read_parquet
from .bindings import ITEM_RULES, ORDERS_EVENTS_SQL, coded_children, days_sql, orders_events
from .q_children import (CHILD_SQL, CODE_GROUPS, DRUG_CLASSES, LI_ORDER, PRIMARY_CODES,
                         SUBTYPE_GROUPS, _any, _inlist, coded_features_spec, drug_features_spec,
                         item_rules)
from ..session import cut_lineage
from .registry import register



def customer_entities(spark, sf_dir):
    """Entity table with a derived birth time (the driver tables have none)."""
    c = read_parquet(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    dob = add_days(F.expr("TIMESTAMP_NTZ'1920-01-01 00:00:00'"), (F.col("c_custkey") * 37) % 25000)
    return c.withColumn("c_birth", dob)


CUSTOMER_SQL = """SELECT c_custkey, c_mktsegment, c_acctbal,
  TIMESTAMP '1920-01-01' + to_days(CAST((c_custkey * 37) % 25000 AS INTEGER)) AS c_birth
FROM customer"""


def _all_child_spec():
    meas = measured_spec("l_returnflag", "l_quantity", LI_ORDER.split(", "), item_rules(ITEM_RULES),
                         ratio=("ratio_r_a", "item_r", "item_a", 0.1))
    sub = subset_spec("l_quantity", F.col("l_returnflag") == "R", prefix="r")
    return [coded_features_spec(), drug_features_spec(), meas, sub]


def cohort_frame(spark, sf_dir, keep_last=False, materialize=True):
    """Events + one-pass child features + entity attributes + label + history.

    The event-level frame (one row per event, all child features attached)
    is written once to the shared checkpoint folder: the ordered scan then reads
    only its seven columns of it, and the wide rows are shuffled once, to
    meet their history by ``o_orderkey``."""
    specs = _all_child_spec()
    fill = {}
    for s in specs:
        fill.update(s.fill)
    child = aggregate_children(coded_children(spark, sf_dir), "l_orderkey", specs)
    ev = attach(orders_events(spark, sf_dir), child, "o_orderkey", "l_orderkey", fill)
    ev = ev.join(customer_entities(spark, sf_dir), ev.o_custkey == F.col("c_custkey"), "left")
    ev = ev.withColumn("urgent", equals_flag("o_orderpriority", "1-URGENT"))
    if materialize:
        ev = cut_lineage(ev, "cohort-events")
    narrow = ev.select("o_custkey", "o_orderkey", "o_orderdate", "o_enddate", "has_r", "urgent", "total_codes")
    h = history_features(narrow, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate",
                         prior_sums={"prior_with_r": "has_r", "prior_urgent": "urgent",
                                     "prior_lines": "total_codes"},
                         label_horizon=30, keep_last=keep_last)
    own = [c for c in h.columns if c not in narrow.columns]
    return ev.join(h.select("o_orderkey", *own), "o_orderkey")


def derived_columns():
    """Row-level features of the cohort frame (one select, codegen)."""
    age = years_between("c_birth", "o_orderdate")
    los = elapsed_days("o_orderdate", "o_enddate")
    msin, mcos = cyclical(F.month("o_orderdate"), 12)
    wsin, wcos = cyclical(F.weekday("o_orderdate"), 7)
    return [
        F.round(age, 6).alias("age"),
        cut(age, AGE_EDGES, AGE_LABELS).alias("age_band"),
        F.round(age * age, 4).alias("age_squared"),
        threshold_flag(age, ">=", 85).alias("age_very_old"),
        threshold_flag(age, "<", 65).alias("age_young"),
        equals_flag("c_mktsegment", "AUTOMOBILE").alias("segment_flag"),
        equals_flag("o_orderstatus", "F").alias("status_f"),
        equals_flag("o_orderstatus", "O").alias("status_o"),
        los.alias("los_days"),
        cut(los, LOS_EDGES, LOS_LABELS).alias("los_band"),
        F.round(F.log1p(los), 6).alias("los_log"),
        threshold_flag(los, "<=", 2).alias("los_very_short"),
        threshold_flag(los, ">=", 14).alias("los_very_long"),
        F.month("o_orderdate").alias("admit_month"),
        F.weekday("o_orderdate").alias("admit_weekday"),
        indicator(F.weekday("o_orderdate") >= 5).alias("weekend"),
        season_flag("o_orderdate").alias("winter"),
        (F.round(msin, 6) + F.lit(0.0)).alias("month_sin"),
        (F.round(mcos, 6) + F.lit(0.0)).alias("month_cos"),
        (F.round(wsin, 6) + F.lit(0.0)).alias("weekday_sin"),
        (F.round(wcos, 6) + F.lit(0.0)).alias("weekday_cos"),
    ]


def rule_score_col(age="age", los="los_days", comorb="group_count", prior="prior_count",
                   emergency="urgent"):
    return additive_score({age: [(75, 2), (65, 1)], los: [(7, 2), (3, 1)],
                           prior: [(2, 3), (0, 1)]}, counts=[comorb], flags={emergency: 1})


def cohort_features(spark, sf_dir):
    h = cohort_frame(spark, sf_dir)
    base = h.select("*", *derived_columns())
    score = rule_score_col()
    keep = [c for c in base.columns if not c.startswith("c_") and c not in (
        "o_orderdate", "o_enddate", "o_orderpriority", "o_orderstatus", "o_totalprice",
        "next_start")]
    out = base.select(*keep, F.round(score, 4).alias("rule_score"))
    out = out.withColumn("risk_tier", risk_tier("rule_score"))
    rounded = []
    for c in out.columns:
        if c in ("avg_prior_los", "rate_per_year", "r_sum", "r_sum_log", "ratio_r_a") or \
                c.endswith("_mean") or c.endswith("_std"):
            rounded.append(F.round(c, 6).alias(c))
        elif c == "days_since_last":
            rounded.append(F.col(c).cast("double").alias(c))
        else:
            rounded.append(F.col(c))
    return out.select(*rounded)


@register("cohort_feature_table")
def q_cohort_feature_table(spark, sf_dir):
    return cohort_features(spark, sf_dir)


def _cohort_sql():
    def d(a, b):
        return days_sql(a, b)
    groups = {**CODE_GROUPS, **SUBTYPE_GROUPS}
    gsum = " + ".join(f"has_{k}" for k in CODE_GROUPS)
    csum = " + ".join(f"has_{k}" for k in DRUG_CLASSES)
    flag_cols = ",\n      ".join([f"{_any('p_brand', v)} AS has_{k}" for k, v in groups.items()]
                                 + [f"{_any('p_brand', v)} AS has_{k}" for k, v in DRUG_CLASSES.items()])
    item_aggs, item_post = [], []
    for r in item_rules(ITEM_RULES):
        n, m = r.name, f"l_returnflag = '{r.item}'"
        item_aggs.append(f"""arg_min_null(l_quantity, ({LI_ORDER})) FILTER (WHERE {m}) AS {n}_first,
      arg_max_null(l_quantity, ({LI_ORDER})) FILTER (WHERE {m}) AS {n}_last,
      avg(l_quantity) FILTER (WHERE {m}) AS {n}_mean,
      max(l_quantity) FILTER (WHERE {m}) AS {n}_max, min(l_quantity) FILTER (WHERE {m}) AS {n}_min,
      stddev_samp(l_quantity) FILTER (WHERE {m}) AS {n}_sd, count(*) FILTER (WHERE {m}) AS {n}_n""")
        if r.direction == "high":
            f1, f2 = (f"{n}_elevated", f"{n}_last > {r.mild}"), (f"{n}_severe", f"{n}_last > {r.severe}")
        else:
            f1, f2 = (f"{n}_low", f"{n}_last < {r.mild}"), (f"{n}_very_low", f"{n}_last < {r.severe}")
        item_post.append(f"""{n}_first, {n}_last, round({n}_mean, 6) AS {n}_mean, {n}_max, {n}_min,
    round(CASE WHEN {n}_n = 1 THEN 0.0 ELSE {n}_sd END, 6) AS {n}_std,
    {n}_last - {n}_first AS {n}_trend, CAST(coalesce({n}_n, 0) > 0 AS INTEGER) AS has_{n},
    CAST(coalesce({f1[1]}, false) AS INTEGER) AS {f1[0]},
    CAST(coalesce({f2[1]}, false) AS INTEGER) AS {f2[0]}""")
    zero = lambda c: f"coalesce({c}, 0)"
    flags_out = ",\n    ".join(f"{zero('has_' + k)} AS has_{k}" for k in list(groups) + list(DRUG_CLASSES))
    age = f"({d('c_birth', 'o_orderdate')} / 365.25)"
    los = d("o_orderdate", "o_enddate")
    age_band = ("CASE " + " ".join(
        f"WHEN {age} > {lo} AND {age} <= {hi} THEN '{lab}'"
        for lo, hi, lab in zip(AGE_EDGES[:-1], AGE_EDGES[1:], AGE_LABELS)) + " END")
    los_band = ("CASE " + " ".join(
        f"WHEN {los} > {lo} AND {los} <= {hi} THEN '{lab}'"
        for lo, hi, lab in zip(LOS_EDGES[:-1], LOS_EDGES[1:], LOS_LABELS)) + " END")
    pr = ("PARTITION BY o_custkey ORDER BY o_orderdate "
          "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING")
    ordw = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
    pts = (f"(CASE WHEN {age} > 75 THEN 2 WHEN {age} > 65 THEN 1 ELSE 0 END"
           f" + CASE WHEN {los} > 7 THEN 2 WHEN {los} > 3 THEN 1 ELSE 0 END"
           f" + group_count"
           f" + CASE WHEN prior_count > 2 THEN 3 WHEN prior_count > 0 THEN 1 ELSE 0 END"
           f" + CASE WHEN urgent = 1 THEN 1 ELSE 0 END)")
    score = f"round(least({pts} / 10.0, 0.95), 4)"
    return f"""
WITH ev AS ({ORDERS_EVENTS_SQL}),
cu AS ({CUSTOMER_SQL}),
ch AS (
  SELECT l_orderkey, count(*) AS n_rows,
      count(*) FILTER (WHERE p_brand IN ({_inlist(PRIMARY_CODES)})) AS primary_count,
      count(DISTINCT p_brand) AS unique_drugs,
      {flag_cols},
      {','.join(item_aggs)},
      count(*) FILTER (WHERE l_returnflag = 'R') AS r_count,
      sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r_sum,
      max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r_max
  FROM {CHILD_SQL} c GROUP BY l_orderkey),
j AS (
  SELECT ev.o_orderkey, ev.o_custkey, ev.o_orderdate, ev.o_enddate, ev.o_orderstatus,
    cu.c_birth, cu.c_mktsegment,
    {zero('n_rows')} AS total_codes, {zero('primary_count')} AS primary_count,
    {flags_out},
    {zero('n_rows')} AS total_drugs, {zero('unique_drugs')} AS unique_drugs,
    {zero('n_rows')} AS total_measurements,
    {','.join(item_post)},
    round(CASE WHEN item_r_n > 0 AND item_a_n > 0
          THEN item_r_last / greatest(item_a_last, 0.1) END, 6) AS ratio_r_a,
    {zero('r_count')} AS r_count, round(coalesce(r_sum, 0.0), 6) AS r_sum,
    coalesce(r_max, 0.0) AS r_max, CAST({zero('r_count')} > 0 AS INTEGER) AS has_r,
    round(ln(1 + coalesce(r_sum, 0.0)), 6) AS r_sum_log,
    CAST(ev.o_orderpriority = '1-URGENT' AS INTEGER) AS urgent
  FROM ev LEFT JOIN ch ON ch.l_orderkey = ev.o_orderkey
          LEFT JOIN cu ON cu.c_custkey = ev.o_custkey),
k AS (
  SELECT *,
    CAST({gsum} AS INTEGER) AS group_count,
    CAST(total_codes + primary_count + {gsum} AS BIGINT) AS complexity_score,
    CAST(has_group_a * has_group_c AS INTEGER) AS combo_a_c,
    CAST((primary_count > 0)::INTEGER * has_group_c AS INTEGER) AS combo_primary_c,
    CAST({csum} AS INTEGER) AS class_count,
    CAST(total_drugs >= 10 AS INTEGER) AS polypharmacy,
    CAST(greatest(has_class_ace, has_class_arb) + has_class_bb + has_class_diu AS INTEGER)
      AS guideline_score,
    lead(o_orderdate) OVER ({ordw}) AS next_start,
    lead(o_orderkey) OVER ({ordw}) AS next_id,
    CASE WHEN {d(f'lag(o_enddate) OVER ({ordw})', 'o_orderdate')} <= 30 THEN 1 ELSE 0 END AS close_gap,
    {los} AS los
  FROM j),
w AS (
  SELECT *,
    count(*) OVER pr AS prior_count, sum(los) OVER pr AS sum_los,
    max(close_gap) OVER pr AS any_close,
    arg_max(o_enddate, (o_orderdate, o_orderkey)) OVER pr AS last_end,
    min(o_orderdate) OVER pr AS first_start,
    sum(has_r) OVER pr AS s_r, sum(urgent) OVER pr AS s_urgent, sum(total_codes) OVER pr AS s_lines
  FROM k WINDOW pr AS ({pr}))
SELECT o_custkey, o_orderkey, total_codes, primary_count,
  {', '.join('has_' + k for k in groups)},
  total_drugs, unique_drugs, {', '.join('has_' + k for k in DRUG_CLASSES)},
  total_measurements,
  {', '.join(f'{r.name}_first, {r.name}_last, {r.name}_mean, {r.name}_max, {r.name}_min, '
             f'{r.name}_std, {r.name}_trend, has_{r.name}, '
             + ('{0}_elevated, {0}_severe' if r.direction == 'high' else '{0}_low, {0}_very_low')
             .format(r.name) for r in item_rules(ITEM_RULES))},
  ratio_r_a, r_count, r_sum, r_max, has_r, r_sum_log,
  group_count, complexity_score, combo_a_c, combo_primary_c, class_count, polypharmacy,
  guideline_score, CAST(guideline_score >= 3 AS INTEGER) AS optimal_therapy,
  CAST(guideline_score < 2 AS INTEGER) AS suboptimal_therapy, urgent,
  {d('o_enddate', 'next_start')} AS gap_days,
  CAST(coalesce({d('o_enddate', 'next_start')} BETWEEN 1 AND 30, false) AS INTEGER) AS label,
  CAST(prior_count AS BIGINT) AS prior_count,
  CAST({d('last_end', 'o_orderdate')} AS DOUBLE) AS days_since_last,
  round(sum_los / prior_count, 6) AS avg_prior_los,
  CAST(coalesce(any_close, 0) AS INTEGER) AS had_prior_readmission,
  CAST(prior_count >= 3 AS INTEGER) AS frequent_flag,
  round(CASE WHEN prior_count > 0 THEN prior_count /
        greatest({d('first_start', 'o_orderdate')} / 365.25, 0.1) ELSE 0 END, 6) AS rate_per_year,
  CAST(coalesce(s_r, 0) AS INTEGER) AS prior_with_r,
  CAST(coalesce(s_urgent, 0) AS INTEGER) AS prior_urgent,
  CAST(coalesce(s_lines, 0) AS BIGINT) AS prior_lines,
  round({age}, 6) AS age, {age_band} AS age_band,
  round({age} * {age}, 4) AS age_squared,
  CAST(coalesce({age} >= 85, false) AS INTEGER) AS age_very_old,
  CAST(coalesce({age} < 65, false) AS INTEGER) AS age_young,
  CAST(coalesce(c_mktsegment = 'AUTOMOBILE', false) AS INTEGER) AS segment_flag,
  CAST(o_orderstatus = 'F' AS INTEGER) AS status_f, CAST(o_orderstatus = 'O' AS INTEGER) AS status_o,
  los AS los_days, {los_band} AS los_band, round(ln(1 + los), 6) AS los_log,
  CAST(los <= 2 AS INTEGER) AS los_very_short, CAST(los >= 14 AS INTEGER) AS los_very_long,
  CAST(month(o_orderdate) AS INTEGER) AS admit_month,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS admit_weekday,
  CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS weekend,
  CAST(month(o_orderdate) IN (12, 1, 2) AS INTEGER) AS winter,
  (round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0) AS month_sin,
  (round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0) AS month_cos,
  (round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0) AS weekday_sin,
  (round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0) AS weekday_cos,
  {score} AS rule_score,
  CASE WHEN {score} >= 0.7 THEN 'High Risk' WHEN {score} >= 0.4 THEN 'Medium Risk'
       ELSE 'Low Risk' END AS risk_tier
FROM w WHERE next_id IS NOT NULL
"""


from .registry import ORACLE_SQL  # noqa: E402

ORACLE_SQL["cohort_feature_table"] = _cohort_sql().strip()


# Scaled-and-capped network inputs: (output, source column, divisor, cap)
NORMS = [("age_norm", "age", 100.0, None), ("codes_norm", "total_codes", 10.0, 1.0),
         ("primary_norm", "primary_count", 5.0, 1.0), ("groups_norm", "group_count", 5.0, None),
         ("complexity_norm", "complexity_score", 20.0, 1.0), ("subset_norm", "r_sum", 10.0, 1.0),
         ("drugs_norm", "total_drugs", 15.0, 1.0), ("guideline_norm", "guideline_score", 3.0, None),
         ("prior_norm", "prior_count", 5.0, 1.0)]
# (output, item, reference, scale, direction, cap)
ABNORMAL = [("item_a_abnormal", "item_a_last", 25.0, 20.0, "above", 1.0),
            ("item_n_abnormal", "item_n_last", 10.0, 5.0, "below", None),
            ("item_r_abnormal", "item_r_last", 20.0, 30.0, "above", 1.0)]


@register("network_input_features")
def q_network_inputs(spark, sf_dir):
    from ..functions.expr import abnormality, scaled_cap
    # the table's age is rounded; its whole days give the unrounded one back
    cf = cohort_features(spark, sf_dir).withColumn("age", F.round(F.col("age") * DAYS_PER_YEAR) / DAYS_PER_YEAR)
    cols = [F.round(scaled_cap(src, div, cap), 6).alias(out) for out, src, div, cap in NORMS]
    days = F.coalesce(F.col("days_since_last"), F.lit(365.0))
    cols += [days.alias("days_since_last_filled"),
             F.round(scaled_cap(days, 365.0, 1.0), 6).alias("days_since_norm")]
    cols += [F.round(F.coalesce(abnormality(src, ref, sc, d, cap), F.lit(0.0)), 6).alias(out)
             for out, src, ref, sc, d, cap in ABNORMAL]
    return cf.select("o_orderkey", *cols)


def _network_sql():
    parts = []
    for out, src, div, cap in NORMS:
        e = f"round(age * 365.25) / 365.25 / {div}" if src == "age" else f"{src} / {div}"
        parts.append(f"round({'least(' + e + f', {cap})' if cap is not None else e}, 6) AS {out}")
    parts.append("coalesce(days_since_last, 365.0) AS days_since_last_filled")
    parts.append("round(least(coalesce(days_since_last, 365.0) / 365.0, 1.0), 6) AS days_since_norm")
    for out, src, ref, sc, d, cap in ABNORMAL:
        dist = f"{src} - {ref}" if d == "above" else f"{ref} - {src}"
        e = f"greatest({dist}, 0) / {sc}"
        if cap is not None:
            e = f"least({e}, {cap})"
        parts.append(f"round(coalesce({e}, 0.0), 6) AS {out}")
    return f"WITH cf AS ({_cohort_sql().strip()}) SELECT o_orderkey, {', '.join(parts)} FROM cf"


ORACLE_SQL["network_input_features"] = _network_sql()
