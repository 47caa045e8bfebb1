"""Label and history queries on the order-event binding."""

from pyspark.sql import functions as F

from ..functions.fixed import LOS_EDGES, LOS_LABELS
from ..functions.time import elapsed_days
from ..operators.history import history_features
from ..operators.label import gap_bands, gap_to_previous, horizon_rates, readmission_label
from ..sources.io import read_parquet
from .bindings import ORDERS_EVENTS_SQL, days_sql, orders_events
from ..session import cut_lineage
from .registry import register

EV = f"ev AS ({ORDERS_EVENTS_SQL})"
NEXT = ("lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
LEAD_ID = ("lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
PREV_END = ("lag(o_enddate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")


@register("readmission_label", sql=f"""
WITH {EV},
nx AS (SELECT *, {NEXT} AS next_start, {LEAD_ID} AS next_id FROM ev)
SELECT o_orderkey, o_custkey, {days_sql('o_enddate', 'next_start')} AS gap_days,
       CAST(coalesce({days_sql('o_enddate', 'next_start')} BETWEEN 1 AND 30, false) AS INTEGER)
         AS label
FROM nx WHERE next_id IS NOT NULL
""")
def q_readmission_label(spark, sf_dir):
    ev = orders_events(spark, sf_dir)
    out = readmission_label(ev, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate",
                            horizon_days=30)
    return out.select("o_orderkey", "o_custkey", "gap_days", "label")


@register("label_class_balance", sql=f"""
WITH {EV},
nx AS (SELECT *, {NEXT} AS next_start, {LEAD_ID} AS next_id FROM ev),
lb AS (SELECT CAST(coalesce({days_sql('o_enddate', 'next_start')} BETWEEN 1 AND 30, false)
              AS INTEGER) AS label FROM nx WHERE next_id IS NOT NULL)
SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct
FROM lb GROUP BY label
""")
def q_label_class_balance(spark, sf_dir):
    lb = q_readmission_label(spark, sf_dir)
    from ..operators.profile import with_share
    return with_share(lb.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "n", "pct")


@register("readmission_horizon_rates", sql=f"""
WITH {EV},
g AS (SELECT {days_sql(PREV_END, 'o_orderdate')} AS gap FROM ev),
h AS (SELECT unnest([30, 60, 90]) AS horizon_days)
SELECT CAST(horizon_days AS INTEGER) AS horizon_days,
       CAST(count(*) FILTER (WHERE gap > 0 AND gap <= horizon_days) AS BIGINT) AS n_followed,
       (SELECT count(*) FROM ev) AS n_events,
       round(count(*) FILTER (WHERE gap > 0 AND gap <= horizon_days) * 100.0
             / (SELECT count(*) FROM ev), 4) AS pct
FROM g CROSS JOIN h GROUP BY horizon_days
""")
def q_horizon_rates(spark, sf_dir):
    ev = orders_events(spark, sf_dir)
    g = gap_to_previous(ev, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate", gap_col="gap")
    return horizon_rates(g, "gap", (30, 60, 90))


@register("readmission_day_bands", sql=f"""
WITH {EV},
nx AS (SELECT *, {NEXT} AS next_start, {LEAD_ID} AS next_id FROM ev),
g AS (SELECT {days_sql('o_enddate', 'next_start')} AS gap FROM nx WHERE next_id IS NOT NULL)
SELECT CASE WHEN gap BETWEEN 1 AND 7 THEN '0-7' WHEN gap BETWEEN 8 AND 14 THEN '8-14'
            WHEN gap BETWEEN 15 AND 21 THEN '15-21' ELSE '22-30' END AS band,
       count(*) AS n_events
FROM g WHERE gap BETWEEN 1 AND 30 GROUP BY band
""")
def q_day_bands(spark, sf_dir):
    lb = readmission_label(orders_events(spark, sf_dir), "o_custkey", "o_orderkey",
                           "o_orderdate", "o_enddate")
    return gap_bands(lb, "gap_days")


HIST_SQL = f"""
WITH {EV},
li AS (SELECT l_orderkey, count(*) AS n_lines,
              max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_r
       FROM lineitem GROUP BY l_orderkey),
e AS (SELECT ev.*, coalesce(li.n_lines, 0) AS n_lines, coalesce(li.has_r, 0) AS has_r,
             CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent,
             {days_sql('o_orderdate', 'o_enddate')} AS los,
             CASE WHEN {days_sql(PREV_END, 'o_orderdate')} <= 30 THEN 1 ELSE 0 END AS close_gap
      FROM ev LEFT JOIN li ON li.l_orderkey = ev.o_orderkey),
w AS (
  SELECT o_orderkey, o_custkey, o_orderdate,
    count(*) OVER pr AS prior_count,
    sum(los) OVER pr AS sum_los,
    max(close_gap) OVER pr AS any_close,
    arg_max(o_enddate, (o_orderdate, o_orderkey)) OVER pr AS last_end,
    min(o_orderdate) OVER pr AS first_start,
    sum(has_r) OVER pr AS prior_r,
    sum(urgent) OVER pr AS prior_urgent,
    sum(n_lines) OVER pr AS prior_lines
  FROM e
  WINDOW pr AS (PARTITION BY o_custkey ORDER BY o_orderdate
                RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
SELECT o_orderkey, o_custkey,
  CAST(prior_count AS BIGINT) AS prior_count,
  CAST({days_sql('last_end', 'o_orderdate')} AS DOUBLE) AS days_since_last,
  round(sum_los / prior_count, 6) AS avg_prior_los,
  CAST(coalesce(any_close, 0) AS INTEGER) AS had_prior_readmission,
  CAST(prior_count >= 3 AS INTEGER) AS frequent_flag,
  round(CASE WHEN prior_count > 0 THEN prior_count /
        greatest({days_sql('first_start', 'o_orderdate')} / 365.25, 0.1) ELSE 0 END, 6)
    AS rate_per_year,
  CAST(coalesce(prior_r, 0) AS BIGINT) AS prior_with_r,
  CAST(coalesce(prior_urgent, 0) AS BIGINT) AS prior_urgent,
  CAST(coalesce(prior_lines, 0) AS BIGINT) AS prior_lines
FROM w
"""


def order_event_children(spark, sf_dir):
    """Per-order child summary (line count, any 'R' line) left-joined to the
    events: the per-event inputs of the prior sums."""
    ev = orders_events(spark, sf_dir)
    li = (read_parquet(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_lines"),
               F.max((F.col("l_returnflag") == "R").cast("int")).alias("has_r")))
    return (ev.join(li, ev.o_orderkey == li.l_orderkey, "left").drop("l_orderkey")
              .fillna(0, ["n_lines", "has_r"])
              .withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("int")))


@register("history_features", sql=HIST_SQL)
def q_history(spark, sf_dir):
    e = cut_lineage(order_event_children(spark, sf_dir))
    h = history_features(e, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate",
                         prior_sums={"prior_with_r": "has_r", "prior_urgent": "urgent",
                                     "prior_lines": "n_lines"})
    return h.select("o_orderkey", "o_custkey",
                    F.col("prior_count").cast("bigint").alias("prior_count"),
                    F.col("days_since_last").cast("double").alias("days_since_last"),
                    F.round("avg_prior_los", 6).alias("avg_prior_los"),
                    "had_prior_readmission", "frequent_flag",
                    F.round("rate_per_year", 6).alias("rate_per_year"),
                    F.col("prior_with_r").cast("bigint").alias("prior_with_r"),
                    F.col("prior_urgent").cast("bigint").alias("prior_urgent"),
                    F.col("prior_lines").cast("bigint").alias("prior_lines"))


@register("stay_length", sql=f"""
WITH {EV}
SELECT o_orderkey, {days_sql('o_orderdate', 'o_enddate')} AS los_days,
       CASE WHEN {days_sql('o_orderdate', 'o_enddate')} > 0
                 AND {days_sql('o_orderdate', 'o_enddate')} <= 3 THEN 'Short'
            WHEN {days_sql('o_orderdate', 'o_enddate')} > 3
                 AND {days_sql('o_orderdate', 'o_enddate')} <= 7 THEN 'Medium'
            WHEN {days_sql('o_orderdate', 'o_enddate')} > 7
                 AND {days_sql('o_orderdate', 'o_enddate')} <= 14 THEN 'Long'
            WHEN {days_sql('o_orderdate', 'o_enddate')} > 14
                 AND {days_sql('o_orderdate', 'o_enddate')} <= 30 THEN 'Extended'
            WHEN {days_sql('o_orderdate', 'o_enddate')} > 30
                 AND {days_sql('o_orderdate', 'o_enddate')} <= 1000 THEN 'Very_Long' END AS los_band,
       round(ln(1 + {days_sql('o_orderdate', 'o_enddate')}), 6) AS los_log
FROM ev
""")
def q_stay_length(spark, sf_dir):
    from ..functions.expr import cut
    ev = orders_events(spark, sf_dir)
    los = elapsed_days("o_orderdate", "o_enddate")
    return ev.select("o_orderkey", los.alias("los_days"),
                     cut(los, LOS_EDGES, LOS_LABELS).alias("los_band"),
                     F.round(F.log1p(los), 6).alias("los_log"))
