"""Profiling / data-quality queries on the driver tables."""

from pyspark.sql import functions as F

from ..functions.fixed import LOS_EDGES, LOS_LABELS
from ..functions.quantiles import exact_quantiles_of, quantiles
from ..functions.time import elapsed_days
from ..operators import profile as P
from ..sources.io import DRIVER_TABLES, load_tables, read_parquet, table_overview
from .bindings import ORDERS_EVENTS_SQL, coded_children, days_sql, orders_events
from .q_children import CHILD_SQL, _measured_sql, q_measured
from .bindings import ITEM_RULES, PRIMARY_CODES
from .registry import register


def _t(spark, sf, name):
    return read_parquet(spark, sf, name)


@register("table_row_counts", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in DRIVER_TABLES))
def q_counts(spark, sf):
    return table_overview(load_tables(spark, sf))


_MEAS = _measured_sql("lineitem", "l_orderkey", "l_returnflag", "l_quantity",
                      "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity", ITEM_RULES,
                      ("ratio_r_a", "r", "a", 0.1))
_MISS_COLS = ["item_a_last", "item_a_std", "item_n_first", "item_n_mean", "item_r_max",
              "ratio_r_a", "total_measurements"]


@register("missing_value_report", sql=f"""
WITH m AS ({_MEAS})
SELECT column_name, n_missing, round(n_missing * 100.0 / (SELECT count(*) FROM m), 4) AS pct_missing
FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM m" for c in _MISS_COLS)})
""")
def q_missing(spark, sf):
    return P.missing_report(q_measured(spark, sf), _MISS_COLS)


@register("events_per_entity", sql="SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def q_group_sizes(spark, sf):
    return P.group_sizes(_t(spark, sf, "orders"), "o_custkey")


@register("entity_event_summary", sql="""
WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_size, max(n) AS max_size,
       count(*) FILTER (WHERE n > 1) AS n_above,
       round(count(*) FILTER (WHERE n > 1) * 100.0 / (SELECT count(DISTINCT c_custkey) FROM customer), 4)
         AS pct_above
FROM g
""")
def q_group_summary(spark, sf):
    return P.group_size_summary(_t(spark, sf, "orders"), "o_custkey", 1,
                                _t(spark, sf, "customer"), "c_custkey")


@register("top_codes", sql=f"""
WITH g AS (SELECT p_brand, count(*) AS n FROM {CHILD_SQL} c GROUP BY p_brand)
SELECT p_brand, n, round(n * 100.0 / (SELECT sum(n) FROM g), 4) AS pct
FROM g ORDER BY n DESC, p_brand LIMIT 10
""")
def q_top_codes(spark, sf):
    return P.frequency(coded_children(spark, sf), "p_brand", top=10)


@register("priority_frequency", sql="""
SELECT o_orderpriority, count(*) AS n,
       round(count(*) * 100.0 / (SELECT count(*) FROM orders), 4) AS pct
FROM orders GROUP BY o_orderpriority
""")
def q_priority_freq(spark, sf):
    return P.frequency(_t(spark, sf, "orders"), "o_orderpriority")


@register("order_rates", sql="""
SELECT measure, pct FROM (
  SELECT 'urgent' AS measure, round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct FROM orders
  UNION ALL SELECT 'status_f', round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) * 100, 4) FROM orders
  UNION ALL SELECT 'large', round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END) * 100, 4) FROM orders)
""")
def q_rates(spark, sf):
    o = _t(spark, sf, "orders")
    return P.rate(o, {"urgent": F.col("o_orderpriority") == "1-URGENT",
                      "status_f": F.col("o_orderstatus") == "F",
                      "large": F.col("o_totalprice") > 200000})


@register("price_global_stats", sql="""
SELECT count(o_totalprice) AS n, CAST(min(o_totalprice) AS DOUBLE) AS min_value,
       CAST(max(o_totalprice) AS DOUBLE) AS max_value, round(avg(o_totalprice), 6) AS mean_value,
       round(quantile_cont(o_totalprice, 0.5), 6) AS median_value
FROM orders
""")
def q_global_stats(spark, sf):
    o = _t(spark, sf, "orders")
    med = quantiles(o, "o_totalprice", [0.5])[0]
    return P.global_stats(o, "o_totalprice", round(med, 6))


@register("cross_table_ratios", sql="""
SELECT round((SELECT count(*) FROM lineitem) * 1.0 / (SELECT count(*) FROM orders), 6) AS lines_per_event,
       round((SELECT count(*) FROM events) * 1.0 / (SELECT count(DISTINCT user_id) FROM events), 6)
         AS measurements_per_entity,
       round((SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') * 1.0
             / (SELECT count(*) FROM orders), 6) AS subset_per_event
""")
def q_ratios(spark, sf):
    li, o, ev = _t(spark, sf, "lineitem"), _t(spark, sf, "orders"), _t(spark, sf, "events")
    a = li.agg(F.count(F.lit(1)).alias("_li"), F.count_if(F.col("l_returnflag") == "R").alias("_r"))
    b = o.agg(F.count(F.lit(1)).alias("_o"))
    c = ev.agg(F.count(F.lit(1)).alias("_e"), F.count_distinct("user_id").alias("_u"))
    j = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # three 1-row aggregates
    return j.select(F.round(F.col("_li") / F.col("_o"), 6).alias("lines_per_event"),
                    F.round(F.col("_e") / F.col("_u"), 6).alias("measurements_per_entity"),
                    F.round(F.col("_r") / F.col("_o"), 6).alias("subset_per_event"))


_DESC_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("describe_lines", sql=" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, statistic, round(value, 6) AS value FROM (
  SELECT unnest(['count','mean','std','min','25%','50%','75%','max']) AS statistic,
         unnest([count({c})::DOUBLE, avg({c}), stddev_samp({c}), min({c}), quantile_cont({c}, 0.25),
                 quantile_cont({c}, 0.5), quantile_cont({c}, 0.75), max({c})]) AS value
  FROM lineitem)""" for c in _DESC_COLS))
def q_describe(spark, sf):
    return P.describe(_t(spark, sf, "lineitem"), _DESC_COLS)


@register("grouped_line_stats", sql="""
SELECT l_returnflag, count(*) AS n,
  round(avg(l_quantity), 2) AS l_quantity_mean, round(stddev_samp(l_quantity), 2) AS l_quantity_std,
  round(avg(l_extendedprice), 2) AS l_extendedprice_mean,
  round(stddev_samp(l_extendedprice), 2) AS l_extendedprice_std,
  round(avg(l_discount), 2) AS l_discount_mean, round(stddev_samp(l_discount), 2) AS l_discount_std
FROM lineitem GROUP BY l_returnflag
""")
def q_grouped(spark, sf):
    return P.grouped_stats(_t(spark, sf, "lineitem"), "l_returnflag", _DESC_COLS)


LABEL_CTE = f"""ev AS ({ORDERS_EVENTS_SQL}),
nx AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_start,
              lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_id
       FROM ev),
lb AS (SELECT *, CAST(coalesce({days_sql('o_enddate', 'next_start')} BETWEEN 1 AND 30, false) AS INTEGER)
              AS label, {days_sql('o_orderdate', 'o_enddate')} AS los_days
       FROM nx WHERE next_id IS NOT NULL)"""


def _labelled(spark, sf):
    from ..operators.label import readmission_label
    lb = readmission_label(orders_events(spark, sf), "o_custkey", "o_orderkey", "o_orderdate", "o_enddate")
    return lb.withColumn("los_days", elapsed_days("o_orderdate", "o_enddate"))


@register("label_group_comparison", sql=f"""
WITH {LABEL_CTE},
a AS (SELECT avg(o_totalprice) FILTER (WHERE label = 0) AS a0, avg(o_totalprice) FILTER (WHERE label = 1) AS a1,
             avg(los_days) FILTER (WHERE label = 0) AS b0, avg(los_days) FILTER (WHERE label = 1) AS b1 FROM lb),
s AS (SELECT 'o_totalprice' AS feature, a0 AS mean_a, a1 AS mean_b FROM a
      UNION ALL SELECT 'los_days', b0, b1 FROM a)
SELECT feature, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(round(mean_b, 6) - round(mean_a, 6), 6) AS difference,
       round((round(mean_b, 6) - round(mean_a, 6)) / round(mean_a, 6) * 100.0, 4) AS pct_difference
FROM s
""")
def q_compare(spark, sf):
    return P.two_group_compare(_labelled(spark, sf), "label", ["o_totalprice", "los_days"])


@register("duplicate_child_keys", sql="""
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_distinct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_duplicates
FROM lineitem
""")
def q_dupes(spark, sf):
    return P.duplicate_count(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("validity_checks", sql=f"""
SELECT (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey))
         AS n_orphans,
       (SELECT count(*) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
         WHERE {days_sql('o.o_orderdate', 'l.l_shipdate')} < 0) AS n_negative_gap,
       (SELECT count(*) FROM lineitem WHERE l_shipdate IS NULL) AS n_missing_time,
       (SELECT count(*) FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id))
         AS n_orphan_measurements
""")
def q_validity(spark, sf):
    li, o = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    # one left join answers all three questions about the children
    j = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    own = j.agg(F.count_if(F.col("o_orderkey").isNull()).alias("n_orphans"),
                F.count_if(elapsed_days("o_orderdate", "l_shipdate") < 0).alias("n_negative_gap"),
                F.count_if(F.col("l_shipdate").isNull()).alias("n_missing_time"))
    orph2 = P.orphan_count(_t(spark, sf, "events"), _t(spark, sf, "customer"), "user_id", "c_custkey") \
        .withColumnRenamed("n_orphans", "n_orphan_measurements")
    return own.crossJoin(F.broadcast(orph2))  # one row each


@register("segment_breakdown", sql="""
SELECT c_mktsegment AS category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 4) AS pct
FROM customer GROUP BY c_mktsegment
""")
def q_breakdown(spark, sf):
    return P.breakdown(_t(spark, sf, "customer"), "c_mktsegment")


@register("stay_band_breakdown", sql=f"""
WITH ev AS ({ORDERS_EVENTS_SQL}), l AS (SELECT {days_sql('o_orderdate', 'o_enddate')} AS los FROM ev)
SELECT CASE WHEN los > 0 AND los <= 3 THEN 'Short' WHEN los > 3 AND los <= 7 THEN 'Medium'
            WHEN los > 7 AND los <= 14 THEN 'Long' WHEN los > 14 AND los <= 30 THEN 'Extended'
            WHEN los > 30 AND los <= 1000 THEN 'Very_Long' END AS band,
       count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ev), 4) AS pct
FROM l GROUP BY band
""")
def q_band(spark, sf):
    ev = orders_events(spark, sf).withColumn("los", elapsed_days("o_orderdate", "o_enddate"))
    return P.band_breakdown(ev, "los", LOS_EDGES, LOS_LABELS)


@register("calendar_breakdown", sql="""
SELECT part, value, count(*) AS n FROM (
  SELECT 'year' AS part, CAST(year(o_orderdate) AS INTEGER) AS value FROM orders
  UNION ALL SELECT 'month', CAST(month(o_orderdate) AS INTEGER) FROM orders
  UNION ALL SELECT 'weekday', CAST(isodow(o_orderdate) - 1 AS INTEGER) FROM orders)
GROUP BY part, value
""")
def q_calendar(spark, sf):
    return P.calendar_breakdown(_t(spark, sf, "orders"), "o_orderdate")


@register("subgroup_outcome_rate", sql="""
SELECT count(*) AS n_events, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_outcome
FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
""")
def q_subgroup(spark, sf):
    o = _t(spark, sf, "orders")
    r = _t(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    sub = o.join(r, o.o_orderkey == r.l_orderkey, "left_semi")
    return sub.agg(F.count(F.lit(1)).alias("n_events"),
                   F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")) * 100, 4).alias("pct_outcome"))


_FLAGS = ["has_group_a", "has_group_b", "has_group_c", "has_group_d", "has_group_e"]


def _prev_sql():
    from .q_children import CODED_SQL
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS flag, round(avg(CASE WHEN {f} = 1 THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct FROM a"
        for f in _FLAGS)
    return f"WITH a AS ({CODED_SQL}) {parts}"


@register("flag_prevalence", sql=_prev_sql())
def q_prevalence(spark, sf):
    from .q_children import q_coded
    return P.flag_prevalence(q_coded(spark, sf), _FLAGS)


@register("balance_histogram", sql="""
WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
x AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((c_acctbal - lo) / ((hi - lo) / 20.0)), 19) END AS INTEGER)
             AS bin, lo, hi FROM customer, b WHERE c_acctbal IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / 20.0), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / 20.0), 6) AS upper,
       count(*) AS n
FROM x GROUP BY bin, lo, hi
""")
def q_hist(spark, sf):
    return P.histogram(_t(spark, sf, "customer"), "c_acctbal", 20)


@register("busiest_entity", sql="""
WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, n FROM g ORDER BY n DESC, o_custkey LIMIT 1
""")
def q_best(spark, sf):
    return P.best_by(P.group_sizes(_t(spark, sf, "orders"), "o_custkey"), "o_custkey", "n")


@register("ranked_entities", sql="""
WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
t AS (SELECT * FROM g ORDER BY n DESC, o_custkey LIMIT 10)
SELECT o_custkey, n, CAST(row_number() OVER (ORDER BY n DESC, o_custkey) AS INTEGER) AS rank FROM t
""")
def q_ranked(spark, sf):
    top = P.group_sizes(_t(spark, sf, "orders"), "o_custkey").orderBy(F.desc("n"), "o_custkey").limit(10)
    return P.ranked(top, [F.desc("n"), F.asc("o_custkey")])


@register("first_seen_types", sql=f"""
SELECT p_type, min(l_orderkey) AS first_position FROM {CHILD_SQL} c GROUP BY p_type
""")
def q_first_seen(spark, sf):
    return P.first_seen(coded_children(spark, sf), "p_type", "l_orderkey")


@register("distinct_counts", sql="""
SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS n_entities_with_events,
       (SELECT count(DISTINCT p_brand) FROM part) AS n_codes,
       (SELECT count(DISTINCT event_type) FROM events) AS n_items
""")
def q_distinct(spark, sf):
    a = _t(spark, sf, "orders").agg(F.count_distinct("o_custkey").alias("n_entities_with_events"))
    b = _t(spark, sf, "part").agg(F.count_distinct("p_brand").alias("n_codes"))
    c = _t(spark, sf, "events").agg(F.count_distinct("event_type").alias("n_items"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


@register("code_partition", sql=f"""
SELECT CASE WHEN coalesce(p_brand IN ({", ".join(f"'{b}'" for b in PRIMARY_CODES)}), false)
            THEN 'primary' ELSE 'other' END AS part, count(*) AS n_rows, count(DISTINCT p_brand) AS n_codes
FROM {CHILD_SQL} c GROUP BY part
""")
def q_partition(spark, sf):
    """Split child rows by an IN-list and its complement (NULL codes go to the
    complement), counting each side."""
    inside = F.coalesce(F.col("p_brand").isin(PRIMARY_CODES), F.lit(False))
    part = F.when(inside, "primary").otherwise("other").alias("part")
    # to one row for each code first: the distinct count then needs no second pass
    codes = coded_children(spark, sf).groupBy(part, "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return codes.groupBy("part").agg(F.sum("n").alias("n_rows"), F.count("p_brand").alias("n_codes"))


@register("secondary_code_top", sql=f"""
SELECT p_brand, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct
FROM {CHILD_SQL} c WHERE l_linenumber > 1 GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10
""")
def q_secondary(spark, sf):
    """Range filter (secondary positions, sequence number > 1) then top codes."""
    return P.frequency(coded_children(spark, sf).filter(F.col("l_linenumber") > 1), "p_brand", top=10)


@register("dataset_summary", sql=f"""
WITH ev AS ({ORDERS_EVENTS_SQL}),
cu AS (SELECT c_custkey, c_mktsegment,
              TIMESTAMP '1920-01-01' + to_days(CAST((c_custkey * 37) % 25000 AS INTEGER)) AS c_birth FROM customer),
j AS (SELECT ev.*, cu.c_mktsegment, {days_sql('cu.c_birth', 'ev.o_orderdate')} / 365.25 AS age,
             {days_sql('ev.o_orderdate', 'ev.o_enddate')} AS los,
             {days_sql('lag(ev.o_enddate) OVER (PARTITION BY ev.o_custkey ORDER BY ev.o_orderdate, ev.o_orderkey)', 'ev.o_orderdate')} AS gap
      FROM ev JOIN cu ON cu.c_custkey = ev.o_custkey)
SELECT (SELECT count(*) FROM customer) AS n_entities, count(*) AS n_events,
       count(DISTINCT o_custkey) AS n_entities_with_events,
       round(count(*) * 1.0 / count(DISTINCT o_custkey), 6) AS events_per_entity,
       round(avg(age), 6) AS mean_age, round(quantile_cont(age, 0.5), 6) AS median_age,
       round(avg(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_segment,
       round(avg(los), 6) AS mean_los, round(quantile_cont(los, 0.5), 6) AS median_los,
       round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_urgent,
       round(count(*) FILTER (WHERE gap > 0 AND gap <= 30) * 100.0 / count(*), 4) AS readmit_30_pct,
       round(count(*) FILTER (WHERE gap > 0 AND gap <= 60) * 100.0 / count(*), 4) AS readmit_60_pct
FROM j
""")
def q_summary(spark, sf):
    """Dataset summary (the EDA block): one joined events-entities frame,
    one conditional aggregate, exact medians from the distributed quantiles."""
    from ..operators.label import gap_to_previous
    from .q_cohort import customer_entities
    ev = orders_events(spark, sf)
    g = gap_to_previous(ev, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate", gap_col="gap")
    j = g.join(customer_entities(spark, sf), g.o_custkey == F.col("c_custkey"))
    from ..functions.time import years_between
    j = j.select("o_custkey", "o_orderpriority", "c_mktsegment", "gap",
                 years_between("c_birth", "o_orderdate").alias("age"),
                 elapsed_days("o_orderdate", "o_enddate").alias("los"))
    from ..session import cut_lineage
    j = cut_lineage(j, "summary")  # read by the aggregate and the two medians
    medians = exact_quantiles_of(j, {"age": [0.5], "los": [0.5]}, materialize=False)
    med_age, med_los = medians["age"][0], medians["los"][0]
    gap = F.col("gap")
    one = j.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("o_custkey").alias("n_entities_with_events"),
                F.avg("age").alias("_age"), F.avg((F.col("c_mktsegment") == "AUTOMOBILE").cast("double")).alias("_seg"),
                F.avg("los").alias("_los"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("_urg"),
                F.count_if((gap > 0) & (gap <= 30)).alias("_r30"), F.count_if((gap > 0) & (gap <= 60)).alias("_r60"))
    n_ent = _t(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n_entities"))
    one = one.crossJoin(F.broadcast(n_ent))
    return one.select(
        "n_entities", "n_events", "n_entities_with_events",
        F.round(F.col("n_events") / F.col("n_entities_with_events"), 6).alias("events_per_entity"),
        F.round("_age", 6).alias("mean_age"), F.round(F.lit(med_age), 6).alias("median_age"),
        F.round(F.col("_seg") * 100, 4).alias("pct_segment"), F.round("_los", 6).alias("mean_los"),
        F.round(F.lit(float(med_los)), 6).alias("median_los"), F.round(F.col("_urg") * 100, 4).alias("pct_urgent"),
        F.round(F.col("_r30") * 100.0 / F.col("n_events"), 4).alias("readmit_30_pct"),
        F.round(F.col("_r60") * 100.0 / F.col("n_events"), 4).alias("readmit_60_pct"))
