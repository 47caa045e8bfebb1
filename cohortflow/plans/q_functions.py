"""Lookup and scalar-function queries."""

from pyspark.sql import functions as F

from ..functions.expr import (abnormality, clamp, cyclical, first_match_tag, last_token, scaled_cap,
                              weekend_flag, zero_pad)
from ..functions.time import elapsed_days, fractional_days
from ..operators.lookup import describe_codes, map_groups
from ..operators.profile import first_seen, frequency
from ..sources.io import read_parquet
from .bindings import CODE_GROUPS, coded_children
from .q_children import CHILD_SQL
from .registry import register

# Fixed binding values: descriptions for a few codes, an overlapping group
CODE_DESCRIPTIONS = {"Brand#1": "Primary code one", "Brand#2": "Primary code two",
                     "Brand#7": "Group A code", "Brand#12": "Group C code"}
OVERLAP_GROUPS = {**CODE_GROUPS, "group_ac": ["Brand#7", "Brand#12"]}
NAME_TAGS = [("red", "colour"), ("blue", "colour"), ("ring", "shape"), ("bolt", "hardware"),
             ("widget", "device")]


@register("top_codes_described", sql=f"""
WITH g AS (SELECT p_brand, count(*) AS n FROM {CHILD_SQL} c GROUP BY p_brand),
t AS (SELECT p_brand, n, round(n * 100.0 / (SELECT sum(n) FROM g), 4) AS pct FROM g ORDER BY n DESC, p_brand LIMIT 15)
SELECT p_brand, n, pct, CASE p_brand {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CODE_DESCRIPTIONS.items())}
                        ELSE 'Unknown ' || p_brand END AS description FROM t
""")
def q_described(spark, sf):
    top = frequency(coded_children(spark, sf), "p_brand", top=15)
    return describe_codes(top, "p_brand", CODE_DESCRIPTIONS)


@register("code_group_counts", sql=f"""
WITH m AS ({' UNION ALL '.join(f"SELECT '{m}' AS member, '{g}' AS group_name" for g, ms in OVERLAP_GROUPS.items() for m in ms)})
SELECT group_name, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_events
FROM {CHILD_SQL} c JOIN m ON m.member = c.p_brand GROUP BY group_name
""")
def q_group_counts(spark, sf):
    m = map_groups(coded_children(spark, sf), "p_brand", OVERLAP_GROUPS)
    return m.groupBy("group_name").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count_distinct("l_orderkey").alias("n_events"))


@register("text_functions", sql=f"""
SELECT p_partkey, string_split(trim(p_name), ' ')[-1] AS name_unit,
       CAST(contains(p_name, 'red') AS INTEGER) AS is_red, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS padded_id,
       CASE {' '.join(f"WHEN contains(p_name, '{n}') THEN '{t}'" for n, t in NAME_TAGS)} ELSE 'other' END AS theme
FROM part
""")
def q_text(spark, sf):
    p = read_parquet(spark, sf, "part")
    return p.select("p_partkey", last_token("p_name").alias("name_unit"),
                    F.col("p_name").contains("red").cast("int").alias("is_red"),
                    zero_pad("p_partkey", 10).alias("padded_id"),
                    first_match_tag("p_name", NAME_TAGS, "other").alias("theme"))


@register("theme_first_seen", sql=f"""
WITH t AS (SELECT p_partkey, CASE {' '.join(f"WHEN contains(p_name, '{n}') THEN '{t}'" for n, t in NAME_TAGS)} ELSE 'other' END AS theme
           FROM part)
SELECT theme, min(p_partkey) AS first_position FROM t GROUP BY theme ORDER BY first_position LIMIT 8
""")
def q_theme(spark, sf):
    p = read_parquet(spark, sf, "part").select("p_partkey", first_match_tag("p_name", NAME_TAGS, "other").alias("theme"))
    return first_seen(p, "theme", "p_partkey").orderBy("first_position").limit(8)


@register("normalised_values", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(least(greatest(l_quantity - 25, 0) / 10.0, 1.0), 6) AS qty_abnormal,
       round(greatest(0.05 - l_discount, 0) / 0.05, 6) AS discount_low,
       greatest(least(l_tax, 0.06), 0.02) AS tax_clamped,
       round(least(l_quantity / 30.0, 1.0), 6) AS qty_norm,
       round(l_quantity / 50.0, 6) AS qty_uncapped,
       round(pow(l_quantity, 2), 6) AS qty_squared, round(l_quantity * l_discount, 6) AS qty_x_discount
FROM lineitem
""")
def q_norms(spark, sf):
    li = read_parquet(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.round(abnormality("l_quantity", 25, 10), 6).alias("qty_abnormal"),
                     F.round(abnormality("l_discount", 0.05, 0.05, "below", cap=None), 6).alias("discount_low"),
                     clamp("l_tax", 0.02, 0.06).alias("tax_clamped"),
                     F.round(scaled_cap("l_quantity", 30), 6).alias("qty_norm"),
                     F.round(scaled_cap("l_quantity", 50, cap=None), 6).alias("qty_uncapped"),
                     F.round(F.pow("l_quantity", 2), 6).alias("qty_squared"),
                     F.round(F.col("l_quantity") * F.col("l_discount"), 6).alias("qty_x_discount"))


@register("calendar_features", sql="""
SELECT event_id,
       CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 86400000000.0) AS BIGINT) AS days_since_start,
       round(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 86400000000.0, 2) AS frac_days,
       CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
       CAST(isodow(ts) >= 6 AS INTEGER) AS weekend, strftime(ts, '%Y-%m-%d') AS day,
       round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS weekday_sin,
       round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS weekday_cos
FROM events
""")
def q_calendar_features(spark, sf):
    e = read_parquet(spark, sf, "events")
    start = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    s, c = cyclical(F.weekday("ts"), 7)
    return e.select("event_id", elapsed_days(start, "ts").alias("days_since_start"),
                    fractional_days(start, "ts").alias("frac_days"), F.month("ts").alias("month"),
                    F.weekday("ts").alias("weekday"), weekend_flag("ts").alias("weekend"),
                    F.date_format("ts", "yyyy-MM-dd").alias("day"),
                    (F.round(s, 6) + F.lit(0.0)).alias("weekday_sin"),
                    (F.round(c, 6) + F.lit(0.0)).alias("weekday_cos"))


@register("timestamp_text_parse", sql="""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'not a time'
                                   ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS txt FROM orders)
SELECT o_orderkey, txt, try_strptime(txt, '%Y-%m-%d %H:%M:%S') AS parsed FROM t
""")
def q_parse(spark, sf):
    from ..functions.time import parse_timestamp
    o = read_parquet(spark, sf, "orders")
    txt = F.when(F.col("o_orderkey") % 97 == 0, F.lit("not a time")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", txt.alias("txt")).withColumn("parsed", parse_timestamp("txt"))


@register("stream_scoring_batch", sql="""
WITH e AS (SELECT o_orderkey, o_orderdate,
                  CAST(floor(date_diff('microsecond', o_orderdate, o_orderdate + to_days(CAST(1 + o_orderkey % 10 AS INTEGER))) / 86400000000.0) AS BIGINT) AS los_days,
                  CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS urgent, CAST(o_totalprice > 300000 AS INTEGER) AS large
           FROM orders),
s AS (SELECT *, round(least((CASE WHEN los_days > 7 THEN 2 WHEN los_days > 3 THEN 1 ELSE 0 END + urgent + large) / 10.0, 0.95), 4) AS score FROM e)
SELECT o_orderkey, o_orderdate, los_days,
       CASE WHEN los_days > 0 AND los_days <= 3 THEN 'Short' WHEN los_days > 3 AND los_days <= 7 THEN 'Medium'
            WHEN los_days > 7 AND los_days <= 14 THEN 'Long' WHEN los_days > 14 AND los_days <= 30 THEN 'Extended'
            WHEN los_days > 30 AND los_days <= 1000 THEN 'Very_Long' END AS los_band,
       urgent, large, score,
       CASE WHEN score >= 0.7 THEN 'High Risk' WHEN score >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_tier,
       CASE WHEN los_days > 7 OR urgent = 1 OR large = 1 THEN
         array_to_string(list_filter([CASE WHEN los_days > 7 THEN 'Extended stay' END,
                                      CASE WHEN urgent = 1 THEN 'Urgent event' END,
                                      CASE WHEN large = 1 THEN 'Large order' END], lambda x: x IS NOT NULL), '; ')
       ELSE 'No major risk factors identified' END AS reasons
FROM s
""")
def q_stream_batch(spark, sf):
    """The streaming scorer's expressions on the batch table (same code path)."""
    from ..streaming.scoring import score_events
    return score_events(read_parquet(spark, sf, "orders"))
