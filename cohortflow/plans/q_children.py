"""Child-table feature queries (codes, subset stays, measurements, drugs)."""

from pyspark.sql import functions as F

from ..operators.children import (ItemRule, aggregate_children, attach, coded_spec, drug_spec,
                                  exists_flag, measured_spec, subset_spec)
from ..sources.io import read_parquet
from .bindings import (CODE_GROUPS, DRUG_CLASSES, EVENT_ITEM_RULES, ITEM_RULES, PRIMARY_CODES,
                       SUBTYPE_GROUPS, coded_children)
from .registry import register


def _inlist(values):
    return ", ".join(f"'{v}'" for v in values)


def _any(col, values):
    return f"CAST(coalesce(max(CASE WHEN {col} IN ({_inlist(values)}) THEN 1 ELSE 0 END), 0) AS INTEGER)"


CHILD_SQL = """(SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity, l.l_returnflag,
        l.l_shipdate, l.l_suppkey, p.p_brand, p.p_type
 FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""

PRODUCTS = {"combo_a_c": ("group_a", "group_c"), "combo_primary_c": ("primary", "group_c")}


def coded_features_spec():
    return coded_spec("p_brand", PRIMARY_CODES, CODE_GROUPS, SUBTYPE_GROUPS, products=PRODUCTS)


def _coded_sql_inner():
    flags = ",\n  ".join(f"{_any('p_brand', v)} AS has_{k}"
                         for k, v in {**CODE_GROUPS, **SUBTYPE_GROUPS}.items())
    return f"""SELECT l_orderkey, count(*) AS total_codes,
  count(*) FILTER (WHERE p_brand IN ({_inlist(PRIMARY_CODES)})) AS primary_count,
  {flags}
FROM {CHILD_SQL} c GROUP BY l_orderkey"""


GROUP_SUM = " + ".join(f"has_{k}" for k in CODE_GROUPS)

CODED_SQL = f"""
WITH a AS ({_coded_sql_inner()})
SELECT *, CAST({GROUP_SUM} AS INTEGER) AS group_count,
       CAST(total_codes + primary_count + {GROUP_SUM} AS BIGINT) AS complexity_score,
       CAST(has_group_a * has_group_c AS INTEGER) AS combo_a_c,
       CAST((primary_count > 0)::INTEGER * has_group_c AS INTEGER) AS combo_primary_c
FROM a
"""


@register("coded_child_features", sql=CODED_SQL)
def q_coded(spark, sf_dir):
    return aggregate_children(coded_children(spark, sf_dir), "l_orderkey", [coded_features_spec()])


SUBSET_SQL = """
WITH o AS (SELECT o_orderkey FROM orders),
s AS (SELECT l_orderkey, count(*) AS r_count, sum(l_quantity) AS r_sum, max(l_quantity) AS r_max
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o.o_orderkey, coalesce(r_count, 0) AS r_count, round(coalesce(r_sum, 0.0), 6) AS r_sum,
       coalesce(r_max, 0.0) AS r_max, CAST(coalesce(r_count, 0) > 0 AS INTEGER) AS has_r,
       round(ln(1 + coalesce(r_sum, 0.0)), 6) AS r_sum_log
FROM o LEFT JOIN s ON s.l_orderkey = o.o_orderkey
"""


@register("subset_child_features", sql=SUBSET_SQL)
def q_subset(spark, sf_dir):
    li = read_parquet(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    spec = subset_spec("l_quantity", prefix="r")
    feats = aggregate_children(li, "l_orderkey", [spec])
    ev = read_parquet(spark, sf_dir, "orders").select("o_orderkey")
    out = attach(ev, feats, "o_orderkey", "l_orderkey", spec.fill)
    return out.select("o_orderkey", "r_count", F.round("r_sum", 6).alias("r_sum"), "r_max", "has_r",
                      F.round("r_sum_log", 6).alias("r_sum_log"))


def item_rules(rules):
    return [ItemRule(f"item_{str(i).lower()}", i, d, a, b) for i, d, a, b in rules]


def _measured_sql(table, key, item, value, order, rules, ratio):
    parts = []
    for r in item_rules(rules):
        n, m = r.name, f"{item} = '{r.item}'"
        parts.append(f"""
  arg_min_null({value}, ({order})) FILTER (WHERE {m}) AS {n}_first,
  arg_max_null({value}, ({order})) FILTER (WHERE {m}) AS {n}_last,
  avg({value}) FILTER (WHERE {m}) AS {n}_mean,
  max({value}) FILTER (WHERE {m}) AS {n}_max,
  min({value}) FILTER (WHERE {m}) AS {n}_min,
  stddev_samp({value}) FILTER (WHERE {m}) AS {n}_sd,
  count(*) FILTER (WHERE {m}) AS {n}_n""")
    post = []
    for r in item_rules(rules):
        n = r.name
        if r.direction == "high":
            f1 = f"CAST(coalesce({n}_last > {r.mild}, false) AS INTEGER) AS {n}_elevated"
            f2 = f"CAST(coalesce({n}_last > {r.severe}, false) AS INTEGER) AS {n}_severe"
        else:
            f1 = f"CAST(coalesce({n}_last < {r.mild}, false) AS INTEGER) AS {n}_low"
            f2 = f"CAST(coalesce({n}_last < {r.severe}, false) AS INTEGER) AS {n}_very_low"
        post.append(f"""{n}_first, {n}_last, round({n}_mean, 6) AS {n}_mean, {n}_max, {n}_min,
  round(CASE WHEN {n}_n = 1 THEN 0.0 ELSE {n}_sd END, 6) AS {n}_std,
  {n}_last - {n}_first AS {n}_trend, CAST({n}_n > 0 AS INTEGER) AS has_{n}, {f1}, {f2}""")
    rname, num, den, fl = ratio
    post.append(f"""round(CASE WHEN item_{num}_n > 0 AND item_{den}_n > 0
    THEN item_{num}_last / greatest(item_{den}_last, {fl}) END, 6) AS {rname}""")
    return f"""
WITH a AS (SELECT {key}, count(*) AS total_measurements, {','.join(parts)}
           FROM {table} GROUP BY {key})
SELECT {key}, total_measurements, {', '.join(post)} FROM a
"""


def _round_measured(df, rules, ratio_name):
    cols = []
    for c in df.columns:
        if c.endswith("_mean") or c.endswith("_std") or c == ratio_name:
            cols.append(F.round(c, 6).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


LI_ORDER = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity"


@register("measured_child_features", sql=_measured_sql(
    "lineitem", "l_orderkey", "l_returnflag", "l_quantity", LI_ORDER, ITEM_RULES,
    ("ratio_r_a", "r", "a", 0.1)))
def q_measured(spark, sf_dir):
    li = read_parquet(spark, sf_dir, "lineitem")
    spec = measured_spec("l_returnflag", "l_quantity", LI_ORDER.split(", "),
                         item_rules(ITEM_RULES), ratio=("ratio_r_a", "item_r", "item_a", 0.1))
    return _round_measured(aggregate_children(li, "l_orderkey", [spec]), ITEM_RULES, "ratio_r_a")


@register("entity_measurement_features", sql=_measured_sql(
    "events", "user_id", "event_type", "value", "ts, event_id", EVENT_ITEM_RULES,
    ("ratio_purchase_click", "purchase", "click", 0.1)))
def q_event_measured(spark, sf_dir):
    ev = read_parquet(spark, sf_dir, "events")
    spec = measured_spec("event_type", "value", ["ts", "event_id"], item_rules(EVENT_ITEM_RULES),
                         ratio=("ratio_purchase_click", "item_purchase", "item_click", 0.1))
    return _round_measured(aggregate_children(ev, "user_id", [spec]), EVENT_ITEM_RULES,
                           "ratio_purchase_click")


GUIDELINE = (["class_ace", "class_arb"], "class_bb", "class_diu")


def drug_features_spec():
    return drug_spec("p_brand", DRUG_CLASSES, guideline=GUIDELINE)


_DRUG_FLAGS = ",\n  ".join(f"{_any('p_brand', v)} AS has_{k}" for k, v in DRUG_CLASSES.items())
_CLASS_SUM = " + ".join(f"has_{k}" for k in DRUG_CLASSES)
DRUG_SQL = f"""
WITH a AS (SELECT l_orderkey, count(*) AS total_drugs, count(DISTINCT p_brand) AS unique_drugs,
  {_DRUG_FLAGS}
  FROM {CHILD_SQL} c GROUP BY l_orderkey),
b AS (SELECT *, CAST({_CLASS_SUM} AS INTEGER) AS class_count,
        CAST(total_drugs >= 10 AS INTEGER) AS polypharmacy,
        CAST(greatest(has_class_ace, has_class_arb) + has_class_bb + has_class_diu AS INTEGER)
          AS guideline_score FROM a)
SELECT *, CAST(guideline_score >= 3 AS INTEGER) AS optimal_therapy,
       CAST(guideline_score < 2 AS INTEGER) AS suboptimal_therapy FROM b
"""


@register("drug_child_features", sql=DRUG_SQL)
def q_drugs(spark, sf_dir):
    return aggregate_children(coded_children(spark, sf_dir), "l_orderkey", [drug_features_spec()])


@register("exists_child_flag", sql="""
SELECT o_orderkey, CAST(EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
                                AND l.l_returnflag = 'R') AS INTEGER) AS has_r_line
FROM orders o
""")
def q_exists(spark, sf_dir):
    o = read_parquet(spark, sf_dir, "orders").select("o_orderkey")
    r = read_parquet(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    return exists_flag(o, r, "o_orderkey", "l_orderkey", "has_r_line")


@register("semi_join_events", sql="""
SELECT o_orderkey, o_custkey FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
""")
def q_semi(spark, sf_dir):
    o = read_parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    r = read_parquet(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    return o.join(r, o.o_orderkey == r.l_orderkey, "left_semi")
