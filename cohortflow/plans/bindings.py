"""Role binding of the generic operators to the driver's tables.

| role                 | driver table / expression                                     |
|----------------------|---------------------------------------------------------------|
| entity               | customer.c_custkey                                            |
| event                | orders: id o_orderkey, entity o_custkey, start o_orderdate    |
| event end            | o_orderdate + (1 + o_orderkey % 10) days (derived)            |
| coded child          | lineitem (by l_orderkey) joined to part: code p_brand         |
| subset child ("ICU") | lineitem with l_returnflag = 'R', stay length l_quantity      |
| measured child       | lineitem items by l_returnflag, value l_quantity;             |
|                      | events: entity user_id, item event_type, value, time ts       |
| scores / labels      | rule score over the event features; labels.quality            |
| vectors              | embeddings.embedding                                          |

Everything is lazy: these return DataFrames over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import add_days
from ..sources.io import read_parquet

# Fixed binding values (code lists and drug classes over p_brand; rule
# parameters for the measured items). They stand in for the clinical code
# lists, which do not exist in the driver tables.
PRIMARY_CODES = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]
CODE_GROUPS = {
    "group_a": ["Brand#6", "Brand#7"],
    "group_b": ["Brand#8", "Brand#9", "Brand#10"],
    "group_c": ["Brand#11", "Brand#12"],
    "group_d": ["Brand#13", "Brand#14", "Brand#15"],
    "group_e": ["Brand#16"],
}
SUBTYPE_GROUPS = {
    "sub_x": ["Brand#1", "Brand#2"],
    "sub_y": ["Brand#3", "Brand#4"],
    "sub_z": ["Brand#5"],
}
DRUG_CLASSES = {
    "class_ace": ["Brand#17", "Brand#18"],
    "class_bb": ["Brand#19", "Brand#20"],
    "class_diu": ["Brand#21", "Brand#22"],
    "class_arb": ["Brand#23"],
    "class_other": ["Brand#24", "Brand#25"],
}
# item, direction, mild cut-off, severe cut-off
ITEM_RULES = [("A", "high", 40.0, 48.0), ("N", "low", 10.0, 5.0), ("R", "high", 25.0, 45.0)]
EVENT_ITEM_RULES = [("click", "high", 50.0, 150.0), ("purchase", "high", 100.0, 300.0),
                    ("view", "low", 5.0, 1.0)]


def orders_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated events with a derived end time."""
    o = read_parquet(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderdate",
        add_days(F.col("o_orderdate"), F.lit(1) + F.col("o_orderkey") % 10).alias("o_enddate"),
        "o_orderpriority", "o_orderstatus", "o_totalprice")


# DuckDB spelling of the same derived table, for the oracle SQL.
ORDERS_EVENTS_SQL = """
SELECT o_orderkey, o_custkey, o_orderdate,
       o_orderdate + to_days(CAST(1 + o_orderkey % 10 AS INTEGER)) AS o_enddate,
       o_orderpriority, o_orderstatus, o_totalprice
FROM orders
"""


def days_sql(a: str, b: str) -> str:
    """Floored elapsed days from ``a`` to ``b`` in DuckDB."""
    return f"CAST(floor(date_diff('microsecond', {a}, {b}) / 86400000000.0) AS BIGINT)"


def coded_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows per event with a code: lineitem joined to part."""
    li = read_parquet(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate",
        "l_suppkey")
    part = read_parquet(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey, "left")
