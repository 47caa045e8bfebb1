"""Source, sink and re-alignment queries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources.io import read_csv, read_parquet, write_table
from .q_eval import SCORE_CTE, score_table
from .registry import register

_ORDERS_CSV = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                            T.StructField("o_orderpriority", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
                            T.StructField("o_orderdate", T.TimestampNTZType())])


@register("csv_round_trip", sql="""
SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
       strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS o_orderdate
FROM orders
""")
def q_csv(spark, sf):
    """Orders through the CSV sink (header, no index) and the typed CSV scan, timestamps parsed by the reader."""
    path = scratch_path(spark, "orders-csv")
    cols = [F.col(f.name).cast(f.dataType) for f in _ORDERS_CSV.fields]
    write_table(read_parquet(spark, sf, "orders").select(*cols), path, fmt="csv")
    back = read_csv(spark, path, _ORDERS_CSV)
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@register("scores_with_source_rows", sql=f"""
WITH {SCORE_CTE}
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, st.score, st.label
FROM st JOIN orders o ON o.o_orderkey = st.o_orderkey
""")
def q_scores_with_source(spark, sf):
    """Scores aligned with their source rows again, by the event key."""
    scores = score_table(spark, sf).select(F.col("o_orderkey").alias("_k"), "score", "label")
    src = read_parquet(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return src.join(scores, F.col("o_orderkey") == F.col("_k")).drop("_k")
