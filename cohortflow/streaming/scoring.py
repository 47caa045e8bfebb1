"""Structured Streaming: the stateless row operators (indicators, bins,
clamps, time arithmetic, rule score, tier, reason codes) are plain column
expressions, so they apply unchanged to a ``readStream`` DataFrame. The
reference has no stream source, window or state, so nothing stateful is
offered here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import cut, equals_flag
from ..functions.fixed import LOS_EDGES, LOS_LABELS
from ..functions.time import add_days, elapsed_days
from ..operators.score import additive_score, reason_codes, risk_tier


def order_stream(spark: SparkSession, directory: str, pattern: str = "orders*.parquet",
                 schema: T.StructType | None = None, max_files_per_trigger: int = 1) -> DataFrame:
    """Orders as a Parquet file stream: new files matching ``pattern`` in
    ``directory`` are picked up as they arrive."""
    if schema is None:
        schema = spark.read.option("pathGlobFilter", pattern).parquet(directory).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(directory))


def score_events(events: DataFrame, start: str = "o_orderdate", key: str = "o_orderkey",
                 end: Column | None = None, urgent: Column | None = None, large: Column | None = None) -> DataFrame:
    """Per-event rule score on a batch or streaming frame: stay length, urgency
    flag and size flag -> score, tier and reasons. ``end``, ``urgent`` and
    ``large`` are columns of the caller's frame; by default those of the orders binding."""
    end = add_days(F.col(start), F.lit(1) + F.col(key) % 10) if end is None else end
    urgent = equals_flag("o_orderpriority", "1-URGENT") if urgent is None else urgent
    large = (F.col("o_totalprice") > 300000).cast("int") if large is None else large
    los = elapsed_days(F.col(start), end)
    d = events.select(key, start, los.alias("los_days"),
                      cut(los, LOS_EDGES, LOS_LABELS).alias("los_band"),
                      urgent.alias("urgent"), large.alias("large"))
    score = additive_score({"los_days": [(7, 2), (3, 1)]}, flags={"urgent": 1, "large": 1})
    d = d.withColumn("score", F.round(score, 4)).withColumn("risk_tier", risk_tier("score"))
    reasons = reason_codes([(F.col("los_days") > 7, "Extended stay"), (F.col("urgent") == 1, "Urgent event"),
                            (F.col("large") == 1, "Large order")])
    return d.withColumn("reasons", F.array_join(reasons, "; "))
