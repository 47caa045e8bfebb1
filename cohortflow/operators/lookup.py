"""Code -> description lookups and many-to-one group mappings.

Both join to a literal table built from a Python mapping, whose row count is
the mapping's size: that proven bound is what makes the broadcast safe. A
mapping held in a DataFrame of unknown size is joined without a hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def membership_table(spark: SparkSession, groups: Mapping[str, Sequence[str]],
                     member: str = "member", group: str = "group_name") -> DataFrame:
    """``(member, group)`` rows from ``{group: [members]}``; a member listed
    in several groups appears once per group."""
    rows = [(m, g) for g, ms in groups.items() for m in ms]
    return spark.createDataFrame(rows, f"{member} string, {group} string")


def map_groups(df: DataFrame, col: str, groups: Mapping[str, Sequence[str]] | DataFrame,
               out: str = "group_name", keep_unmatched: bool = False,
               member: str = "member") -> DataFrame:
    """Attach the group(s) of ``col``: inner join (or left with
    ``keep_unmatched``) to the membership table."""
    if isinstance(groups, DataFrame):
        table = groups.withColumnRenamed(member, "_mg_m")
    else:
        table = F.broadcast(membership_table(df.sparkSession, groups, "_mg_m", out))
    j = df.join(table, df[col] == F.col("_mg_m"), "left" if keep_unmatched else "inner")
    return j.drop("_mg_m")


def describe_codes(df: DataFrame, col: str, descriptions: Mapping[str, str],
                   default_prefix: str = "Unknown", out: str = "description") -> DataFrame:
    """``dict.get(code, f'{default_prefix} {code}')`` as a broadcast left join."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(list(descriptions.items()), "_dc_code string, _dc_desc string"))
    j = df.join(table, df[col].cast("string") == F.col("_dc_code"), "left")
    default = F.concat(F.lit(default_prefix + " "), F.col(col).cast("string"))
    return j.withColumn(out, F.coalesce(F.col("_dc_desc"), default)).drop("_dc_code", "_dc_desc")
