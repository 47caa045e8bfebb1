"""Table sources and sinks.

Parquet is the default format (column pruning and predicate pushdown reach
the scan); CSV with a header is supported with a declared schema, text
timestamps parsed by the reader's ``timestampFormat``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import CLINICAL

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table_path(base: str, name: str, fmt: str = "parquet") -> str:
    p = os.path.join(base, f"{name}.{fmt}")
    return p if os.path.exists(p) or "://" in base else os.path.join(base, name)


def read_parquet(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(base, name, "parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Header CSV with a declared schema; text timestamps parsed by the reader
    (rows that do not parse become NULL in PERMISSIVE mode)."""
    return (spark.read.schema(schema)
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("timestampNTZFormat", timestamp_format)
            .option("timestampFormat", timestamp_format)
            .csv(path))


def read_clinical(spark: SparkSession, base: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """The six clinical tables (``patients.csv``, ``admissions.csv`` ...)."""
    out = {}
    for name, schema in CLINICAL.items():
        if fmt == "csv":
            out[name] = nan_to_null(read_csv(spark, os.path.join(base, f"{name}.csv"), schema))
        else:
            out[name] = spark.read.schema(schema).parquet(os.path.join(base, f"{name}.parquet"))
    return out


def load_tables(spark: SparkSession, base: str,
                names: Iterable[str] = DRIVER_TABLES) -> dict[str, DataFrame]:
    return {n: read_parquet(spark, base, n) for n in names}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in floating columns (pandas treats NaN as missing; Spark
    keeps NaN as a value unless told otherwise)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Iterable[str] | None = None) -> None:
    """Sink: Parquet by default, header CSV on request (no index column)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    else:
        w.format(fmt).save(path)


def table_overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows)``: one count aggregate per table, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
