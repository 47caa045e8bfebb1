import os

import pytest
from pyspark.sql import types as T

SF = os.environ.get("COHORTFLOW_TEST_SF", "/root/testdata/sf0.001")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make(spark):
    """A documents table of (doc_id, text) pairs or longer rows, over several partitions."""
    def of(rows, parts=3):
        rows = [(*r, *("en", "src0", None)[len(r) - 2:]) for r in rows]
        return spark.createDataFrame(rows, DOCS).repartition(parts) if rows else spark.createDataFrame([], DOCS)
    return of
