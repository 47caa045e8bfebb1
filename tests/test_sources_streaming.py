import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from cohortflow.sources.io import nan_to_null, read_clinical, table_overview, write_table
from cohortflow.sources.schemas import CLINICAL
from cohortflow.streaming.scoring import order_stream, score_events

from .conftest import SF
from .test_clinical_and_props import _clinical_tables


def run_to_memory(stream, name, checkpoint):
    """All available input through an append-mode memory sink (tests only: it holds the output on the driver)."""
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).start())
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_csv_sink_and_scan_roundtrip(spark):
    tables = _clinical_tables(spark)
    base = tempfile.mkdtemp(prefix="cohortflow-csv-")
    for name, df in tables.items():
        write_table(df, os.path.join(base, f"{name}.csv"), fmt="csv")
    back = read_clinical(spark, base, fmt="csv")
    for name, df in tables.items():
        assert back[name].schema == CLINICAL[name] or [f.dataType for f in back[name].schema] == \
            [f.dataType for f in CLINICAL[name]]
        assert back[name].exceptAll(df).count() == 0 and df.exceptAll(back[name]).count() == 0
    counts = {r["table_name"]: r["n_rows"] for r in table_overview(back).collect()}
    assert counts["admissions"] == 6 and counts["patients"] == 2


def test_csv_bad_timestamp_is_null(spark):
    base = tempfile.mkdtemp(prefix="cohortflow-csv-bad-")
    p = os.path.join(base, "diag.csv")
    with open(p, "w") as f:
        f.write("SUBJECT_ID,HADM_ID,ICUSTAY_ID,FIRST_CAREUNIT,LAST_CAREUNIT,FIRST_WARDID,LAST_WARDID,"
                "INTIME,OUTTIME,LOS\n1,2,3,CCU,CCU,1,1,2010-01-01 10:00:00,garbage,1.5\n")
    from cohortflow.sources.io import read_csv
    r = read_csv(spark, p, CLINICAL["icustays"]).collect()[0]
    assert r["INTIME"] == dt.datetime(2010, 1, 1, 10) and r["OUTTIME"] is None


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert nan_to_null(df).filter(F.col("x").isNull()).count() == 1


def test_stream_scoring_matches_batch(spark):
    src = os.path.join(SF, "orders.parquet")
    ck = tempfile.mkdtemp(prefix="cohortflow-stream-")
    out = run_to_memory(score_events(order_stream(spark, SF)), "scored_orders", ck)
    batch = score_events(spark.read.parquet(src))
    assert out.count() == batch.count()
    assert out.exceptAll(batch).count() == 0


def test_scoring_takes_other_columns(spark):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 20), True)], "id long, s timestamp_ntz, e timestamp_ntz, u boolean")
    r = score_events(df, start="s", key="id", end=F.col("e"), urgent=F.col("u").cast("int"), large=F.lit(0)).first()
    assert r["los_days"] == 19 and r["urgent"] == 1 and "Extended stay" in r["reasons"]
