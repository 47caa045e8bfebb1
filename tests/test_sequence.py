import pytest
from pyspark.sql import functions as F

from cohortflow.functions.expr import cut
from cohortflow.functions.time import elapsed_days
from cohortflow.operators.history import history_features
from cohortflow.operators.label import readmission_label

from .fixtures import EXPECTED, events_df

LOS_EDGES = [0, 3, 7, 14, 30, 1000]
LOS_LABELS = ["Short", "Medium", "Long", "Extended", "Very_Long"]


@pytest.mark.parametrize("bucket_days", [0.25, 1, 7, 100000])
def test_label_fixture(spark, bucket_days):
    ev = events_df(spark)
    out = readmission_label(ev, "entity", "id", "start", "end", drop_last=False,
                            is_last_col="is_last", bucket_days=bucket_days)
    rows = {r["id"]: r for r in out.collect()}
    for i, exp in EXPECTED.items():
        assert rows[i]["gap_days"] == exp[0], (i, rows[i])
        assert rows[i]["label"] == exp[1]
        assert (not rows[i]["is_last"]) == exp[2]
    kept = readmission_label(ev, "entity", "id", "start", "end", bucket_days=bucket_days)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("bucket_days", [0.25, 1, 7, 100000])
def test_history_fixture(spark, bucket_days):
    ev = events_df(spark)
    out = history_features(ev, "entity", "id", "start", "end", bucket_days=bucket_days)
    out = out.withColumn("los", elapsed_days("start", "end")) \
             .withColumn("los_band", cut(F.col("los"), LOS_EDGES, LOS_LABELS))
    rows = {r["id"]: r for r in out.collect()}
    for i, exp in EXPECTED.items():
        r = rows[i]
        assert r["los"] == exp[3]
        assert r["los_band"] == exp[4]
        assert r["prior_count"] == exp[5], (i, r)
        assert r["days_since_last"] == exp[6], (i, r)
        assert r["had_prior_readmission"] == exp[7], (i, r)
        if exp[8] is None:
            assert r["avg_prior_los"] is None
        else:
            assert r["avg_prior_los"] == pytest.approx(exp[8])
        assert r["rate_per_year"] == pytest.approx(exp[9], abs=1e-4)
        assert r["frequent_flag"] == exp[10]


@pytest.mark.parametrize("rows", [1, 2, 1000])
def test_adaptive_buckets_fixture(spark, rows):
    ev = events_df(spark)
    out = history_features(ev, "entity", "id", "start", "end", rows_per_bucket=rows,
                           label_horizon=30)
    got = {r["id"]: r for r in out.collect()}
    for i, exp in EXPECTED.items():
        assert got[i]["prior_count"] == exp[5]
        assert got[i]["days_since_last"] == exp[6]
        assert got[i]["had_prior_readmission"] == exp[7]
        assert got[i]["label"] == exp[1]


def test_hot_entity_is_split(spark):
    """One entity with most of the events: adaptive buckets spread it, and
    the results equal the single-bucket scan."""
    import datetime as dt
    rows = [(1, i, dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * i),
             dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * i + 30)) for i in range(3000)]
    rows += [(2 + i % 50, 10000 + i, dt.datetime(2020, 3, 1) + dt.timedelta(days=i % 17),
              dt.datetime(2020, 3, 2) + dt.timedelta(days=i % 17)) for i in range(1000)]
    schema = "entity long, id long, start timestamp_ntz, end timestamp_ntz"
    ev = spark.createDataFrame(rows, schema)
    cols = ["id", "prior_count", "days_since_last", "had_prior_readmission", "rate_per_year", "label"]
    a = history_features(ev, "entity", "id", "start", "end", rows_per_bucket=100, label_horizon=30).select(cols)
    b = history_features(ev, "entity", "id", "start", "end", bucket_days=1e7, label_horizon=30).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    from cohortflow.operators.sequence import BK, _with_bucket
    n_buckets = _with_bucket(ev, "start", None, "entity", "id", 100).filter("entity = 1").select(BK).distinct().count()
    assert n_buckets >= 25


def test_bursty_hot_entity_second_level(spark):
    """A heavy entity whose events are almost all inside one short burst of a
    long span: the second level re-splits the dense cell; results unchanged."""
    import datetime as dt
    base = dt.datetime(2015, 1, 1)
    rows = [(1, i, base + dt.timedelta(days=400 * i), base + dt.timedelta(days=400 * i + 1)) for i in range(5)]
    rows += [(1, 100 + i, dt.datetime(2016, 6, 1) + dt.timedelta(minutes=3 * i),
              dt.datetime(2016, 6, 1) + dt.timedelta(minutes=3 * i + 90)) for i in range(2000)]
    rows += [(2, 9000 + i, base + dt.timedelta(days=i), base + dt.timedelta(days=i, hours=5)) for i in range(30)]
    ev = spark.createDataFrame(rows, "entity long, id long, start timestamp_ntz, end timestamp_ntz")
    from cohortflow.operators.sequence import BK, _with_bucket
    b = _with_bucket(ev, "start", None, "entity", "id", 100)
    biggest = b.groupBy("entity", BK).count().agg(F.max("count")).first()[0]
    assert biggest <= 250
    cols = ["id", "prior_count", "days_since_last", "had_prior_readmission", "avg_prior_los", "label"]
    a = history_features(ev, "entity", "id", "start", "end", rows_per_bucket=100, label_horizon=30).select(cols)
    c = history_features(ev, "entity", "id", "start", "end", bucket_days=1e7, label_horizon=30).select(cols)
    assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0


def test_null_entity_and_null_time(spark):
    """Rows without an entity belong to nobody; a missing start comes last."""
    import datetime as dt
    t = lambda d: None if d is None else dt.datetime(2021, 1, 1) + dt.timedelta(days=d)
    rows = [(None, 1, t(0), t(1)), (None, 2, t(3), t(4)), (None, 3, None, None), (7, 4, None, None), (7, 5, t(2), t(3)), (7, 6, t(10), t(11))]
    ev = spark.createDataFrame(rows, "entity long, id long, start timestamp_ntz, end timestamp_ntz")
    for how in ({"bucket_days": 1}, {"rows_per_bucket": 1}, {}):
        lab = {r["id"]: r for r in readmission_label(ev, "entity", "id", "start", "end", drop_last=False, is_last_col="last", **how).collect()}
        assert [lab[i]["last"] for i in range(1, 7)] == [True, True, True, True, False, False]
        assert lab[5]["gap_days"] == 7 and lab[6]["gap_days"] is None and lab[6]["label"] == 0
        his = {r["id"]: r for r in history_features(ev, "entity", "id", "start", "end", **how).collect()}
        assert [his[i]["prior_count"] for i in range(1, 7)] == [0, 0, 0, 2, 0, 1]
        assert his[2]["days_since_last"] is None and his[4]["days_since_last"] is None and his[6]["days_since_last"] == 7


def _stage_rows(spark, df):
    """Rows of each partition behind the explicit exchange that the windows read."""
    from cohortflow.operators.sequence import BK
    counts = df.repartition(16, "entity", BK).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    return [r["count"] for r in counts]


def test_no_window_task_is_hot(spark):
    """Half of the rows on one entity, broadcasts left to their hints: the plan has
    one exchange of rows, on (entity, cell), and its partitions are even."""
    from cohortflow.operators.sequence import _with_bucket
    ev = spark.range(40_000).selectExpr("if(id % 2 = 0, -1, id % 997) as entity", "id",
                                        "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7 % 100000 as int)) as start")
    ev = ev.withColumn("end", F.col("start"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = _stage_rows(spark, _with_bucket(ev, "start", None, "entity", "id", 200))
        assert sum(rows) == 40_000 and max(rows) <= 2 * sum(rows) / 16
        out = readmission_label(ev, "entity", "id", "start", "end", rows_per_bucket=200)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan
        window = plan[plan.index("Window"):]
        assert window.index("REPARTITION_BY_COL") < window.index("Scan" if "Scan" in window else "Range")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("tie", ["long", "string"])
def test_one_time_is_split(spark, tie):
    """Half of the rows at one time of one entity: its cells are cut by the tie, no
    partition is hot, and label and history equal those of the uncut scan."""
    from cohortflow.operators.sequence import BK, _with_bucket
    n = 20_000
    hot = spark.range(n).selectExpr("-1L as entity", "id", "if(id % 2 = 0 or id > 15000, timestamp_ntz'2020-01-02 00:00:00', "
                                    "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(id % 97 as int))) as start")
    rest = spark.range(n, 2 * n).selectExpr("id % 997 as entity", "id", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id % 50 as int)) as start")
    ev = hot.unionByName(rest).selectExpr("entity", f"cast({'id' if tie == 'long' else 'concat(\"visit-\", id)'} as {tie}) as id", "start",
                                          "start + make_dt_interval(cast(id % 3 as int), 1) as end", "cast(id % 7 as double) as cost")
    cells = _with_bucket(ev, "start", None, "entity", "id", 200)
    assert cells.filter("entity = -1").groupBy(BK).count().agg(F.max("count")).first()[0] <= 400
    parts = _stage_rows(spark, cells)
    assert sum(parts) == 2 * n and max(parts) <= 2 * sum(parts) / 16
    a, b = (history_features(ev, "entity", "id", "start", "end", {"spent": "cost"}, label_horizon=30, **x)
            for x in ({"rows_per_bucket": 200}, {"bucket_days": 1e7}))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


@pytest.mark.parametrize("seed", range(3))
def test_history_with_many_ties_equals_the_theta_join(spark, seed):
    """Few times, many ties, null starts, ends and ties, cells of three rows: every history column against a plain loop."""
    import datetime as dt
    import random
    rng = random.Random(seed)
    t0 = dt.datetime(2021, 1, 1)
    rows = []
    for i in range(240):
        s = None if rng.random() < 0.03 else t0 + dt.timedelta(days=rng.choice([0, 0, 0, 5, 40, 41, 90]))
        e = None if s is None or rng.random() < 0.05 else s + dt.timedelta(days=rng.randrange(4))
        rows.append((rng.choice([1, 1, 1, 2, 3]), i, s, e, float(rng.randrange(5))))
    ev = spark.createDataFrame(rows, "entity long, id long, start timestamp_ntz, end timestamp_ntz, cost double")
    got = {r.id: r for r in history_features(ev, "entity", "id", "start", "end", {"spent": "cost"}, rows_per_bucket=3).collect()}
    far = dt.datetime(2200, 1, 1)
    for entity, i, s, _, _ in rows:
        mine = sorted((r for r in rows if r[0] == entity), key=lambda r: (r[2] or far, r[1]))
        before = [r for r in mine if (r[2] or far) < (s or far)]
        g = got[i]
        assert g.prior_count == len(before) and g.spent == sum(r[4] for r in before)
        close = any(a[3] is not None and b[2] is not None and (b[2] - a[3]).days <= 30 for a, b in zip(before, before[1:], strict=False))
        assert g.had_prior_readmission == int(close), (i, g)
        stays = [(r[3] - r[2]).days for r in before if r[2] and r[3]]
        assert g.avg_prior_los == (pytest.approx(sum(stays) / len(before)) if stays else None)
        last = before[-1][3] if before else None
        assert g.days_since_last == ((s - last).days if s and last else None)
