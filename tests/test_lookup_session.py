from pyspark.sql import functions as F

from cohortflow.operators.lookup import describe_codes, map_groups
from cohortflow.operators.score import attach_lookup, lookup_table
from cohortflow.session import sizing


def test_describe_codes_default(spark):
    df = spark.createDataFrame([("4280",), ("9999",)], "code string")
    out = {r["code"]: r["description"] for r in describe_codes(df, "code", {"4280": "HF, unspecified"}).collect()}
    assert out == {"4280": "HF, unspecified", "9999": "Unknown 9999"}


def test_map_groups_many_to_one_and_overlap(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "id long, code string")
    groups = {"g1": ["a", "b"], "g2": ["b"]}
    inner = sorted((r["id"], r["group_name"]) for r in map_groups(df, "code", groups).collect())
    assert inner == [(1, "g1"), (2, "g1"), (2, "g2")]  # a member in two groups -> two rows
    left = map_groups(df, "code", groups, keep_unmatched=True)
    assert left.filter(F.col("group_name").isNull()).count() == 1


def test_recommendation_lookup(spark):
    df = spark.createDataFrame([("High Risk",), ("Other",)], "tier string")
    t = lookup_table(spark, {"High Risk": "act now"}, "tier_key", "action")
    out = {r["tier"]: r["action"] for r in attach_lookup(df, "tier", t, "tier_key", "action", default="none").collect()}
    assert out == {"High Risk": "act now", "Other": "none"}


def test_sizing_scales_with_input():
    small = sizing(10 << 30, 8)
    big = sizing(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 40
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_written_stages_are_released(spark):
    import os

    from cohortflow.session import cut_lineage, release_stages
    release_stages(spark)
    df = cut_lineage(spark.range(5).toDF("x"), "probe")
    path = df.inputFiles()[0].removeprefix("file:")
    assert df.count() == 5 and os.path.exists(path)
    assert release_stages(spark) == 1 and not os.path.exists(path)


def test_cluster_needs_a_shared_folder():
    import pytest

    from cohortflow import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_deal_evens_out_what_keeps_cores_waiting(spark):
    from pyspark.sql import functions as F

    from cohortflow.session import cut_lineage, deal

    def sizes(df):
        return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]

    cores = spark.sparkContext.defaultParallelism
    uneven = spark.range(0, 5000, 1, 1).union(spark.range(5000, 6000, 1, 3))
    even = deal(uneven, least=1000)
    assert len(sizes(even)) == cores and max(sizes(even)) - min(sizes(even)) <= cores
    read = sizes(cut_lineage(even, "dealt"))
    assert max(read) * cores <= 1.15 * 6000
    assert sorted(r.id for r in even.collect()) == list(range(6000))
    assert deal(uneven) is uneven and deal(even, least=1000) is even


def test_matrices_are_written_in_even_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cohortflow import session
    from cohortflow.operators import models as M

    monkeypatch.setattr(M, "deal", lambda df: session.deal(df, least=1000))
    df = spark.range(0, 6000, 1, 1).select("id", (F.col("id") % 2).alias("label"), F.rand(1).alias("a"))
    parts = [r["count"] for r in M.training_matrix(df, "id", "label", ["a"], materialize=True).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 6000 and max(parts) * spark.sparkContext.defaultParallelism <= 1.15 * 6000


def test_settings_for_many_rows_leave_the_model_alone(spark):
    from cohortflow.operators import models as M

    few, many = (M.estimator("rf", {"numTrees": 3, "seed": 42}, 2, n) for n in (1000, 1_000_000))
    assert few.getCacheNodeIds() and many.getCacheNodeIds() and (few.getMaxMemoryInMB(), many.getMaxMemoryInMB()) == (256, 512)
    few, many = (M.estimator("mlp", {"hidden": [4], "maxIter": 7}, 2, n) for n in (1000, 1_000_000))
    assert (few.getBlockSize(), many.getBlockSize()) == (128, 1024) and few.getLayers() == many.getLayers() == [2, 4, 2]
