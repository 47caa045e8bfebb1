"""Session helpers: the configuration the library expects, and the shared
checkpoint folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "cohortflow",
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    """Create (or reuse) a session with AQE, skew-join splitting and UTC.

    On a cluster, leave ``master`` unset and let the launcher decide; the
    shuffle partition count then comes from the cluster defaults unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    if _context(spark) is not None:
        spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def sizing(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a job reading ``input_bytes`` on ``cores`` executor
    cores: scan splits and shuffle partitions of about ``partition_bytes``
    (at least 2 tasks per core), AQE coalescing towards the same size and
    skew splitting of partitions 5x the median. At 100 TB on 1000 executors
    this gives ~400k initial shuffle partitions that AQE coalesces per stage.
    """
    shuffle = max(2 * cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
    }


def apply_sizing(spark: SparkSession, input_bytes: int, cores: int | None = None,
                 partition_bytes: int = 256 << 20) -> None:
    """Apply :func:`sizing` to a running session (runtime SQL settings only)."""
    cores = cores or spark.sparkContext.defaultParallelism
    for k, v in sizing(input_bytes, cores, partition_bytes).items():
        spark.conf.set(k, v)


def _context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one process, may do without: it gets a fresh
    scratch folder. On a cluster a folder of one machine would lose rows, so
    the setting has to be there."""
    sc = _context(spark)
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and sc is not None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master or ""):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="cohortflow-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(shared)
        return sc.getCheckpointDir()
    return shared


def application_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "connect")


def cut_lineage(df, name: str = "stage"):
    """Write ``df`` once as a Parquet table under the shared checkpoint folder
    and return a DataFrame reading it back.

    This is the lineage cut used before multi-branch plans: one job computes
    the input (``Dataset.checkpoint`` would run it twice unless cached), the
    files live on the cluster's shared storage (they survive the loss of the
    executors that wrote them), and the read-back gets Parquet column
    pruning and predicate pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Fewer rows are read in no time, however they lie in their files.
DEAL_ROWS = 100_000


def deal(df, least: int = DEAL_ROWS):
    """``df`` dealt evenly over the cores where its partitions would keep some of them waiting: a matrix that is
    read in hundreds of passes takes the time of its fullest core in every one of them. One count a partition tells;
    frames of fewer than ``least`` rows, and even ones, are returned as they are."""
    import heapq
    from pyspark.sql import functions as F
    cores = _cores(df.sparkSession)
    sizes = sorted((r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()), reverse=True)
    n, busy = sum(sizes), [0] * cores
    for size in sizes:
        heapq.heapreplace(busy, busy[0] + size)
    if n < least or max(busy) * cores <= 1.15 * n:
        return df
    return df.repartition(cores * -(-n // (cores * 250_000)))


def _cores(spark: SparkSession) -> int:
    sc = _context(spark)
    return max(1, sc.defaultParallelism if sc is not None else int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, known to :func:`release_stages`."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortflow-{name}-{uuid.uuid4().hex}"
    _written(spark).append(path)
    return path


_STAGES: dict[str, list[str]] = {}


def _written(spark: SparkSession) -> list[str]:
    return _STAGES.setdefault(application_id(spark), [])


def release_stages(spark: SparkSession) -> int:
    """Delete what was written to :func:`scratch_path` in this application, once
    nothing that reads them is needed any more; returns how many."""
    paths, jvm = _written(spark), spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    n = len(paths)
    paths.clear()
    return n
