"""Session helpers: a local session for tests and benches, the shared work folder,
and broadcasts guarded by a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ragtab",
                  conf: dict | None = None) -> SparkSession:
    """Local session used by tests and the bench. On a cluster, use the cluster's
    session; nothing in the library depends on these settings."""
    b = SparkSession.builder
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = (
        b.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # text rows are CPU-heavy per byte: aim for smaller post-shuffle partitions
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the cluster and is read here. Only when it is
    unset (local tests) a private folder is created and registered."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        conf = tempfile.mkdtemp(prefix="ragtab-ckpt-")  # local mode only (tests)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ragtab-{name}-{uuid.uuid4().hex[:12]}"


def sized_broadcast(df: DataFrame, max_rows: int = 100_000, row_bytes=None,
                    max_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """Broadcast ``df`` only after proving its size.

    Without ``row_bytes`` the check reads at most ``max_rows + 1`` rows. With a
    per-row byte estimate (a Column, e.g. ``length(text) + 32``) one aggregate
    proves both the row count and the byte size. Beyond either bound the frame is
    returned as is, so the join falls back to a shuffle join (AQE may still
    re-plan it from runtime statistics)."""
    if row_bytes is None:
        n = df.limit(max_rows + 1).count()
        return F.broadcast(df) if n <= max_rows else df
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and b <= max_bytes else df


def ensure_parallel(df: DataFrame, min_partitions: int | None = None, small_splits: int = 8) -> DataFrame:
    """Spread a frame that comes from very few file splits over the cores.

    Only a frame with at most ``small_splits`` partitions (at the default split
    size, about a gigabyte or less) and fewer than the default parallelism gets a
    round-robin repartition, so per-row text work and Arrow kernels run on every
    core. A large table already has many splits and is returned untouched: no
    shuffle is ever added in front of a big scan."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    if n >= want or n > small_splits:
        return df
    return df.repartition(want)
