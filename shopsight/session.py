"""Session helpers: building a local session for tests/bench, and lineage cuts.

On a cluster the session is created by the platform; library code only reads
its settings. ``spark.checkpoint.dir`` is read from the session and a local
folder is set only when it is unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall clock for timestamp_ntz parity,
# AQE for runtime re-planning (coalescing, skew-join splitting, broadcast
# decisions made on measured sizes rather than estimates).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "shopsight") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SHOPSIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024**2) -> dict[str, str]:
    """Suggested shuffle settings for a cluster run over ``input_bytes`` of input.

    The initial shuffle width keeps a partition near ``partition_bytes`` of
    input (at least 3 waves of the cluster's cores), and AQE coalesces small
    partitions back to its advisory size and splits skewed join partitions.
    """
    parts = max(3 * total_cores, input_bytes // partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024**2),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024**2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024**2),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, reliable folder and is
    used as is. Only a local session without one gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="shopsight-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write the frame once as Parquet under the session's checkpoint folder.

    Used where one frame feeds several passes (cut-point sampling, counts and
    the ranked pass of a global ntile; warehouse layers read by many marts and
    checks; iterative ML). The folder is the shared, reliable
    ``spark.checkpoint.dir``, so the result survives executor loss. A written
    table is one job (an RDD checkpoint computes its plan a second time unless
    cached) and later reads get column pruning and filter pushdown.
    """
    if df in _STORED:
        return df  # already a stored table: writing it again would only copy it
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)  # a schema to infer is a job of its own
    _STORED.add(stored)
    return stored


_STORED: weakref.WeakSet = weakref.WeakSet()

#: Spark's setting by which an execution that ends removes its shuffle files.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_removing: dict[int, list] = {}
_removing_lock = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While it is entered, a write removes its shuffle files when it ends.

    A stored table needs them no more. Else they lie on the executors' disks until
    the driver happens to collect its own garbage, which is not in proportion to
    their size, so a chain of stored tables holds the shuffles of many of them. The
    setting is the session's: the first to enter sets it and the last to leave restores it.
    """
    key = id(spark)
    with _removing_lock:
        held = _removing.setdefault(key, [0, spark.conf.get(REMOVE_SHUFFLES, "false")])
        held[0] += 1
        spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _removing_lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(REMOVE_SHUFFLES, held[1])
                del _removing[key]


def materialize_many(frames: dict[str, DataFrame], parallel: int = 8) -> dict[str, DataFrame]:
    """Write several independent frames at once (concurrent jobs share the cluster).

    Small writes leave most task slots idle; submitting them from a few driver
    threads lets the scheduler run their stages side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    if not frames:
        return {}
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(frames)))) as pool:
        futures = {k: pool.submit(materialize, v) for k, v in frames.items()}
        return {k: f.result() for k, f in futures.items()}
