"""Spark session helpers.

The library never hard-codes parallelism: AQE coalesces shuffle partitions
and splits skewed join partitions at runtime.  The checkpoint folder is read
from ``spark.checkpoint.dir`` (the shared folder the cluster names); only when
it is unset under a local master (tests) a fresh scratch folder is created.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a join whose partitions are all this small is hashed instead of sorted; AQE decides by the sizes it has seen
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # rows go to Python in batches of about so many bytes, not 10,000 rows however long: both sides hold whole batches
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # a scan holds so many rows of each column at once, and texts are long
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "nextbest", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_TUNING)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_tuning(spark)
    return spark


def apply_tuning(spark: SparkSession) -> None:
    """Session settings the engine relies on (UTC dates, ANSI casts, AQE)."""
    for k, v in _TUNING.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: ``spark.checkpoint.dir`` if the cluster set it.

    Where it is unset, a scratch folder is made for a local master only (tests);
    on a cluster a machine-local folder would not be seen by other executors,
    so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="nextbest-ckpt-")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that is no longer needed, on whatever store it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
