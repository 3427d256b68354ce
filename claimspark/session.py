"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package assumes; tuned per deployment through
# ordinary Spark configuration, never hard-wired inside operators.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "claimspark", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with :data:`DEFAULT_CONF`.

    On a cluster the session already exists (``spark-submit``); the builder
    path is for tests and the local bench.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared, durable
    folder there).  Only a plain ``local[...]`` session, where driver and
    executors are one process, may leave it unset and gets a scratch folder
    of its own; any other master stops with a clear error, because
    executors would each write to their own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        d = tempfile.mkdtemp(prefix="claimspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder; Spark's own
    writers create it through Hadoop's FileSystem, whatever its scheme."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/claimspark-{spark.sparkContext.applicationId}"
    _SCRATCH_ROOTS.add(root)
    return f"{root}/{name}-{os.urandom(6).hex()}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder exists, asked of its own file system; a
    storage error rises instead of looking like a missing table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cleanup_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables (call when its results are
    written; tables that a lazy result still reads must stay until then)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH_ROOTS:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH_ROOTS.pop())
        path.getFileSystem(conf).delete(path, True)


_SCRATCH_ROOTS: set[str] = set()
