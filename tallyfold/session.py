"""Sessions for tests and benchmarks, and the shared folder for written stages."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
TEXT_PARTITIONS_KEY = "tallyfold.text.partitions"  # tasks that the queries deal texts out to; unset: none
_LOCAL_DIRS: list[tempfile.TemporaryDirectory] = []  # go away with the process


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A quiet single-JVM session; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the one given
    to ``setCheckpointDir``.

    A folder of our own is only made for a local session that names none: there one
    process holds the driver and all tasks, so its disk is the only disk.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured and hasattr(spark, "sparkContext"):
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application_id: str) -> str:
    _LOCAL_DIRS.append(tempfile.TemporaryDirectory(prefix=f"tallyfold-{application_id}-", ignore_cleanup_errors=True))
    return _LOCAL_DIRS[-1].name


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> str:
    """Let the file system delete ``path``, which has been written, when the driver ends.

    A result that is read later is still lazy, so nothing can go earlier.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
