"""Session helpers: a local session for tests/bench and a checkpoint folder taken from the session."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which Py4J has told the JVM of objects that Python has let go.
DETACHED_AFTER = 1.2


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "ridelens") -> SparkSession:
    """Local session as used by tests and ``bench.py``; on a cluster pass your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session has none and runs in local mode (tests, a laptop) a fresh scratch
    folder is created and set; on a cluster a machine-local folder would not survive a lost
    executor, so the setting is required there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster session")
    path = tempfile.mkdtemp(prefix="ridelens-ckpt-", dir=os.environ.get("RIDELENS_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never ``localCheckpoint``): survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the driver drop finished plans now, and Spark's cleaner delete the shuffle files of finished stages.

    Both wait for a collection on the driver: one with little to do may not collect for half an hour, and one that makes many
    plans lets its heap grow to the limit first.  Python's frames hold on to themselves, so these are collected before.  The
    driver may hear of them up to a second later, which leaves the last query to the next call; ``release_all`` waits for it.
    """
    gc.collect()
    spark._jvm.System.gc()


def release_all(spark: SparkSession) -> None:
    """``release`` that takes the last query's shuffle files too, after stages that leave many."""
    gc.collect()
    time.sleep(DETACHED_AFTER)
    spark._jvm.System.gc()
