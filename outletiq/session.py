"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for correctness (time zone, ANSI arithmetic) and for
# scale (adaptive execution, skew handling, partition sizing).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "outletiq",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session already exists and is returned unchanged except
    for the session-level SQL settings above.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        spark = active
    else:
        b = SparkSession.builder.appName(app)
        if master:
            b = b.master(master)
        for k, v in BASE_CONF.items():
            b = b.config(k, v)
        b = b.config("spark.driver.memory", os.environ.get("OUTLETIQ_DRIVER_MEM", "16g"))
        if shuffle_partitions:
            b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        spark = b.getOrCreate()
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            try:
                spark.conf.set(k, v)
            except Exception:  # static or locked setting on a managed cluster
                pass
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share for staging and checkpoints.

    ``spark.checkpoint.dir`` if the cluster sets it, else a folder already set on
    the SparkContext. Only a local session may fall back to a folder of its own;
    on a cluster a missing shared folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="outletiq-ckpt-"))
    return shared_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Have a checkpoint folder on the SparkContext, the one it has if any; returns ``shared_dir``."""
    d = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that no later job needs: it is deleted when the
    driver's process ends, or by ``clear_scratch``."""
    if not _SCRATCH:
        atexit.register(clear_scratch)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def clear_scratch() -> None:
    """Delete all scratch tables of this process. DataFrames that still read them must not be used any more.

    A driver that was killed leaves its tables; they have names of their own in
    the shared folder, and one without a running driver may be deleted at any time."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            conf = spark._jsc.sc().hadoopConfiguration() if spark._jsc.sc() else jvm.org.apache.hadoop.conf.Configuration()
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM has gone first: nothing to ask any more
            _SCRATCH.clear()
