"""Incremental loading with Structured Streaming (ING12–ING14 per micro-batch).

New landed files are picked up by a file source, each micro-batch is parsed
and merged into the target table by ``ingest.load_batch``, and progress is
kept in a checkpoint under the shared ``spark.checkpoint.dir``. With
``trigger(availableNow=True)`` a scheduled run loads everything that arrived
since the last run and stops. The names and times of a batch's files are part of
its commit: a batch that is replayed, after a loss or under a new checkpoint,
finds its files taken and changes neither the table nor the audit log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ingest as ING
from ..operators import snapshots
from ..session import ensure_checkpoint_dir


def load_incrementally(spark: SparkSession, source_dir: str, schema: StructType | str, target: str,
                       key: list[str], partition_cols: list[str], name: str,
                       transform: Callable[[DataFrame], DataFrame] | None = None,
                       fmt: str = "parquet", available_now: bool = True,
                       max_files_per_trigger: int | None = None):
    """Start (and, with ``available_now``, finish) a file-source stream that
    upserts each micro-batch into the parquet table at ``target``.

    ``transform`` turns landed rows into typed rows (e.g. ``ingest.parse_orders``);
    each micro-batch is a load of its own time (``ingest.load_seq``), so later
    batches win on equal keys, under a new checkpoint as well.
    Returns the StreamingQuery (already stopped when ``available_now``).
    """
    ckpt_root = ensure_checkpoint_dir(spark)
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    file, modified = "__landed_file", "__landed_at"
    stream = reader.load(source_dir).select("*", F.col("_metadata.file_path").alias(file),
                                            F.col("_metadata.file_modification_time").alias(modified))

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        taken = snapshots.loaded_files(session, target).withColumnsRenamed({"file": "__f", "modified": "__m"})
        new = batch.join(taken, (F.col(file) == F.col("__f")) & (F.col(modified) == F.col("__m")), "left_anti")
        files = new.select(F.col(file).alias("file"), F.col(modified).alias("modified")).distinct()
        if files.isEmpty():
            return
        rows = new.drop(file, modified)
        rows = (transform(rows) if transform else rows).withColumn("load_seq", F.lit(ING.load_seq()).cast("long"))
        ING.load_batch(session, rows, target, key, partition_cols, "", name, (None, None), files=files)

    w = stream.writeStream.foreachBatch(merge).option(
        "checkpointLocation", f"{str(ckpt_root).rstrip('/')}/streams/{name}")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
