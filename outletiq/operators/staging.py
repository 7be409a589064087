"""Tables staged in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import leaf_bytes
from ..session import scratch_path
from ..sources.tables import exists

__all__ = ["delete", "exists", "once", "rounds", "shuffles_freed", "stage", "stage_in_rounds"]

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Stored bytes of one round of a large table, and rounds at most (each reads the input once more).
ROUND_BYTES = 128 << 20
MOST_ROUNDS = 8


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within this block Spark deletes the shuffle files of each query when it has ended: what is written is read
    from the shared folder, and nothing reads them again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str = "staging") -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder, and its path (to delete it before the job ends)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def once(df: DataFrame, name: str = "once") -> DataFrame:
    """``df`` computed once: what is built on the result more than once reads the written table."""
    return stage(df, name)[0]


def rounds(df: DataFrame, by: list[str], times: int = 1, most: int = MOST_ROUNDS) -> list[DataFrame]:
    """``df`` in as many parts as the stored size of what it reads (``times`` that) needs, ``most`` at most, by a hash of the columns ``by``.

    Written one after the other, only one part's shuffle files are there at a
    time. The condition reaches the scans below aggregates and joins on these columns."""
    n = min(most, -(-leaf_bytes(df) * times // ROUND_BYTES)) if by else 1
    if n <= 1:
        return [df]
    slot = F.pmod(F.xxhash64(F.lit("round"), *[F.col(f"`{c}`") for c in by]), F.lit(n))
    return [df.where(slot == i) for i in range(n)]


def stage_in_rounds(df: DataFrame, by: list[str], name: str = "staging", times: int = 1) -> DataFrame:
    """``df`` written to the shared folder in ``rounds``, where it is larger than one; else ``df`` as it is."""
    spark, parts = df.sparkSession, rounds(df, by, times)
    if len(parts) == 1:
        return df
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
