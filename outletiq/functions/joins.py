"""Join helpers: size-checked broadcast and calendars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension is broadcast only when the optimizer's size estimate for it is
# at most this many bytes. Above it the join stays a shuffle join and adaptive
# execution may still switch strategy at run time from real sizes.
DEFAULT_BROADCAST_MAX = 16 * 1024 * 1024
CONF_KEY = "outletiq.broadcast.maxBytes"


def plan_size_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate; for a scan the size of its files, an upper bound without CBO."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def leaf_bytes(df: DataFrame) -> int:
    """Stored size of what ``df`` reads; the estimate of a plan with joins multiplies the sizes of their sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def broadcast_max(spark: SparkSession) -> int:
    v = spark.conf.get(CONF_KEY, None)
    return int(v) if v else DEFAULT_BROADCAST_MAX


def small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when its estimated size is within bounds."""
    limit = max_bytes if max_bytes is not None else broadcast_max(df.sparkSession)
    return F.broadcast(df) if plan_size_bytes(df) <= limit else df


# Expanded rows of about this many (stored) bytes are one task of a generator.
SPREAD_BYTES = 8 * 1024 * 1024


def pieces(df: DataFrame, times: int) -> int:
    """Tasks for ``times`` rows of every row of ``df``; the size estimate counts no rows that generators add."""
    return max(1, -(-plan_size_bytes(df) * times // SPREAD_BYTES))


def spread(df: DataFrame, times: int) -> DataFrame:
    """``df``, of which every row is about to become ``times`` rows, in as many pieces as those need.

    A small table is one file and so one task, whatever a generator makes of its rows."""
    n = pieces(df, times)
    return df.repartition(n) if n > 1 else df


def calendar(spark: SparkSession, start: dt.date, end: dt.date, name: str = "day") -> DataFrame:
    """One row per day in ``[start, end]``, generated on executors."""
    n = (end - start).days + 1
    return spark.range(max(n, 0)).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias(name))


def month_calendar(spark: SparkSession, first_month: dt.date, months: int,
                   name: str = "month") -> DataFrame:
    """``months`` month starts from ``first_month`` onwards."""
    return spark.range(months).select(
        F.add_months(F.lit(first_month), F.col("id").cast("int")).alias(name))
