"""As-of joins (JN8, JN9): each left row with the latest right row of its key that is not later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.staging import once


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str,
              columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` whose key equals and whose time is not later (NULL for none).

    Both sides are range-partitioned by (key, time, place), so a key with a
    third of all rows is cut into as many pieces as its rows need. Within a piece
    the last right row is carried on in time order. A boundary between pieces cuts one key
    at most, so hardly more rows than there are pieces are handed over.

    Of right rows with equal key and time the greatest by ``columns`` counts. A
    NULL key or time matches nothing. Rows and columns of ``left`` stay; those
    it has of the same names as ``columns`` are replaced.
    """
    keys = [f"k{i}" for i in range(len(on))]

    def side(df: DataFrame, time: str) -> list:
        return [F.col(f"`{c}`").cast(left.schema[c].dataType).alias(k) for c, k in zip(on, keys)] + [
            F.col(f"`{time}`").cast(left.schema[left_time].dataType).alias("t")]

    def struct(names: list[str]):
        return F.struct(*[F.col(f"`{c}`") for c in names])

    seen = right.select(*side(right, right_time), struct(columns).alias("found")).dropna(subset=[*keys, "t"])
    seen = seen.groupBy(*keys, "t").agg(F.max("found").alias("found"))
    rows = left.select(*side(left, left_time), struct(left.columns).alias("row"))
    both = seen.unionByName(rows, allowMissingColumns=True).withColumn("later", F.col("row").isNotNull())
    order = ["t", "later"]  # a right row comes before left rows of its time
    dealt = both.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "place")
    dealt = once(dealt.drop("place").withColumn("piece", F.spark_partition_id()), "asof")

    so_far = W.partitionBy("piece", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    carried = dealt.withColumn("found", F.last("found", ignorenulls=True).over(so_far)).where("later")

    ends = dealt.groupBy("piece", *keys).agg(F.max_by("found", F.when(~F.col("later"), F.col("t"))).alias("found"))
    before = W.partitionBy(*keys).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    handed = ends.select(F.col("piece").alias("to"), *[F.col(k).alias(f"to_{k}") for k in keys],
                         F.last("found", ignorenulls=True).over(before).alias("handed")).where("handed is not null")
    same = F.col("piece") == F.col("to")
    for k in keys:
        same = same & (F.col(k) == F.col(f"to_{k}"))
    out = carried.join(handed, same, "left").withColumn("found", F.when(
        F.col("t").isNotNull(), F.coalesce("found", "handed")))
    return out.select(*[F.col("row")[c].alias(c) for c in left.columns if c not in columns],
                      *[F.col("found")[c].alias(c) for c in columns])
