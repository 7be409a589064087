"""Dimension access with the de-duplication the builders rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def universe_by_store(universe: DataFrame) -> DataFrame:
    """One row per store code (a left join must not multiply fact rows)."""
    return universe.groupBy("store_code").agg(
        F.max("channel_type").alias("channel_type"), F.max("status").alias("status"))


def sku_by_code(sku_master: DataFrame, trim: bool = False) -> DataFrame:
    """One row per SKU code: brand/UOM/slug by MAX (F22 dedupe rule)."""
    key = F.trim("sku_code") if trim else F.col("sku_code")
    return sku_master.groupBy(key.alias("sku_code")).agg(
        F.max("brand").alias("brand"), F.max("uom").alias("uom"),
        F.max("slug").alias("slug"), F.max("master_sku").alias("master_sku"),
        F.max("sku").alias("sku"), F.max("short_master").alias("short_master"))
