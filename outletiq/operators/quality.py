"""Data-quality builders (Q-A, Q-B, Q-C)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.joins import small
from ..sources.facts import Facts

# Brand texts that count as missing.
UNKNOWN_BRANDS = ("unknown", "unkown", "na", "n/a")


def _money():
    return F.coalesce("delivered_amount", F.lit(0)) + F.coalesce("total_discount", F.lit(0))


def unknown_brand_skus(facts: Facts, window: tuple, town: str) -> DataFrame:
    """Q-A: SKUs sold in the window that are in the master neither by code nor
    by any of three names (master SKU, short master, SKU), or whose brand is
    blank / 'unknown' / 'unkown' / 'na' / 'n/a'; with reason, invoices, sales
    and volume."""
    f = facts.orders_fact(["sku_code", "sku_name", "invoice_number", "delivery_date",
                           "delivered_amount", "total_discount", "delivered_litres", "delivered_kg"],
                          delivery=window, distributor=town)
    f = f.where(F.col("sku_code").isNotNull() & (F.trim("sku_code") != ""))
    ss = f.groupBy("sku_code").agg(
        F.max(X.blank_to("sku_name", "Unknown SKU")).alias("sku_name"),
        F.lower(F.trim(F.max(X.blank_to("sku_name", "")))).alias("name_norm"),
        F.count_distinct("invoice_number").alias("invoices"),
        F.round(F.sum(_money()), 0).alias("sales_value"),
        F.round(F.sum(F.coalesce("delivered_litres", F.lit(0)) + F.coalesce("delivered_kg", F.lit(0))), 2)
        .alias("volume"))
    m = facts.sku_master()
    by_code = m.groupBy(F.trim("sku_code").alias("m_code")).agg(
        F.max(F.nullif(F.trim("brand"), F.lit(""))).alias("code_brand"))
    # UNION ALL of the three name columns as join keys (ST1), as one generator.
    names = m.select("brand", F.explode(F.array("master_sku", "short_master", "sku")).alias("k")) \
        .where(F.col("k").isNotNull() & (F.trim("k") != ""))
    by_name = names.groupBy(F.lower(F.trim("k")).alias("n_norm")).agg(
        F.max(F.nullif(F.trim("brand"), F.lit(""))).alias("name_brand"))
    j = ss.join(small(by_code), F.trim(ss.sku_code) == by_code.m_code, "left") \
          .join(small(by_name), ss.name_norm == by_name.n_norm, "left")
    brand = F.coalesce("code_brand", "name_brand")
    missing = F.col("m_code").isNull() & F.col("n_norm").isNull()
    bad = brand.isNull() | F.lower(F.trim(brand)).isin(*UNKNOWN_BRANDS)
    return j.where(missing | bad).select(
        "sku_code", "sku_name", F.coalesce(brand, F.lit("")).alias("master_brand"),
        F.when(missing, "SKU missing in Master SKU").otherwise("Brand missing in Master SKU")
         .alias("missing_reason"),
        "invoices", X.dbl("sales_value").alias("sales_value"), X.dbl("volume").alias("volume")) \
        .orderBy(F.desc("sales_value"), "sku_code")


def missing_targets(facts: Facts, town: str, as_of: dt.date) -> DataFrame:
    """Q-B: booker × brand pairs with month-to-date sales and no 'Value' target
    for the month (left anti join)."""
    f = facts.orders_fact(["booker_code", "booker_name", "sku_code", "delivery_date",
                           "delivered_amount", "total_discount"],
                          delivery=(as_of.replace(day=1), as_of), distributor=town)
    sm = facts.sku_master().groupBy("sku_code").agg(F.max("brand").alias("brand"))
    f = f.join(small(sm), "sku_code", "left")
    s = f.groupBy("booker_code", "booker_name", X.blank_to("brand").alias("brand")).agg(
        F.round(F.sum(_money()), 0).alias("achieved_mtd"))
    t = facts.targets_new([(as_of.year, as_of.month)], town).where(F.col("kpi") == "Value") \
        .select("booker_code", X.blank_to("brand").alias("brand")).distinct()
    return s.join(small(t), ["booker_code", "brand"], "left_anti").select(
        "booker_code", F.col("booker_name").alias("booker"), "brand",
        X.dbl("achieved_mtd").alias("achieved_mtd")).orderBy(F.desc("achieved_mtd"), "booker")


def missing_shops(facts: Facts, window: tuple, town: str, source: str = "orders_fact") -> DataFrame:
    """Q-C: stores in the order lines of the window but not in the universe,
    with last delivery and value (left anti join on trimmed codes)."""
    f = facts.orders_fact(["store_code", "store_name", "booker_name", "invoice_number", "delivery_date",
                           "delivered_amount", "total_discount"], delivery=window, distributor=town)
    f = f.where(F.col("store_code").isNotNull() & (F.trim("store_code") != ""))
    u = facts.universe().select(F.trim("store_code").alias("u_code")).distinct()
    f = f.join(small(u), F.trim(f.store_code) == u.u_code, "left_anti")
    return f.groupBy(F.trim("store_code").alias("store_code")).agg(
        F.max(X.blank_to("store_name", "Unknown Store")).alias("store_name"),
        F.max(X.blank_to("booker_name", "Unknown Booker")).alias("booker"),
        F.count_distinct("invoice_number").alias("invoices"),
        X.dbl(F.round(F.sum(_money()), 0)).alias("sales_value"),
        F.max("delivery_date").alias("last_delivery_date")) \
        .withColumn("source_table", F.lit(source)).orderBy(F.desc("sales_value"), "store_code")
