"""Targets and achievement builders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import periods as P
from ..functions.joins import small
from ..sources.dims import sku_by_code, universe_by_store
from ..sources.facts import Facts


def _ach(nmv, target) -> F.Column:
    return F.round(X.ratio(nmv, target) * 100.0, 0)


def target_vs_ach_monthly(facts: Facts, town: str, limit: int | None = 10,
                          by_booker: bool = False, towns: dict | None = None) -> DataFrame:
    """T1 (and T2 with ``by_booker``): monthly NMV and volume (litres + kg)
    against the legacy ``targets`` table; achievement % and month label M-YYYY.

    Both sides are aggregated to the same grain before the join (fixes the
    non-grouped target column of the reference); T1 keeps the latest 10 months.
    """
    keys = ["year", "month", "distributor_code"] + (["booker_code"] if by_booker else [])
    cols = ["delivery_date", "distributor_code", "delivered_amount", "total_discount",
            "delivered_litres", "delivered_kg"] + (["booker_code", "booker_name"] if by_booker else [])
    f = facts.orders_fact(cols, distributor=town)
    f = f.withColumn("year", F.year("delivery_date")).withColumn("month", F.month("delivery_date"))
    gkeys = keys + (["booker_name"] if by_booker else [])
    s = f.groupBy(*gkeys).agg(F.sum(X.nmv()).alias("nmv"),
                             F.sum(X.volume_additive()).alias("vol"))
    t = facts.targets(distributor=town).groupBy(*keys).agg(
        F.sum("target_in_value").alias("tv"), F.sum("target_in_volume").alias("tl"))
    j = s.join(small(t), keys, "left")
    out = j.select(
        *(["booker_code", F.col("booker_name").alias("booker")] if by_booker else []),
        "year", "month",
        F.concat_ws("-", F.col("month").cast("string"), F.col("year").cast("string")).alias("period"),
        X.dbl(F.round("tv", 0)).alias("target_value"), X.dbl(F.round("nmv", 0)).alias("nmv"),
        _ach("nmv", "tv").alias("value_ach"),
        X.dbl(F.round("tl", 0)).alias("target_ltr"), X.dbl(F.round("vol", 0)).alias("ltr"),
        _ach("vol", "tl").alias("ltr_ach"),
        X.town_label("distributor_code", towns).alias("town"))
    out = out.orderBy(F.desc("year"), F.desc("month"), *(["booker_code"] if by_booker else []))
    return out.limit(limit) if limit else out


def target_vs_ach_booker(facts: Facts, town: str) -> DataFrame:
    """T1 per booker, all months."""
    return target_vs_ach_monthly(facts, town, limit=None, by_booker=True)


def booker_month_matrix(t2: DataFrame, periods: list[str]) -> DataFrame:
    """T2 view: booker × month matrix of mean achievement % (AG11) with the NMV
    in millions beside it; months without a row are NULL."""
    return t2.where(F.col("nmv").isNotNull() & F.col("value_ach").isNotNull()).groupBy("booker").pivot(
        "period", periods).agg(F.avg("value_ach").alias("ach"),
                               F.round(F.sum("nmv") / 1e6, 1).alias("nmv_m")).orderBy("booker")


def channel_month(facts: Facts, town: str, as_of: dt.date, months: int = 7) -> DataFrame:
    """NMV and volume per month × channel over the last ``months`` months,
    current month excluded (FLT4); stores must be in the universe (inner join)."""
    lo = P.add_months(as_of, -months)
    hi = as_of.replace(day=1) - dt.timedelta(days=1)
    f = facts.orders_fact(["delivery_date", "store_code", "delivered_amount", "total_discount",
                           "delivered_litres", "delivered_kg"], delivery=(lo, hi), distributor=town)
    f = f.join(small(universe_by_store(facts.universe())), "store_code", "inner")
    return (f.groupBy(X.month_key("delivery_date").alias("period"),
                      X.channel_or_default("channel_type").alias("channel"))
             .agg(X.dbl(F.round(F.sum(X.nmv()), 0)).alias("nmv"),
                  X.dbl(F.round(F.sum(X.volume_additive()), 0)).alias("ltr"))
             .orderBy("period", "channel"))


def channel_month_all(facts: Facts, town: str | None, towns: dict | None = None) -> DataFrame:
    """T3, all months: NMV and volume per month × channel × town label of the
    stores in the universe; a missing channel stays NULL."""
    f = facts.orders_fact(["delivery_date", "store_code", "distributor_code", "delivered_amount",
                           "total_discount", "delivered_litres", "delivered_kg"],
                          distributor=None if town in (None, "all") else town)
    f = f.join(small(universe_by_store(facts.universe())), "store_code", "inner")
    return (f.groupBy(X.month_key("delivery_date").alias("period"), F.col("channel_type").alias("channel"),
                      X.town_label("distributor_code", towns).alias("town"))
             .agg(X.dbl(F.round(F.sum(X.nmv()), 0)).alias("nmv"),
                  X.dbl(F.round(F.sum(X.volume_additive()), 0)).alias("ltr"))
             .orderBy("period", "channel", "town"))


def target_vs_ach_brand(facts: Facts, town: str, period: str, channel: str | None = None,
                        towns: dict | None = None) -> DataFrame:
    """T4: booker × brand NMV for one month ('YYYY-M') against ``targets_new``
    (KPI 'Value'); achievement 0 when there is no target."""
    y, m = (int(x) for x in period.split("-"))
    lo = dt.date(y, m, 1)
    f = facts.orders_fact(["delivery_date", "distributor_code", "booker_code", "booker_name",
                           "sku_code", "store_code", "delivered_amount", "total_discount"],
                          delivery=(lo, P.month_end(lo)), distributor=town)
    f = f.join(small(sku_by_code(facts.sku_master()).select("sku_code", "brand")), "sku_code", "left")
    if channel and channel != "All":
        f = f.join(small(universe_by_store(facts.universe())), "store_code", "left") \
             .where(F.col("channel_type") == channel)
    s = f.groupBy("distributor_code", "booker_code", "booker_name", "brand",
                  F.month("delivery_date").alias("month"), F.year("delivery_date").alias("year")) \
         .agg(F.round(F.sum(X.nmv()), 0).alias("nmv"))
    t = (facts.targets_new([(y, m)], town).where(F.col("kpi") == "Value")
         .groupBy("distributor_code", "booker_code", "brand", "month", "year")
         .agg(F.round(F.sum(F.coalesce("target", F.lit(0))), 0).alias("target_value")))
    j = s.join(small(t), ["distributor_code", "booker_code", "brand", "month", "year"], "left")
    tv = F.coalesce("target_value", F.lit(0))
    return j.select(
        F.col("booker_name").alias("booker"), "booker_code", "brand",
        F.concat_ws("-", F.col("month").cast("string"), F.col("year").cast("string")).alias("period"),
        X.dbl(tv).alias("target_value"), X.dbl("nmv").alias("nmv"),
        F.when(tv > 0, _ach("nmv", tv)).otherwise(F.lit(0.0)).alias("value_ach"),
        X.town_label("distributor_code", towns).alias("town")) \
        .orderBy("booker", "brand")


def brand_target_summary(t4: DataFrame) -> DataFrame:
    """Per brand: target, NMV, achievement %, gap."""
    g = t4.groupBy("brand").agg(F.sum("target_value").alias("target"), F.sum("nmv").alias("nmv"))
    return g.select("brand", "target", "nmv",
                    F.round(X.ratio("nmv", "target") * 100.0, 1).alias("ach_pct"),
                    (F.col("target") - F.col("nmv")).alias("gap")).orderBy(F.desc("nmv"), "brand")


def targets_for_window(facts: Facts, town: str, window: tuple) -> DataFrame:
    """Target rows (KPI 'Value') of every month the window touches."""
    months = []
    cur = window[0].replace(day=1)
    while cur <= window[1]:
        months.append((cur.year, cur.month))
        cur = P.add_months(cur, 1)
    return facts.targets_new(months, town).where(F.col("kpi") == "Value")


def ob_achievement(facts: Facts, window: tuple, town: str,
                   channels: list[str] | None = None) -> DataFrame:
    """Booker × brand sales in the window (rounded per brand) against the
    targets of the months the window touches, rolled up per booker name.
    Targets of brands a booker did not sell are left out (left join from sales)."""
    f = facts.orders_fact(["delivery_date", "distributor_code", "booker_code", "booker_name",
                           "sku_code", "store_code", "delivered_amount", "total_discount"],
                          delivery=window, distributor=town)
    f = f.join(small(sku_by_code(facts.sku_master()).select("sku_code", "brand")), "sku_code", "left")
    if channels:
        f = f.join(small(universe_by_store(facts.universe())), "store_code", "left") \
             .where(F.col("channel_type").isin(*channels))
    s = f.groupBy("booker_code", "booker_name", "brand") \
         .agg(F.round(F.sum(X.nmv()), 0).alias("achieved"))
    t = targets_for_window(facts, town, window).groupBy("booker_code", "brand") \
        .agg(F.round(F.sum(F.coalesce("target", F.lit(0))), 0).alias("target"))
    j = s.join(small(t), ["booker_code", "brand"], "left")
    g = j.groupBy("booker_name").agg(
        F.round(F.sum("achieved"), 0).alias("achieved"),
        F.round(F.sum(F.coalesce("target", F.lit(0))), 0).alias("target"))
    return g.select(F.col("booker_name").alias("booker"),
                    X.dbl("target").alias("target_value"), X.dbl("achieved").alias("achieved_value"),
                    F.when(F.col("target") > 0, F.round(X.ratio("achieved", "target") * 100.0, 1))
                     .otherwise(F.lit(0.0)).alias("achieved_pct")) \
        .orderBy(F.desc("achieved_pct"), F.desc("achieved_value"), "booker")


def period_target_total(facts: Facts, window: tuple, town: str) -> DataFrame:
    """Target total of the months touched (0 digits), window NMV,
    balance to achieve and achievement % (NULL without a target)."""
    t = targets_for_window(facts, town, window).agg(
        F.round(F.sum(F.coalesce("target", F.lit(0))), 0).alias("target"))
    s = facts.orders_fact(["delivery_date", "delivered_amount", "total_discount"],
                          delivery=window, distributor=town).agg(F.sum(X.nmv()).alias("nmv"))
    # Two one-row aggregates side by side: union + max keeps it a plain aggregate.
    j = t.unionByName(s, allowMissingColumns=True) \
        .agg(F.max("target").alias("target"), F.max("nmv").alias("nmv"))
    return j.select(X.dbl("target").alias("target_value"), X.dbl("nmv").alias("current_nmv"),
                    X.dbl(F.col("target") - F.col("nmv")).alias("balance_to_achieve"),
                    F.when(F.col("target") > 0, F.round(X.ratio("nmv", "target") * 100.0, 2))
                     .alias("achievement_pct"))


def target_upload_status(facts: Facts, town: str, as_of: dt.date) -> DataFrame:
    """Target rows, bookers, brands and total for the as-of month."""
    t = facts.targets_new([(as_of.year, as_of.month)], town)
    return t.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_distinct("booker_code").alias("bookers"),
                 F.count_distinct("brand").alias("brands"),
                 X.dbl(F.sum("target")).alias("target_total"))


def achievement_band(col="value_ach") -> F.Column:
    """<50 / 50–59 / 60–69 / 70+."""
    v = F.col(col)
    return (F.when(v < 50, "<50").when(v < 60, "50-59").when(v < 70, "60-69")
            .otherwise("70+"))


def donut_band(col="value_ach") -> F.Column:
    """≥100 / ≥85 / ≥70 / below."""
    v = F.col(col)
    return (F.when(v >= 100, ">=100").when(v >= 85, "85-99").when(v >= 70, "70-84")
            .otherwise("<70"))


def route_band(col="value_ach") -> F.Column:
    """T13, route view: <50 / 50–60 / 60–70 with 70 itself / over 70."""
    v = F.coalesce(F.col(col), F.lit(0.0))
    return (F.when(v < 50, "<50").when(v < 60, "50-60").when(v <= 70, "60-70")
            .otherwise(">70"))


def achievement_bands(df: DataFrame, name: str = "booker", col: str = "value_ach") -> DataFrame:
    """Each row's three achievement bands."""
    return df.select(name, col, achievement_band(col).alias("band"), donut_band(col).alias("donut_band"),
                     route_band(col).alias("route_band")).orderBy(F.desc(col), name)


def band_counts(df: DataFrame, col: str = "value_ach") -> DataFrame:
    """Number of rows per band of the donut."""
    return df.groupBy(donut_band(col).alias("band")).agg(F.count("*").alias("n")).orderBy("band")


def below_achievement(t4: DataFrame, limit_pct: float | None) -> DataFrame:
    """FLT13: booker × brand rows below a limit (50, 60 or 70 %); None keeps all."""
    return t4 if limit_pct is None else t4.where(F.col("value_ach") < limit_pct)


def _hierarchy(t4: DataFrame, outer: str, inner: str) -> DataFrame:
    """T5/T6 core: leaves (outer × inner) with size = target when > 0 else NMV
    (clipped at 0) and leaf achievement = mean (1 digit, half-even); parents
    and the root by ROLLUP over the leaves, achievement = Σ NMV / Σ target."""
    leaf = t4.groupBy(outer, inner).agg(
        F.sum("target_value").alias("target_value"), F.sum("nmv").alias("nmv"),
        F.bround(F.avg("value_ach"), 1).alias("value_ach"))
    leaf = leaf.withColumn("size", F.greatest(
        F.when(F.col("target_value") > 0, F.col("target_value")).otherwise(F.col("nmv")), F.lit(0.0)))
    up = leaf.rollup(outer).agg(F.sum("target_value").alias("target_value"), F.sum("nmv").alias("nmv"),
                                F.sum("size").alias("size"), F.grouping_id().alias("gid"))
    up = up.select(F.when(F.col("gid") == 1, "root").otherwise(outer).alias("level"), outer,
                   F.lit(None).cast("string").alias(inner), "target_value", "nmv", "size",
                   F.when(F.col("target_value") > 0,
                          F.bround(F.col("nmv") / F.col("target_value") * 100.0, 1))
                    .otherwise(F.lit(0.0)).alias("value_ach"))
    lv = leaf.select(F.lit(inner).alias("level"), outer, inner, "target_value", "nmv", "size", "value_ach")
    return up.unionByName(lv).orderBy("level", F.desc("size"), outer, inner)


def booker_brand_hierarchy(t4: DataFrame) -> DataFrame:
    """T5: booker → brand hierarchy of T4."""
    return _hierarchy(t4, "booker", "brand")


def brand_booker_hierarchy(t4: DataFrame) -> DataFrame:
    """Brand → booker hierarchy of T4."""
    return _hierarchy(t4, "brand", "booker")


def flow_links(t4: DataFrame, top_n: int = 10, bottom_n: int = 5, source: str = "booker",
               target: str = "brand") -> DataFrame:
    """Flow links source → target with NMV > 0, limited to the ``top_n`` and
    ``bottom_n`` sources by NMV (SO3; both 0 keeps all); node index = position
    of the node in the sorted source names followed by the sorted target names."""
    from pyspark.sql.window import Window as W
    links = t4.where(F.col("nmv") > 0).groupBy(source, target).agg(F.sum("nmv").alias("value"))
    if top_n > 0 or bottom_n > 0:
        tot = links.groupBy(source).agg(F.sum("value").alias("t"))
        keep = tot.orderBy(F.desc("t"), source).limit(max(top_n, 0)).union(
            tot.orderBy(F.asc("t"), F.desc(source)).limit(max(bottom_n, 0))).select(source).distinct()
        links = links.join(keep, source, "left_semi")
    src = links.select(F.col(source).alias("node"), F.lit(0).alias("side")).distinct()
    dst = links.select(F.col(target).alias("node"), F.lit(1).alias("side")).distinct()
    nodes = src.unionByName(dst).withColumn(
        "idx", F.row_number().over(W.orderBy("side", "node")) - 1)  # the kept sources and the brands
    s_idx = nodes.where("side = 0").select(F.col("node").alias(source), F.col("idx").alias("source_idx"))
    t_idx = nodes.where("side = 1").select(F.col("node").alias(target), F.col("idx").alias("target_idx"))
    return links.join(s_idx, source).join(t_idx, target) \
        .select(source, target, "source_idx", "target_idx", "value").orderBy("source_idx", "target_idx")
