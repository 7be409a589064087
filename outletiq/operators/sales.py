"""Sales and growth builders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import periods as P
from ..functions.joins import month_calendar, small
from ..sources.dims import sku_by_code, universe_by_store
from ..sources.facts import Facts


def _town_filter(town: str | None) -> str | None:
    return None if (town is None or town == "all") else town


# --------------------------------------------------------------------- M1/M2
def kpi_sparkline(facts: Facts, end: dt.date, town: str) -> DataFrame:
    """M1/M2: 13 monthly points (same month last year → end month), gaps 0.

    revenue = Σ NMV (un-guarded), litres = Σ row volume (PRJ2 with NULL→0),
    orders = distinct invoices, aov = revenue / orders (0 without orders).
    """
    last = end.replace(day=1)
    first = P.add_months(last, -12)
    f = facts.orders_fact(["delivery_date", "delivered_amount", "total_discount",
                           "delivered_litres", "delivered_kg", "invoice_number"],
                          delivery=(first, P.month_end(last)), distributor=town)
    lit = F.coalesce("delivered_litres", F.lit(0))
    vol = F.when(lit == 0, F.coalesce("delivered_kg", F.lit(0))).otherwise(lit)
    agg = (f.groupBy(F.trunc("delivery_date", "month").alias("month_start"))
            .agg(F.sum(X.nmv()).alias("revenue"), F.sum(vol).alias("litres"),
                 F.count_distinct("invoice_number").alias("orders")))
    cal = month_calendar(facts.spark, first, 13, "month_start")
    out = cal.join(F.broadcast(agg), "month_start", "left")  # bounded: 13 monthly rows
    rev = F.coalesce(F.col("revenue").cast("double"), F.lit(0.0))
    orders = F.coalesce("orders", F.lit(0)).cast("long")
    return out.select(
        "month_start", rev.alias("revenue"),
        F.coalesce(F.col("litres").cast("double"), F.lit(0.0)).alias("litres"),
        orders.alias("orders"),
        F.when(orders > 0, F.round(rev / orders, 4)).otherwise(F.lit(0.0)).alias("aov"),
    ).orderBy("month_start")


def revenue_sparkline(facts: Facts, end: dt.date, town: str) -> DataFrame:
    """M1: the revenue series of M2."""
    return kpi_sparkline(facts, end, town).select("month_start", "revenue")


# --------------------------------------------------------------------- M3/M4
def kpi(facts: Facts, window: tuple, town: str | None, towns: dict | None = None) -> DataFrame:
    """M3: per town × channel: NMV, litres, distinct invoices for the window,
    last year and last month, with growth % (0 digits; NULL base → NULL).

    One covering scan; rows are tagged with every period they fall in (windows
    can overlap), aggregated once per (town, channel, period) with exact
    distinct counts, then folded to one row per key. Keys absent from the
    current window are dropped (reference behaviour); LY/LM match on town too.
    """
    wins = P.growth_windows(window)
    cover = P.covering(*wins.values())
    f = facts.orders_fact(["delivery_date", "distributor_code", "store_code", "invoice_number",
                           "delivered_amount", "total_discount", "delivered_litres"],
                          delivery=cover, distributor=_town_filter(town))
    u = universe_by_store(facts.universe())
    f = f.join(small(u), "store_code", "left")
    f = f.select(X.town_label("distributor_code", towns).alias("town"),
                 X.channel_or_default("channel_type").alias("channel"),
                 "delivery_date", X.nmv().alias("amt"),
                 F.col("delivered_litres").alias("ltr"), "invoice_number")
    f = P.tag_periods(f, "delivery_date", wins)
    per = f.groupBy("town", "channel", "period").agg(
        F.sum("amt").alias("nmv"), F.sum("ltr").alias("ltr"),
        F.count_distinct("invoice_number").alias("orders"))
    return _fold_periods(per, ["town", "channel"], ["nmv", "ltr"], ["orders"]) \
        .select("town", "channel",
                X.dbl("cur_nmv").alias("current_period_sales"),
                X.dbl("ly_nmv").alias("last_year_sales"),
                X.dbl("lm_nmv").alias("last_month_sales"),
                X.dbl("cur_ltr").alias("current_period_ltr"),
                X.dbl("ly_ltr").alias("last_year_ltr"),
                X.dbl("lm_ltr").alias("last_month_ltr"),
                X.growth_pct("cur_nmv", "ly_nmv").alias("sales_growth_ly"),
                X.growth_pct("cur_nmv", "lm_nmv").alias("sales_growth_lm"),
                X.growth_pct("cur_ltr", "ly_ltr").alias("ltr_growth_ly"),
                X.growth_pct("cur_ltr", "lm_ltr").alias("ltr_growth_lm"),
                F.col("cur_orders").alias("current_orders"),
                F.col("ly_orders").alias("last_year_orders"),
                F.col("lm_orders").alias("last_month_orders")) \
        .orderBy("channel", "town")


def _fold_periods(per: DataFrame, keys, metrics, counts=()) -> DataFrame:
    """(keys, period, metrics…) → one row per key with cur_/ly_/lm_ columns.

    Only keys present in the current period are kept.
    """
    aggs = [F.max(F.when(F.col("period") == P.CUR, 1)).alias("__has_cur")]
    for m in list(metrics) + list(counts):
        for p in (P.CUR, P.LY, P.LM):
            aggs.append(F.max(F.when(F.col("period") == p, F.col(m))).alias(f"{p}_{m}"))
    out = per.groupBy(*keys).agg(*aggs).where(F.col("__has_cur") == 1).drop("__has_cur")
    return out


def channel_performance(facts: Facts, window: tuple, town: str,
                        towns: dict | None = None) -> DataFrame:
    """M4: M3 for one distributor."""
    return kpi(facts, window, town, towns)


# --------------------------------------------------------------------- M5/M6
def _day_grain_growth(f: DataFrame, keys: list[str], window: tuple) -> DataFrame:
    """Shared M5/M6 core: volume PRJ3 at keys × day grain, then period sums."""
    wins = P.growth_windows(window)
    day = f.groupBy(*keys, "delivery_date").agg(
        F.sum("amt").alias("amt"),
        X.volume_group(F.sum("delivered_litres"), F.sum("delivered_kg")).alias("ltr"))
    aggs = []
    for p, w in wins.items():
        inw = P.between("delivery_date", w)
        aggs += [F.max(F.when(inw, 1)).alias(f"__has_{p}"),
                 F.sum(F.when(inw, F.col("amt"))).alias(f"{p}_nmv"),
                 F.sum(F.when(inw, F.col("ltr"))).alias(f"{p}_ltr")]
    g = day.groupBy(*keys).agg(*aggs).where(F.col(f"__has_{P.CUR}") == 1)
    return g.select(
        *keys,
        X.dbl("cur_nmv").alias("current_period_sales"),
        X.dbl(F.when(F.col("__has_ly") == 1, F.col("ly_nmv"))).alias("last_year_sales"),
        X.dbl(F.when(F.col("__has_lm") == 1, F.col("lm_nmv"))).alias("last_month_sales"),
        X.dbl("cur_ltr").alias("current_period_ltr"),
        X.dbl("ly_ltr").alias("last_year_ltr"),
        X.dbl("lm_ltr").alias("last_month_ltr"),
        X.growth_pct("cur_nmv", "ly_nmv").alias("sales_growth_ly"),
        X.growth_pct("cur_nmv", "lm_nmv").alias("sales_growth_lm"),
        X.growth_pct("cur_ltr", "ly_ltr").alias("ltr_growth_ly"),
        X.growth_pct("cur_ltr", "lm_ltr").alias("ltr_growth_lm"))


def brand_growth(facts: Facts, window: tuple, town: str, channel: str | None = None,
                 towns: dict | None = None) -> DataFrame:
    """M5: per town × channel × brand; volume PRJ3 at day grain before summing.

    Channel NULL or blank → 'Channel Empty'. A channel filter applies to the
    universe column, so unmatched stores drop out (the join becomes inner).
    """
    cover = P.covering(*P.growth_windows(window).values())
    f = facts.orders_fact(["delivery_date", "distributor_code", "store_code", "sku_code",
                           "delivered_amount", "total_discount", "delivered_litres",
                           "delivered_kg"], delivery=cover, distributor=town)
    f = f.join(small(sku_by_code(facts.sku_master()).select("sku_code", "brand")),
               "sku_code", "left")
    f = f.join(small(universe_by_store(facts.universe())), "store_code", "left")
    if channel and channel != "All":
        f = f.where(F.col("channel_type") == channel)
    towns2 = towns if towns is not None else None
    f = f.select(X.town_label("distributor_code", towns2, other="Lahore").alias("town"),
                 X.channel_or_default("channel_type", blank_too=True).alias("channel"),
                 "brand", "delivery_date", X.nmv().alias("amt"),
                 "delivered_litres", "delivered_kg")
    return _day_grain_growth(f, ["town", "channel", "brand"], window) \
        .orderBy(F.desc("current_period_sales"), "channel", "brand")


def dm_growth(facts: Facts, window: tuple, town: str) -> DataFrame:
    """M6: per deliveryman; volume PRJ3 at DM × day grain."""
    cover = P.covering(*P.growth_windows(window).values())
    f = facts.orders_fact(["delivery_date", "dm_name", "delivered_amount", "total_discount",
                           "delivered_litres", "delivered_kg"], delivery=cover, distributor=town)
    f = f.select(F.col("dm_name").alias("deliveryman"), "delivery_date",
                 X.nmv().alias("amt"), "delivered_litres", "delivered_kg")
    return _day_grain_growth(f, ["deliveryman"], window) \
        .orderBy(F.desc("current_period_sales"), "deliveryman")


# ------------------------------------------------------------------------ M7
def dm_unique_productivity(facts: Facts, window: tuple, town: str,
                           towns: dict | None = None) -> DataFrame:
    """M7 + M8: distinct stores per town × DM now / LY / LM (0 default) and growth.

    Blank DM names and store codes are ignored; store codes are trimmed.
    Growth rule (M8): base 0 and current > 0 → 100 %, both 0 → 0 %.
    """
    wins = P.growth_windows(window)
    f = facts.orders_fact(["delivery_date", "distributor_code", "dm_name", "store_code"],
                          delivery=P.covering(*wins.values()), distributor=town)
    f = f.where(F.col("dm_name").isNotNull() & (F.trim("dm_name") != "")
                & F.col("store_code").isNotNull() & (F.trim("store_code") != ""))
    f = f.select(X.town_label("distributor_code", towns).alias("town"),
                 F.col("dm_name").alias("deliveryman"),
                 F.trim("store_code").alias("store_code"), "delivery_date")
    f = P.tag_periods(f, "delivery_date", wins)
    per = f.groupBy("town", "deliveryman", "period").agg(
        F.count_distinct("store_code").alias("stores"))
    g = _fold_periods(per, ["town", "deliveryman"], [], ["stores"])
    cur = F.coalesce("cur_stores", F.lit(0)).cast("long")
    ly = F.coalesce("ly_stores", F.lit(0)).cast("long")
    lm = F.coalesce("lm_stores", F.lit(0)).cast("long")
    return g.select("town", "deliveryman", cur.alias("current_unique_productive"),
                    ly.alias("last_year_unique_productive"),
                    lm.alias("last_month_unique_productive"),
                    X.growth_zero_base(cur, ly, 2).alias("unique_prod_growth_ly"),
                    X.growth_zero_base(cur, lm, 2).alias("unique_prod_growth_lm")) \
        .orderBy("deliveryman", "town")


# ------------------------------------------------------- derived views
def sum4(col) -> F.Column:
    """Sum of 4-digit money columns, re-rounded so the order of addition of
    doubles cannot change the result."""
    return F.round(F.sum(col), 4)


def brand_growth_overall(m5: DataFrame) -> DataFrame:
    """M9: M5 re-aggregated over channels per brand; growth 0 when base is 0;
    1 digit (half-even, as pandas rounds). NULL brand → 'Unknown Brand'."""
    b = m5.withColumn("brand", F.coalesce("brand", F.lit("Unknown Brand")))
    g = b.groupBy("brand").agg(
        sum4(F.coalesce("current_period_sales", F.lit(0.0))).alias("current_period_sales"),
        sum4(F.coalesce("last_year_sales", F.lit(0.0))).alias("last_year_sales"),
        sum4(F.coalesce("last_month_sales", F.lit(0.0))).alias("last_month_sales"),
        sum4(F.coalesce("current_period_ltr", F.lit(0.0))).alias("current_period_ltr"),
        sum4(F.coalesce("last_year_ltr", F.lit(0.0))).alias("last_year_ltr"))

    def gr(cur, base):
        return F.when(F.col(base) > 0, F.bround((F.col(cur) / F.col(base) - 1.0) * 100.0, 1)) \
            .otherwise(F.lit(0.0))
    return g.select("*", gr("current_period_sales", "last_year_sales").alias("sales_growth_ly"),
                    gr("current_period_sales", "last_month_sales").alias("sales_growth_lm"),
                    gr("current_period_ltr", "last_year_ltr").alias("ltr_growth_ly")) \
        .orderBy(F.desc("current_period_sales"), "brand")


# Upper limits of the growth bands, in %, each within its band
# but for the 0 of the last falling one; a growth of exactly 0 is its own band.
GROWTH_LIMITS = (-30, -20, -10, 0, 10, 20, 30, 50, 70)


def growth_band(g: F.Column) -> F.Column:
    """The band of a growth in %; 'No base' without one."""
    out = F.when(g.isNull(), "No base").when(g == 0, "0%").when(g <= GROWTH_LIMITS[0], f"<= {GROWTH_LIMITS[0]}%")
    for lo, hi in zip(GROWTH_LIMITS, GROWTH_LIMITS[1:]):
        out = out.when(g <= hi, f"{lo}% to {hi}%")
    return out.otherwise(f"> {GROWTH_LIMITS[-1]}%")


def channel_brand_segments(m5: DataFrame, basis: str = "ly") -> DataFrame:
    """Channel → brand segments. size = |growth| (|current| when growth is
    NULL or 0); channel growth = unweighted mean of its brands; growth bands."""
    g = F.col(f"sales_growth_{basis}")
    size = F.when(g.isNull() | (g == 0), F.abs("current_period_sales")).otherwise(F.abs(g))
    band = growth_band(g)
    w = m5.select("channel", F.coalesce("brand", F.lit("Unknown Brand")).alias("brand"),
                  "current_period_sales", g.alias("growth"), size.alias("size"), band.alias("band"))
    ch = w.groupBy("channel").agg(F.round(F.avg("growth"), 4).alias("channel_growth"))
    return w.join(F.broadcast(ch), "channel").orderBy("channel", "brand")  # one row per channel


def channel_growth_order(m4: DataFrame, basis: str = "ly") -> DataFrame:
    """Channels ordered by the chosen growth basis (LY or LM)."""
    col = "sales_growth_lm" if basis.lower() == "lm" else "sales_growth_ly"
    return m4.orderBy(F.desc_nulls_last(col), "channel")


def channel_ranks(m4: DataFrame, basis: str = "ly") -> DataFrame:
    """M11 with each channel's place in that order (one row per channel)."""
    from pyspark.sql.window import Window as W
    col = "sales_growth_lm" if basis.lower() == "lm" else "sales_growth_ly"
    place = F.row_number().over(W.partitionBy("town").orderBy(F.desc_nulls_last(col), "channel"))
    return m4.select("town", "channel", col, place.alias("place"))


def _aov(sales, orders) -> F.Column:
    return F.when(F.coalesce(orders, F.lit(0)) > 0,
                  F.coalesce(sales, F.lit(0.0)) / F.col(orders)).otherwise(F.lit(0.0))


def _pos_growth(cur, base, digits=2) -> F.Column:
    return F.when(base > 0, F.round((cur - base) / base * 100.0, digits)).otherwise(F.lit(0.0))


def channel_aov(m4: DataFrame) -> DataFrame:
    """AOV now / LY / LM per channel and AOV growth (0 when base ≤ 0)."""
    a = m4.select("town", "channel",
                  _aov(F.col("current_period_sales"), "current_orders").alias("aov_current"),
                  _aov(F.col("last_year_sales"), "last_year_orders").alias("aov_ly"),
                  _aov(F.col("last_month_sales"), "last_month_orders").alias("aov_lm"))
    return a.select("town", "channel", F.round("aov_current", 4).alias("aov_current"),
                    F.round("aov_ly", 4).alias("aov_ly"), F.round("aov_lm", 4).alias("aov_lm"),
                    _pos_growth(F.col("aov_current"), F.col("aov_ly")).alias("growth_ly"),
                    _pos_growth(F.col("aov_current"), F.col("aov_lm")).alias("growth_lm")) \
        .orderBy(F.desc("aov_current"), "channel")


def overall_kpi(m3: DataFrame) -> DataFrame:
    """Totals over channels (per-channel distinct orders are added), AOV
    and growth vs LY / LM (0 when the base is ≤ 0)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = m3.agg(sum4(z("current_period_sales")).alias("rev"), sum4(z("last_year_sales")).alias("rev_ly"),
               sum4(z("last_month_sales")).alias("rev_lm"),
               F.sum(z("current_orders")).alias("ord"), F.sum(z("last_year_orders")).alias("ord_ly"),
               F.sum(z("last_month_orders")).alias("ord_lm"),
               sum4(z("current_period_ltr")).alias("ltr"), sum4(z("last_year_ltr")).alias("ltr_ly"),
               sum4(z("last_month_ltr")).alias("ltr_lm"))
    aov = lambda r, o: F.when(F.col(o) > 0, F.col(r) / F.col(o)).otherwise(F.lit(0.0))
    t = t.select("*", aov("rev", "ord").alias("aov"), aov("rev_ly", "ord_ly").alias("aov_ly"),
                 aov("rev_lm", "ord_lm").alias("aov_lm"))
    g = lambda a, b: _pos_growth(F.col(a).cast("double"), F.col(b).cast("double"))
    return t.select(
        F.col("rev").alias("current_revenue"), F.col("rev_ly").alias("ly_revenue"),
        F.col("rev_lm").alias("lm_revenue"), F.col("ord").alias("current_orders"),
        F.col("ord_ly").alias("ly_orders"), F.col("ord_lm").alias("lm_orders"),
        F.col("ltr").alias("current_ltr"), F.col("ltr_ly").alias("ly_ltr"),
        F.col("ltr_lm").alias("lm_ltr"), F.round("aov", 4).alias("aov_current"),
        F.round("aov_ly", 4).alias("aov_ly"), F.round("aov_lm", 4).alias("aov_lm"),
        g("rev", "rev_ly").alias("revenue_growth_ly"), g("rev", "rev_lm").alias("revenue_growth_lm"),
        g("ord", "ord_ly").alias("orders_growth_ly"), g("ord", "ord_lm").alias("orders_growth_lm"),
        g("ltr", "ltr_ly").alias("ltr_growth_ly"), g("ltr", "ltr_lm").alias("ltr_growth_lm"),
        g("aov", "aov_ly").alias("aov_growth_ly"), g("aov", "aov_lm").alias("aov_growth_lm"))


def channel_treemap(facts: Facts, as_of: dt.date, months: int = 6) -> DataFrame:
    """NMV by month × channel over the last ``months`` months, all
    distributors, stores in the universe only (inner join)."""
    lo = P.add_months(as_of, -months)
    f = facts.orders_fact(["delivery_date", "store_code", "delivered_amount", "total_discount"],
                          delivery=(lo, as_of))
    f = f.join(small(universe_by_store(facts.universe())), "store_code", "inner")
    return (f.groupBy(X.month_key("delivery_date").alias("period"),
                      X.channel_or_default("channel_type").alias("channel"))
             .agg(X.dbl(F.sum(X.nmv())).alias("nmv"))
             .orderBy(F.desc("period"), "channel"))


def channel_treemap_past(facts: Facts, town: str, as_of: dt.date, months: int = 7) -> DataFrame:
    """M14, per town: NMV (whole units) by month × channel over the last
    ``months`` months without the current one; a missing channel stays NULL."""
    last = as_of.replace(day=1) - dt.timedelta(days=1)
    f = facts.orders_fact(["delivery_date", "store_code", "delivered_amount", "total_discount"],
                          delivery=(P.add_months(as_of, -months), last), distributor=town)
    f = f.join(small(universe_by_store(facts.universe())), "store_code", "inner")
    return (f.groupBy(X.month_key("delivery_date").alias("period"), F.col("channel_type").alias("channel"))
             .agg(X.dbl(F.round(F.sum(X.nmv()), 0)).alias("nmv")).orderBy("period", "channel"))


def channel_brand_dm_stores(facts: Facts, window: tuple, town: str,
                            towns: dict | None = None) -> DataFrame:
    """Distinct stores per channel × brand × DM from distinct
    (DM, store, SKU, day) rows of one distributor."""
    f = facts.orders_fact(["dm_name", "store_code", "sku_code", "delivery_date", "distributor_code"],
                          delivery=window, distributor=town).distinct()
    f = f.join(small(sku_by_code(facts.sku_master()).select("sku_code", "brand")), "sku_code", "left")
    f = f.join(small(universe_by_store(facts.universe())), "store_code", "left")
    return (f.groupBy(X.channel_or_default("channel_type").alias("channel"), "brand",
                      F.col("dm_name").alias("dm"),
                      X.town_label("distributor_code", towns).alias("town"))
             .agg(F.count_distinct("store_code").alias("store_count"))
             .orderBy("channel", "brand", "dm"))


def brand_productivity(m15: DataFrame, dms: list[str] | None = None,
                       channels: list[str] | None = None) -> DataFrame:
    """Σ store counts per brand (a store counts once per channel × DM)."""
    if dms:
        m15 = m15.where(F.col("dm").isin(*dms))
    if channels:
        m15 = m15.where(F.col("channel").isin(*channels))
    return m15.groupBy("brand").agg(F.sum("store_count").alias("store_count")) \
        .orderBy(F.desc("store_count"), "brand")


def sku_sales(facts: Facts, window: tuple, town: str | None,
              towns: dict | None = None) -> DataFrame:
    """Delivered amount per master SKU (text before ' [') × town, > 0."""
    f = facts.orders_fact(["sku_code", "delivery_date", "distributor_code", "delivered_amount"],
                          delivery=window, distributor=_town_filter(town))
    f = f.join(small(sku_by_code(facts.sku_master()).select("sku_code", "master_sku")),
               "sku_code", "left")
    g = f.groupBy("master_sku", X.town_label("distributor_code", towns).alias("town")) \
         .agg(F.sum("delivered_amount").alias("amt")).where(F.col("amt") > 0)
    return g.select(F.substring_index("master_sku", " [", 1).alias("sku"),
                    X.dbl(F.round("amt", 0)).alias("nmv"), "town", X.dbl("amt").alias("amount")) \
        .orderBy(F.desc("amount"), "sku")


def brand_table(m9: DataFrame, top: int = 10) -> DataFrame:
    """Top ``top`` brands by current sales, ordered by litre growth
    (numerically), plus a grand-total row whose growth is the plain mean."""
    lg = F.when(F.col("last_year_ltr") > 0,
                F.round((F.col("current_period_ltr") / F.col("last_year_ltr") - 1.0) * 100.0, 0))
    t = (m9.select("brand", "current_period_sales", "last_year_sales", "current_period_ltr",
                   "last_year_ltr", lg.alias("ltr_growth_ly"))
           .orderBy(F.desc("current_period_sales"), "brand").limit(top))
    tot = t.agg(F.lit("Grand Total").alias("brand"),
                sum4("current_period_sales").alias("current_period_sales"),
                sum4("last_year_sales").alias("last_year_sales"),
                sum4("current_period_ltr").alias("current_period_ltr"),
                sum4("last_year_ltr").alias("last_year_ltr"),
                F.round(F.avg("ltr_growth_ly"), 2).alias("ltr_growth_ly"))
    return t.withColumn("is_total", F.lit(False)) \
        .unionByName(tot.withColumn("is_total", F.lit(True))) \
        .orderBy("is_total", F.desc_nulls_last("ltr_growth_ly"), "brand")


def daily_gmv(facts: Facts, window: tuple, town: str) -> DataFrame:
    """GMV (order amount, 0 digits) and distinct orders per order date ×
    booker × channel."""
    f = facts.orders_fact(["order_date", "booker_name", "store_code", "order_amount",
                           "order_number"], order_dates=window, distributor=town)
    f = f.join(small(universe_by_store(facts.universe())), "store_code", "left")
    return (f.groupBy("order_date", "booker_name",
                      X.channel_or_default("channel_type").alias("channel"))
             .agg(X.dbl(F.round(F.sum("order_amount"), 0)).alias("gmv"),
                  F.count_distinct("order_number").alias("orders"))
             .orderBy("order_date", "booker_name", "channel"))


def daily_trend(m19: DataFrame, bookers: list[str] | None = None,
                channels: list[str] | None = None) -> DataFrame:
    """Σ GMV and orders per order date, optional booker / channel filter."""
    if bookers:
        m19 = m19.where(F.col("booker_name").isin(*bookers))
    if channels:
        m19 = m19.where(F.col("channel").isin(*channels))
    return m19.groupBy("order_date").agg(F.round(F.sum("gmv"), 4).alias("gmv"),
                                         F.sum("orders").alias("orders")).orderBy("order_date")


def gmv_calendar(m20: DataFrame) -> DataFrame:
    """Every day between the first and last order date (gaps 0), weekday
    (Sunday = 0), week index from the first Sunday-started week, GMV band 0–4
    (limits 40k / 50k / 100k / 500k)."""
    bounds = m20.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    # The day range is generated on executors from the data's own bounds; the
    # first week start travels along with each generated day (no join needed).
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("order_date"),
                         F.date_sub("lo", F.dayofweek("lo") - 1).alias("w0"))
    cal = days.join(m20, "order_date", "left")
    wd = F.dayofweek("order_date") - 1
    g = F.coalesce("gmv", F.lit(0.0))
    band = (F.when(g <= 40000, 0).when(g <= 50000, 1).when(g <= 100000, 2)
            .when(g <= 500000, 3).otherwise(4))
    return cal.select(
        "order_date", g.alias("gmv"), F.coalesce("orders", F.lit(0)).alias("orders"),
        wd.alias("weekday_idx"), F.date_sub("order_date", wd).alias("week_start"),
        (F.datediff(F.date_sub("order_date", wd), F.col("w0")) / 7).cast("int").alias("week_idx"),
        band.alias("band")).orderBy("order_date")


def aov_mopu(facts: Facts, town: str, as_of: dt.date, months_back: int = 6) -> DataFrame:
    """Per order month: orders, drop size (Σ cartons / distinct shops),
    SKU per bill (mean distinct SKUs per order), MOPU (orders / shops)."""
    lo = P.add_months(as_of, -months_back)
    f = facts.orders_fact(["order_number", "order_date", "store_code", "sku_code",
                           "delivered_units"], order_dates=(lo, dt.date(9999, 12, 30)),
                          distributor=town)
    f = f.join(small(sku_by_code(facts.sku_master()).select("sku_code", "uom")), "sku_code", "left")
    per_order = f.groupBy("order_number", "order_date", "store_code").agg(
        F.count_distinct("sku_code").alias("sku_count"),
        # cartons per line rounded to 6 places and summed exactly as decimals
        F.sum(F.round(F.try_divide(F.col("delivered_units").cast("double"),
                                   F.col("uom").cast("double")), 6)
              .cast("decimal(18,6)")).alias("ctn"))
    m = per_order.groupBy(X.month_key("order_date").alias("month")).agg(
        F.count_distinct("order_number").alias("total_orders"),
        F.sum("ctn").alias("ctn"), F.count_distinct("store_code").alias("shops"),
        F.avg("sku_count").alias("sku_per_bill"))
    return m.select("month", "total_orders",
                    F.round(F.col("ctn").cast("double") / F.col("shops"), 4).alias("drop_size"),
                    F.round("sku_per_bill", 4).alias("sku_per_bill"),
                    F.round(F.col("total_orders") / F.col("shops"), 4).alias("mopu")) \
        .orderBy(F.desc("month"))


def account_freshness(facts: Facts, distributors: list[str] | None = None) -> DataFrame:
    """M23 / SRC8: latest order date per distributor (optionally a fixed list)."""
    f = facts.account_dates("orders_fact", "order_date").withColumnRenamed("account_label", "distributor_code")
    if distributors:
        f = f.where(F.col("distributor_code").isin(*distributors))
    return f.groupBy("distributor_code").agg(F.max("day").alias("latest_order_date")) \
        .orderBy("distributor_code")


def channel_share(m4: DataFrame) -> DataFrame:
    """Each channel's share of current sales (window over the aggregated
    rows only: one row per channel)."""
    from pyspark.sql.window import Window as W
    tot = F.sum("current_period_sales").over(W.partitionBy())
    return m4.select("town", "channel", "current_period_sales",
                     F.round(F.col("current_period_sales") / tot * 100.0, 4).alias("share_pct")) \
        .orderBy(F.desc("current_period_sales"), "channel")


def channel_growth_table(m4: DataFrame) -> DataFrame:
    """Value and litre growth vs LY and LM from totals, 0 digits half-even."""
    def g(cur, base):
        return F.bround((X.ratio(cur, base) - 1.0) * 100.0, 0)
    return m4.select("town", "channel",
                     g("current_period_sales", "last_year_sales").alias("value_growth_ly"),
                     g("current_period_sales", "last_month_sales").alias("value_growth_lm"),
                     g("current_period_ltr", "last_year_ltr").alias("ltr_growth_ly"),
                     g("current_period_ltr", "last_month_ltr").alias("ltr_growth_lm")) \
        .orderBy("channel")
