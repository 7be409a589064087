"""Registered queries: each builder bound to the fixed parameters of FIXTURES.md.

Every entry is ``(spark, sf_dir) -> DataFrame`` over the whole input tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType
from pyspark.sql.window import Window as W

from ..operators import sales as S
from ..operators import coverage as C
from ..operators import fieldforce as FF
from ..operators import inventory as I
from ..operators import options as O
from ..operators import quality as Q
from ..operators import sqlrunner as SQ
from ..operators import targets as T
from ..params import (AS_OF, BUCKET_LIMITS, EMPTY_WINDOW, FOCUS_BOOKER, FOCUS_BRANDS, OVERLAP_WINDOW,
                      TARGET_PERIOD, TOWN,
                      WINDOW)
from ..sources.facts import Facts
from . import ingest_plans as IP

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def as_output(df: DataFrame) -> DataFrame:
    """Output contract: exact decimals leave as doubles (one stable schema)."""
    cols = [F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
            else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(cols)


def query(name):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: as_output(fn(Facts.from_dir(spark, sf_dir)))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


@query("m2_kpi_sparkline")
def _m2(f): return S.kpi_sparkline(f, AS_OF, TOWN)


@query("m3_kpi_all")
def _m3(f): return S.kpi(f, OVERLAP_WINDOW, "all")


@query("m4_channel_performance")
def _m4(f): return S.channel_performance(f, WINDOW, TOWN)


@query("m5_brand_growth")
def _m5(f): return S.brand_growth(f, WINDOW, TOWN)


@query("m6_dm_growth")
def _m6(f): return S.dm_growth(f, OVERLAP_WINDOW, TOWN)


@query("m7_dm_unique_productivity")
def _m7(f): return S.dm_unique_productivity(f, WINDOW, TOWN)


@query("m1_revenue_sparkline")
def _m1(f): return S.revenue_sparkline(f, AS_OF, TOWN)


@query("m8_dm_productivity_growth")
def _m8(f):
    return S.dm_unique_productivity(f, WINDOW, TOWN).select(
        "town", "deliveryman", "unique_prod_growth_ly", "unique_prod_growth_lm")


@query("m9_brand_growth_overall")
def _m9(f): return S.brand_growth_overall(S.brand_growth(f, WINDOW, TOWN))


@query("m10_channel_brand_segments")
def _m10(f): return S.channel_brand_segments(S.brand_growth(f, WINDOW, TOWN))


@query("m11_channel_growth_order")
def _m11(f): return S.channel_growth_order(S.channel_performance(f, WINDOW, TOWN), "lm")


@query("m12_channel_aov")
def _m12(f): return S.channel_aov(S.channel_performance(f, WINDOW, TOWN))


@query("m13_overall_kpi")
def _m13(f): return S.overall_kpi(S.kpi(f, OVERLAP_WINDOW, "all"))


@query("m14_channel_treemap")
def _m14(f): return S.channel_treemap(f, AS_OF)


@query("m15_channel_brand_dm_stores")
def _m15(f): return S.channel_brand_dm_stores(f, WINDOW, TOWN)


@query("m16_brand_productivity")
def _m16(f): return S.brand_productivity(S.channel_brand_dm_stores(f, WINDOW, TOWN))


@query("m17_sku_sales")
def _m17(f): return S.sku_sales(f, WINDOW, "all")


@query("m18_brand_table")
def _m18(f): return S.brand_table(S.brand_growth_overall(S.brand_growth(f, WINDOW, TOWN)))


@query("m19_daily_gmv")
def _m19(f): return S.daily_gmv(f, WINDOW, TOWN)


@query("m20_daily_trend")
def _m20(f): return S.daily_trend(S.daily_gmv(f, WINDOW, TOWN))


@query("m21_gmv_calendar")
def _m21(f): return S.gmv_calendar(S.daily_trend(S.daily_gmv(f, WINDOW, TOWN)))


@query("m22_aov_mopu")
def _m22(f): return S.aov_mopu(f, TOWN, AS_OF, 6)


@query("m23_account_freshness")
def _m23(f): return S.account_freshness(f)


@query("m24_channel_share")
def _m24(f): return S.channel_share(S.channel_performance(f, WINDOW, TOWN))


@query("m25_channel_growth_table")
def _m25(f): return S.channel_growth_table(S.channel_performance(f, WINDOW, TOWN))


@query("t1_target_vs_ach_monthly")
def _t1(f): return T.target_vs_ach_monthly(f, TOWN)


@query("t2_target_vs_ach_booker")
def _t2(f): return T.target_vs_ach_booker(f, TOWN)


@query("t3_channel_month")
def _t3(f): return T.channel_month(f, TOWN, AS_OF)


@query("t4_target_vs_ach_brand")
def _t4(f): return T.target_vs_ach_brand(f, TOWN, TARGET_PERIOD)


@query("t8_brand_target_summary")
def _t8(f): return T.brand_target_summary(T.target_vs_ach_brand(f, TOWN, TARGET_PERIOD))


@query("t9_ob_achievement")
def _t9(f): return T.ob_achievement(f, WINDOW, TOWN)


@query("t10_period_target_total")
def _t10(f): return T.period_target_total(f, OVERLAP_WINDOW, TOWN)


@query("t11_target_upload_status")
def _t11(f): return T.target_upload_status(f, TOWN, AS_OF)


@query("f1_fieldforce")
def _f1(f): return FF.fieldforce(f, WINDOW, TOWN)


@query("f2_booker_rollup")
def _f2(f): return FF.booker_rollup(FF.fieldforce(f, WINDOW, TOWN))


@query("f3_daily_calls")
def _f3(f): return FF.daily_calls(f, WINDOW, TOWN)


@query("f4_daily_calls_trend")
def _f4(f): return FF.daily_calls_trend(FF.daily_calls(f, WINDOW, TOWN))


@query("f5_calls_kpi")
def _f5(f): return FF.calls_kpi(f, WINDOW, TOWN)


@query("f6_orders_placed")
def _f6(f): return FF.orders_placed(f, WINDOW, TOWN)


@query("f7_leaderboard")
def _f7(f): return FF.leaderboard(f, WINDOW, TOWN)


@query("f8_performance_score")
def _f8(f): return FF.performance_score(FF.leaderboard(f, WINDOW, TOWN))


@query("f9_top_bottom")
def _f9(f): return FF.top_bottom(FF.performance_score(FF.leaderboard(f, WINDOW, TOWN)))


@query("f10_under_performers")
def _f10(f): return FF.under_performers(FF.leaderboard(f, WINDOW, TOWN))


@query("f11_booker_snapshot")
def _f11(f): return FF.booker_snapshot(f, WINDOW, TOWN)


@query("f12_funnel")
def _f12(f): return FF.funnel(f, WINDOW, TOWN)


@query("f13_store_activity")
def _f13(f): return FF.store_activity(f, WINDOW, TOWN)


@query("f14_booker_store_activity")
def _f14(f): return FF.booker_store_activity(f, WINDOW, TOWN)


@query("f15_store_segments")
def _f15(f): return FF.segment(FF.store_activity(f, WINDOW, TOWN), WINDOW)


@query("f15_segment_summary")
def _f15s(f): return FF.segment_summary(FF.segment(FF.store_activity(f, WINDOW, TOWN), WINDOW))


@query("f16_booker_segment_matrix")
def _f16(f):
    return FF.booker_segment_matrix(FF.segment(FF.booker_store_activity(f, WINDOW, TOWN), WINDOW))


@query("f17_booker_outlets")
def _f17(f): return FF.booker_outlets(FF.booker_store_activity(f, WINDOW, TOWN), FOCUS_BOOKER)


@query("f18_cohort_orders")
def _f18(f): return FF.cohort_orders(f, OVERLAP_WINDOW, TOWN)


@query("f19_weekly_retention")
def _f19(f): return FF.weekly_retention(FF.cohort_orders(f, OVERLAP_WINDOW, TOWN))


@query("f20_sku_per_bill")
def _f20(f): return FF.sku_per_bill(f, WINDOW, TOWN)


@query("f21_sku_per_bill_vs_mean")
def _f21(f): return FF.sku_per_bill_vs_mean(FF.leaderboard(f, WINDOW, TOWN))


@query("f22_booker_brand_scoring")
def _f22(f): return FF.booker_brand_scoring(f, WINDOW, TOWN)


@query("f23_brand_scores")
def _f23(f): return FF.brand_scores(FF.booker_brand_scoring(f, WINDOW, TOWN))


@query("f24_brand_focus")
def _f24(f): return FF.brand_focus(FF.booker_brand_scoring(f, WINDOW, TOWN))


@query("f25_top_brands")
def _f25(f): return FF.top_brands(FF.booker_brand_scoring(f, WINDOW, TOWN))


@query("f26_top_bookers")
def _f26(f): return FF.top_bookers(FF.booker_rollup(FF.fieldforce(f, WINDOW, TOWN)))


@query("f27_dm_efficiency")
def _f27(f): return FF.dm_efficiency(FF.fieldforce(f, WINDOW, TOWN))


@query("f28_visit_frequency")
def _f28(f): return FF.visit_frequency(f, TOWN, AS_OF)


@query("f29_half_carton")
def _f29(f): return FF.half_carton_by_booker(FF.half_carton(f, TOWN, AS_OF))


@query("f29_half_carton_detail")
def _f29d(f): return FF.half_carton(f, TOWN, AS_OF)


@query("f30_half_carton_matrix")
def _f30(f): return FF.half_carton_matrix(FF.half_carton(f, TOWN, AS_OF))


@query("f31_segmentation_table")
def _f31(f):
    seg = FF.segment(FF.booker_store_activity(f, WINDOW, TOWN), WINDOW)
    return FF.segmentation_table(seg, segments=[FF.SEGMENTS[0], FF.SEGMENTS[3]])


@query("i1_snapshot_dates")
def _i1(f): return I.snapshot_dates(f, TOWN, AS_OF - dt.timedelta(days=3))


@query("i2_stock_by_sku")
def _i2(f): return I.stock_by_sku(f, TOWN, AS_OF)


@query("i3_sales_by_sku")
def _i3(f): return I.sales_by_sku(f, TOWN, AS_OF, 90)


@query("i4_inventory_kpi")
def _i4(f): return I.inventory_kpi(f, TOWN, AS_OF)


@query("i5_month_end_stock")
def _i5(f): return I.month_end_stock(f, TOWN, AS_OF)


@query("i6_stock_movement")
def _i6(f): return I.stock_movement(f, TOWN, AS_OF)


@query("i7_days_cover_by_category")
def _i7(f): return I.days_cover_by_category(f, TOWN, AS_OF)


@query("i8_cover_bucket_matrix")
def _i8(f): return I.cover_bucket_matrix(f, "all", AS_OF, BUCKET_LIMITS)


@query("i8_cover_bucket_shares")
def _i8s(f): return I.cover_bucket_shares(I.cover_bucket_matrix(f, "all", AS_OF, BUCKET_LIMITS), BUCKET_LIMITS)


@query("i9_inventory_health")
def _i9(f): return I.inventory_health(f, TOWN, AS_OF)


@query("i10_dead_stock")
def _i10(f): return I.dead_stock(f, TOWN, AS_OF)


@query("jn9_stock_as_of_delivery")
def _jn9(f): return I.stock_as_of_delivery(f, WINDOW, TOWN)


@query("i13_kpi_delta")
def _i13(f): return I.kpi_delta(I.inventory_kpi(f, TOWN, AS_OF))


@query("i14_health_bands")
def _i14(f): return I.health_bands(I.inventory_health(f, TOWN, AS_OF))


def _c3(f):
    return C.visit_coverage(f, WINDOW, TOWN, FOCUS_BRANDS)


@query("c1_coverage_visits")
def _c1q(f): return C.coverage_visits(f, WINDOW, TOWN)


@query("c2_coverage_sales")
def _c2q(f): return C.coverage_sales(f, WINDOW, TOWN)


@query("c3_visit_brand_sales")
def _c3l(f): return C.visit_brand_long(f, WINDOW, TOWN)[1]


@query("c3_visit_coverage")
def _c3q(f): return _c3(f)


@query("c4_rescore")
def _c4(f): return C.rescore(f, WINDOW, TOWN, FOCUS_BRANDS[:2])


@query("c5_coverage_levels")
def _c5(f): return C.coverage_levels(_c3(f), len(FOCUS_BRANDS))


@query("c6_sell_rate")
def _c6(f): return C.sell_rate(_c3(f), FOCUS_BRANDS)


@query("c7_daily_coverage")
def _c7(f): return C.daily_coverage(_c3(f), FOCUS_BRANDS)


@query("c8_miss_matrix")
def _c8(f): return C.miss_matrix(_c3(f), FOCUS_BRANDS)


@query("c9_last_visit_gap")
def _c9(f): return C.last_visit_gap(_c3(f), FOCUS_BRANDS)


@query("c10_daily_brand_shops")
def _c10(f): return C.daily_brand_shops(f, WINDOW, TOWN, FOCUS_BRANDS)


@query("c11_shop_day_detail")
def _c11(f): return C.shop_day_detail(_c3(f))


@query("c12_booker_day_matrix")
def _c12(f): return C.booker_day_matrix(_c3(f), FOCUS_BRANDS)


@query("c13_shop_table")
def _c13(f): return C.shop_table(_c3(f), FOCUS_BRANDS, missed_only=True)


@query("c14_booker_summary")
def _c14(f): return C.booker_summary(_c3(f), FOCUS_BRANDS)


@query("c14_booker_detail")
def _c14d(f): return C.booker_detail(_c3(f))


@query("c15_coverage_kpi")
def _c15(f): return C.coverage_kpi(_c3(f), FOCUS_BRANDS)


@query("qa_unknown_brand_skus")
def _qa(f): return Q.unknown_brand_skus(f, OVERLAP_WINDOW, TOWN)


@query("qb_missing_targets")
def _qb(f): return Q.missing_targets(f, TOWN, AS_OF)


@query("qc_missing_shops")
def _qc(f): return Q.missing_shops(f, OVERLAP_WINDOW, TOWN)


@query("src5_channel_options")
def _src5(f): return O.channel_options(f, WINDOW, TOWN)


@query("src6_month_channel_options")
def _src6(f): return O.month_channel_options(f, TOWN, TARGET_PERIOD)


@query("src7_target_period_options")
def _src7(f): return O.target_period_options(f, TOWN)


@query("src9_latest_visit_date")
def _src9(f): return O.latest_visit_date(f, TOWN)


@query("src10_calls_with_fallback")
def _src10(f): return FF.daily_calls(f, O.window_with_fallback(f, EMPTY_WINDOW, TOWN), TOWN)


@query("ing_order_report_roundtrip")
def _ing1(f): return IP.order_report_roundtrip(f)


@query("ing_stock_report_roundtrip")
def _ing4(f): return IP.stock_report_roundtrip(f)


@query("ing_visit_report_roundtrip")
def _ingv(f): return IP.visit_report_roundtrip(f)


@query("ing12_stock_upsert")
def _ing12(f): return IP.stock_upsert(f)


@query("ing14_stock_replace_period")
def _ing14(f): return IP.stock_replace_period(f)


@query("ing13_high_water_marks")
def _ing13(f): return IP.high_water_marks(f)


@query("m11_channel_ranks")
def _m11r(f): return S.channel_ranks(S.channel_performance(f, WINDOW, TOWN), "lm")


@query("m14_channel_treemap_past")
def _m14p(f): return S.channel_treemap_past(f, TOWN, AS_OF)


@query("t2_booker_month_matrix")
def _t2m(f): return T.booker_month_matrix(T.target_vs_ach_booker(f, TOWN), ["1-2001", "2-2001", "3-2001"])


@query("t3_channel_month_all")
def _t3a(f): return T.channel_month_all(f, None)


@query("t7_flow_links_brand")
def _t7b(f):
    return T.flow_links(T.target_vs_ach_brand(f, TOWN, TARGET_PERIOD), 3, 2, source="brand", target="booker")


@query("t13_achievement_bands")
def _t13(f): return T.achievement_bands(T.ob_achievement(f, WINDOW, TOWN), "booker", "achieved_pct")


@query("t13_band_counts")
def _t13c(f): return T.band_counts(FF.leaderboard(f, WINDOW, TOWN), "achievement_pct")


for _cut in (50, 60, 70):
    query(f"flt13_below_{_cut}")(
        lambda f, cut=_cut: T.below_achievement(T.target_vs_ach_brand(f, TOWN, TARGET_PERIOD), cut))


@query("f12_funnel_overall")
def _f12o(f): return FF.funnel_overall(FF.funnel(f, WINDOW, TOWN))


@query("f30_half_carton_drilldown")
def _f30d(f): return FF.half_carton_drilldown(FF.half_carton(f, TOWN, AS_OF))


@query("st4_brand_universe")
def _st4(f): return C.brand_universe(f, WINDOW, TOWN, (*FOCUS_BRANDS, "No such brand"))


@query("flt6_orders_placed_channels")
def _flt6(f): return FF.orders_placed(f, WINDOW, TOWN, channels=["BUILDING", "MACHINERY"])


@query("flt6_sku_per_bill_bookers")
def _flt6b(f):
    return FF.sku_per_bill(f, WINDOW, TOWN, channels=["BUILDING", "MACHINERY"],
                           bookers=[f"Supplier#00000000{i}" for i in (1, 2, 3)])


@query("i7_days_cover_bands")
def _i7b(f):
    top = I.days_cover_by_category(f, TOWN, AS_OF, top=12)
    return top.select("category", "days_cover", I.cover_band().alias("band"))


class _Renamed(Facts):
    """A master in which one SKU in nine is renamed and another one in nine has no real brand."""

    def sku_master(self):
        k = F.col("sku_code").cast("long")
        m = super().sku_master()
        new = {c: F.when(k % 9 == 0, "renamed").otherwise(F.col(c)) for c in ("master_sku", "short_master", "sku")}
        new["brand"] = F.when(k % 18 == 1, " Unkown").when(k % 18 == 10, "N/A").otherwise(F.col("brand"))
        return m.withColumns(new).withColumn(
            "sku_code", F.when(k % 9 == 0, F.concat(F.lit("x"), "sku_code")).otherwise(F.col("sku_code")))


def _in_order(df: DataFrame) -> DataFrame:
    """SO1: the rows with their place in the order that the builder gives them (a few hundred rows)."""
    placed = df.withColumn("at", F.monotonically_increasing_id())
    return placed.withColumn("position", F.row_number().over(W.orderBy("at"))).drop("at")


@query("so1_leaderboard_order")
def _so1f7(f): return _in_order(FF.leaderboard(f, WINDOW, TOWN)).select("booker", "revenue", "position")


@query("so1_days_cover_order")
def _so1i7(f): return _in_order(I.days_cover_by_category(f, TOWN, AS_OF)).select("category", "days_cover", "position")


@query("so1_booker_brand_order")
def _so1f22(f): return _in_order(FF.booker_brand_scoring(f, WINDOW, TOWN)).select("booker", "brand", "nmv", "position")


class _Classed(Facts):
    """A master in which every brand class of PRJ11 occurs."""

    def sku_master(self):
        k = F.pmod(F.col("sku_code").cast("long"), F.lit(7))
        slug = F.when(k == 0, ".Olper TBA").when(k == 1, "big .OLPER TBA 1l").when(k == 2, "Mini Tarang").otherwise("plain")
        brand = F.when(k == 3, " Tarang Tea").when(k == 4, " Olpers MILK ").when(k == 5, " ").otherwise(F.col("brand"))
        return super().sku_master().withColumn("slug", slug).withColumn("brand", brand)


@query("prj11_brand_classes")
def _prj11(f):
    sold = C.coverage_sales(_Classed(f.t, f.as_of), WINDOW, TOWN)
    return sold.groupBy("brand").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("nmv").cast("double").alias("nmv"))


@query("qa_unknown_brand_renamed")
def _qar(f): return Q.unknown_brand_skus(_Renamed(f.t, f.as_of), OVERLAP_WINDOW, TOWN)


@query("ing5_stock_without_header")
def _ing5(f): return IP.stock_without_header(f)


@query("ing12_write_upsert")
def _ing12w(f): return IP.written_upsert(f)


@query("ing14_write_replace_period")
def _ing14w(f): return IP.written_replace_period(f)


@query("ing13_marks_of_loaded_tables")
def _ing13m(f): return IP.marks_of_loaded_tables(f)


@query("ing16_load_audit")
def _ing16(f): return IP.load_audit(f)


@query("ing17_schema_changes")
def _ing17(f): return IP.schema_changes(f)


def _sample(name):
    def run(f):
        SQ.register_views(f)
        return SQ.safe_select(f.spark, SQ.sample_queries(TOWN, AS_OF)[name])
    return run


for _n in SQ.sample_queries(TOWN, AS_OF):
    query(f"sql2_{_n}")(_sample(_n))


@query("t5_booker_brand_hierarchy")
def _t5(f): return T.booker_brand_hierarchy(T.target_vs_ach_brand(f, TOWN, TARGET_PERIOD))


@query("t6_brand_booker_hierarchy")
def _t6(f): return T.brand_booker_hierarchy(T.target_vs_ach_brand(f, TOWN, TARGET_PERIOD))


@query("t7_flow_links")
def _t7(f): return T.flow_links(T.target_vs_ach_brand(f, TOWN, TARGET_PERIOD))
