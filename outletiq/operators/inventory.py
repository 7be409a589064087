"""Inventory builders (I1–I14): snapshots, cover, buckets, health, dead stock.

Snapshot look-ups (JN9: latest snapshot ≤ a date, and the one before it) are
scalar subqueries of the plan: nothing runs before the result is asked for.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import exprs as X
from ..functions.asof import asof_join
from ..functions.joins import calendar, month_calendar, small
from ..functions.periods import add_months
from ..params import TOWNS
from ..sources.facts import Facts
from .staging import once

# Health-band limits and dead-stock rule.
PAR_COVER_DAYS = 14.0
DEAD_SHARE = 0.02
DEAD_COVER_DAYS = 25


def _stock(facts: Facts, town: str | None, dates: tuple | None = None) -> DataFrame:
    return facts.stock_fact(report_dates=dates, distributor=None if town in (None, "all") else town)


def _value_unit(s: DataFrame) -> DataFrame:
    """FLT9: LOWER(COALESCE(unit, '')) = 'value'."""
    return s.where(F.lower(F.coalesce("unit", F.lit(""))) == "value")


def _money():
    return F.coalesce("delivered_amount", F.lit(0)) + F.coalesce("total_discount", F.lit(0))


def latest_snapshot(facts: Facts, town: str, end: dt.date) -> F.Column:
    """JN9 scalar: the latest snapshot date ≤ ``end`` (any unit); NULL for none."""
    return _stock(facts, town).where(F.col("report_date") <= F.lit(end)).agg(F.max("report_date")).scalar()


def previous_snapshot(facts: Facts, town: str, end: dt.date) -> F.Column:
    """JN9 scalar: the snapshot date just before the latest one ≤ ``end``."""
    s = _stock(facts, town).where(F.col("report_date") < latest_snapshot(facts, town, end))
    return s.agg(F.max("report_date")).scalar()


def snapshot_dates(facts: Facts, town: str, end: dt.date) -> DataFrame:
    """I1 (lazy form): latest snapshot ≤ end and the one before, as one row.
    Ranks the distinct snapshot dates (one row per day, not per SKU)."""
    d = _stock(facts, town).where(F.col("report_date") <= F.lit(end)) \
        .select("report_date").distinct()
    d = d.withColumn("rk", F.row_number().over(W.partitionBy().orderBy(F.desc("report_date"))))
    return d.agg(F.max(F.when(F.col("rk") == 1, F.col("report_date"))).alias("latest_report_date"),
                 F.max(F.when(F.col("rk") == 2, F.col("report_date"))).alias("prev_report_date"))


def stock_by_sku(facts: Facts, town: str, day: dt.date | F.Column) -> DataFrame:
    """Stock value per SKU at ``day`` (unit 'value'), 4 digits."""
    days = None if isinstance(day, F.Column) else (day, day)
    s = _value_unit(_stock(facts, town, days).where(F.col("report_date") == (day if days is None else F.lit(day))))
    return s.groupBy("sku_code").agg(F.round(F.sum(F.coalesce("value", F.lit(0))), 4)
                                     .alias("stock_value"))


def sales_by_sku(facts: Facts, town: str, end: dt.date, days: int, name: str = "sales_value") -> DataFrame:
    """Guarded NMV per SKU over the ``days`` days ending at ``end``."""
    f = facts.orders_fact(["sku_code", "delivery_date", "delivered_amount", "total_discount"],
                          delivery=(end - dt.timedelta(days=days - 1), end), distributor=town)
    return f.groupBy("sku_code").agg(F.round(F.sum(_money()), 4).alias(name))


def inventory_kpi(facts: Facts, town: str, end: dt.date) -> DataFrame:
    """I4: KPI rows for the latest snapshot ≤ end ('current') and the one
    before ('previous'); sales windows end at each snapshot date (Q12).

    One pass over the stock and one over the sales: each row counts for the
    snapshots whose day or window holds it."""
    at = {"current": latest_snapshot(facts, town, end), "previous": previous_snapshot(facts, town, end)}
    both = F.array(*[F.struct(F.lit(p).alias("period"), d.alias("day")) for p, d in at.items()])
    days = facts.spark.range(1).select(F.explode(both).alias("x")).select("x.*").where(F.col("day").isNotNull())
    s = _value_unit(_stock(facts, town)).where(F.col("report_date") <= F.lit(end))
    s = s.join(F.broadcast(days), F.col("report_date") == F.col("day"))  # two rows
    st = s.groupBy("period", "day", "sku_code").agg(
        F.round(F.sum(F.coalesce("value", F.lit(0))), 4).alias("stock_value"))
    f = facts.orders_fact(["sku_code", "delivery_date", "delivered_amount", "total_discount"],
                          delivery=(None, end), distributor=town)
    f = f.withColumns(at).where(F.col("delivery_date") >= F.date_sub(F.coalesce("previous", "current"), 89))
    held = lambda p, n: F.sum(F.when(F.col("delivery_date").between(F.date_sub(p, n - 1), F.col(p)), _money()))
    sales = f.groupBy("sku_code").agg(*[F.round(held(p, n), 4).alias(f"{p}_{n}") for p in at for n in (90, 30)])
    m = st.join(sales, "sku_code", "left")
    now = F.col("period") == "current"
    m = m.withColumns({f"sales_{n}": F.when(now, F.col(f"current_{n}")).otherwise(F.col(f"previous_{n}"))
                       for n in (90, 30)})
    sv = F.coalesce("stock_value", F.lit(0))
    s9 = F.coalesce("sales_90", F.lit(0))
    s3 = F.coalesce("sales_30", F.lit(0))
    valid = (sv > 0) & (s9 > 0)
    g = m.groupBy("period", F.col("day").alias("report_date")).agg(
        F.count_distinct("sku_code").alias("total_skus"),
        F.sum(sv).alias("value"), F.count_if(sv > 0).alias("in_stock"),
        F.count_if(sv <= 0).alias("oos_skus"),
        F.sum(F.when(valid, sv)).alias("vs"), F.sum(F.when(valid, s9)).alias("vq"),
        F.count_if((sv > 0) & (s3 <= 0)).alias("slow_movers"))
    # Sales-weighted mean of stock / (sales90 / 90) = 90 · Σstock / Σsales90 over valid SKUs.
    return g.select("period", "report_date", "total_skus",
                    X.dbl(F.coalesce("value", F.lit(0))).alias("current_inventory_value"),
                    F.when(F.col("total_skus") > 0,
                           F.round(F.col("in_stock") / F.col("total_skus") * 100.0, 4))
                     .otherwise(F.lit(0.0)).alias("in_stock_rate"),
                    "oos_skus",
                    F.coalesce(F.round(F.col("vs").cast("double") * 90.0 / F.col("vq").cast("double"), 4),
                               F.lit(0.0)).alias("avg_days_cover"),
                    "slow_movers").orderBy("period")


def kpi_delta(i4: DataFrame) -> DataFrame:
    """Current − previous per KPI; for OOS SKUs a fall is the good direction."""
    i4 = once(i4)  # two rows
    cur = i4.where(F.col("period") == "current").drop("period", "report_date")
    prev = i4.where(F.col("period") == "previous").drop("period", "report_date")
    metrics = [c for c in cur.columns]
    p = prev.select([F.col(c).alias(f"p_{c}") for c in metrics])
    j = cur.unionByName(p, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in metrics], *[F.max(f"p_{c}").alias(f"p_{c}") for c in metrics])
    cols = []
    for c in metrics:
        d = F.round(F.col(c).cast("double") - F.col(f"p_{c}").cast("double"), 4)
        good = d < 0 if c == "oos_skus" else d >= 0
        cols += [d.alias(f"{c}_delta"), good.alias(f"{c}_good")]
    return j.select(*cols)


def month_end_stock(facts: Facts, town: str, end: dt.date) -> DataFrame:
    """Stock value at each month-end snapshot for the 12 months to ``end``
    (only snapshots dated exactly on a month end); months without one are 0."""
    last = end.replace(day=1)
    first = add_months(last, -11)
    s = _value_unit(_stock(facts, town, (first, end)))
    s = s.where((F.col("report_date") >= F.lit(first)) & (F.col("report_date") <= F.lit(end))
                & (F.col("report_date") == F.last_day("report_date")))
    per_day = s.groupBy("report_date").agg(F.round(F.sum(F.coalesce("value", F.lit(0))), 4).alias("v"))
    m = per_day.groupBy(F.trunc("report_date", "month").alias("month_start")).agg(
        F.max_by("v", "report_date").alias("inventory_value"))
    cal = month_calendar(facts.spark, first, 12, "month_start")
    return cal.join(m, "month_start", "left").select(
        "month_start", X.dbl(F.coalesce("inventory_value", F.lit(0))).alias("inventory_value")) \
        .orderBy("month_start")


def stock_movement(facts: Facts, town: str, end: dt.date, carry_forward: bool = False) -> DataFrame:
    """30-day inflow / outflow. Daily stock on a zero-filled 31-day calendar
    (Q8: a missing day reads 0; ``carry_forward`` repeats the last value
    instead); inflow = positive day-over-day change, outflow = daily sales."""
    s31, s30 = end - dt.timedelta(days=30), end - dt.timedelta(days=29)
    st = _value_unit(_stock(facts, town, (s31, end))).groupBy("report_date") \
        .agg(F.round(F.sum(F.coalesce("value", F.lit(0))), 4).alias("stock_value"))
    cal = calendar(facts.spark, s31, end, "report_date").join(st, "report_date", "left")
    w = W.partitionBy().orderBy("report_date")  # 31 calendar rows, not fact rows
    if carry_forward:
        sv = F.last("stock_value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        cal = cal.withColumn("stock_value", F.coalesce(sv, F.lit(0)))
    else:
        cal = cal.withColumn("stock_value", F.coalesce("stock_value", F.lit(0)))
    prev = F.coalesce(F.lag("stock_value").over(w), F.col("stock_value"))
    cal = cal.withColumn("inflow_value", F.greatest(F.col("stock_value") - prev, F.lit(0)))
    sales = facts.orders_fact(["delivery_date", "delivered_amount", "total_discount"],
                              delivery=(s30, end), distributor=town) \
        .groupBy(F.col("delivery_date").alias("report_date")) \
        .agg(F.round(F.sum(_money()), 4).alias("outflow_value"))
    return cal.where(F.col("report_date") >= F.lit(s30)).join(sales, "report_date", "left") \
        .select("report_date", X.dbl("inflow_value").alias("inflow_value"),
                X.dbl(F.coalesce("outflow_value", F.lit(0))).alias("outflow_value")) \
        .orderBy("report_date")


def stock_as_of_delivery(facts: Facts, window: tuple, town: str) -> DataFrame:
    """JN9 per row: units and value delivered per SKU and day, with the SKU's latest
    stock snapshot (value unit) that is not later than the day."""
    f = facts.orders_fact(["sku_code", "delivery_date", "order_units", "delivered_amount", "total_discount"],
                          delivery=window, distributor=town)
    sold = f.groupBy("sku_code", "delivery_date").agg(
        F.sum(F.coalesce("order_units", F.lit(0))).cast("double").alias("units"),
        X.dbl(F.round(F.sum(_money()), 4)).alias("delivered_value"))
    s = _value_unit(_stock(facts, town)).select("sku_code", "report_date", X.dbl("value").alias("stock_value"))
    s = s.withColumn("snapshot_date", F.col("report_date"))
    return asof_join(sold, s, ["sku_code"], "delivery_date", "report_date", ["snapshot_date", "stock_value"])


def _sku_category(facts: Facts, town: str) -> DataFrame:
    """Category of each SKU at its latest delivery (all history); one per SKU (Q7)."""
    f = facts.orders_fact(["sku_code", "delivery_date", "category_name"], distributor=town)
    name = X.blank_to("category_name")
    return f.groupBy("sku_code").agg(F.max_by(name, F.struct("delivery_date", name)).alias("category_name"))


def days_cover_by_category(facts: Facts, town: str, end: dt.date, top: int | None = None) -> DataFrame:
    """Stock at the latest snapshot ≤ end ÷ (30-day sales ending at ``end`` / 30)
    per category; 2 digits; NULL without sales."""
    st = stock_by_sku(facts, town, latest_snapshot(facts, town, end))
    s30 = sales_by_sku(facts, town, end, 30, "sales_30")
    j = st.join(s30, "sku_code", "left").join(_sku_category(facts, town), "sku_code", "left")
    g = j.groupBy(F.coalesce("category_name", F.lit("Unknown")).alias("category")).agg(
        F.round(F.sum(F.coalesce("stock_value", F.lit(0))), 4).alias("stock_value"),
        F.round(F.sum(F.coalesce("sales_30", F.lit(0))), 4).alias("sales_30"))
    out = g.select("category", X.dbl("stock_value").alias("stock_value"),
                   X.dbl("sales_30").alias("sales_30"),
                   F.when(F.col("sales_30") > 0,
                          F.round(F.col("stock_value").cast("double")
                                  / (F.col("sales_30").cast("double") / 30.0), 2)).alias("days_cover")) \
        .orderBy(F.desc_nulls_last("days_cover"), "category")
    return out.limit(top) if top else out


def cover_band(col="days_cover", low: int = 7, high: int = 14) -> F.Column:
    """I7 colour bands: < 7 low, < 14 watch, else healthy; NULL without sales."""
    v = F.col(col)
    return F.when(v < low, "low").when(v < high, "watch").when(v.isNotNull(), "healthy")


def bucket_names(limits) -> list[str]:
    t = sorted(float(x) for x in limits)
    return ([f"Inventory <{int(t[0])}"]
            + [f"Inventory {int(a)}-{int(b)}" for a, b in zip(t, t[1:])]
            + [f"Inventory {int(t[-1])}+", "Zero Sale"])


def _bucket_base(facts: Facts, town: str | None, end: dt.date, limits) -> DataFrame:
    s = _stock(facts, town).where(F.col("report_date") <= F.lit(end))
    latest = s.groupBy("distributor_code").agg(F.max("report_date").alias("d"))
    s = _value_unit(s.join(small(latest), (s.distributor_code == latest.distributor_code)
                           & (s.report_date == latest.d), "left_semi"))
    st = s.groupBy("distributor_code", "sku_code").agg(
        F.round(F.sum(F.coalesce("value", F.lit(0))), 4).alias("stock_value"))
    f = facts.orders_fact(["distributor_code", "sku_code", "delivery_date", "delivered_amount",
                           "total_discount"], delivery=(end - dt.timedelta(days=89), end),
                          distributor=None if town in (None, "all") else town)
    sl = f.groupBy("distributor_code", "sku_code").agg(F.round(F.sum(_money()), 4).alias("sales_90"))
    b = st.join(sl, ["distributor_code", "sku_code"], "left") \
        .select("distributor_code", "sku_code", F.col("stock_value").cast("double").alias("sv"),
                F.coalesce(F.col("sales_90").cast("double"), F.lit(0.0)).alias("s90")) \
        .where(F.col("sv") > 0)
    # Account label: mapped town name, else the distributor code itself.
    acct = F.coalesce(F.create_map(*[F.lit(x) for kv in TOWNS.items() for x in kv])[F.col("distributor_code")],
                      F.col("distributor_code"))
    return b.withColumn("account", acct) \
        .withColumn("cover", F.try_divide(F.col("sv"), F.col("s90") / 90.0))


def cover_bucket_matrix(facts: Facts, town: str | None, end: dt.date, limits=(7, 15, 30, 45, 60)) -> DataFrame:
    """I8: stock value by cover-day bucket per account (each distributor at its
    own latest snapshot ≤ end); half-open buckets [a, b); no sales → Zero Sale;
    stock > 0 only. Bucket columns are fixed by the limits (stable schema)."""
    t = sorted(float(x) for x in limits)
    names = bucket_names(limits)
    b = _bucket_base(facts, town, end, limits)
    sold = F.col("s90") > 0
    cv = F.col("cover")
    conds = [sold & (cv < t[0])] + [sold & (cv >= a) & (cv < c) for a, c in zip(t, t[1:])] \
        + [sold & (cv >= t[-1]), ~sold]
    aggs = [F.round(F.sum("sv"), 4).alias("total_inventory")] + \
        [F.round(F.sum(F.when(c, F.col("sv")).otherwise(F.lit(0.0))), 4).alias(n)
         for c, n in zip(conds, names)]
    return b.groupBy("account").agg(*aggs).orderBy("account")


def cover_bucket_shares(i8: DataFrame, limits=(7, 15, 30, 45, 60)) -> DataFrame:
    """I8 share row: each bucket's % of the grand total (long form)."""
    names = bucket_names(limits)
    tot = i8.agg(*[F.sum(F.col(f"`{n}`")).alias(n) for n in names],
                 F.sum("total_inventory").alias("__t"))
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("v"))
                                for n in names]))
    return tot.select(stack.alias("s"), "__t").select(
        "s.bucket", F.when(F.col("__t") > 0, F.round(F.col("s.v") / F.col("__t") * 100.0, 4))
        .otherwise(F.lit(0.0)).alias("share_pct"))


def sales_two_windows(facts: Facts, town: str, end: dt.date) -> DataFrame:
    """I3 for 90 and 30 days in one pass."""
    f = facts.orders_fact(["sku_code", "delivery_date", "delivered_amount", "total_discount"],
                          delivery=(end - dt.timedelta(days=89), end), distributor=town)
    late = F.col("delivery_date") >= F.lit(end - dt.timedelta(days=29))
    return f.groupBy("sku_code").agg(F.round(F.sum(_money()), 4).alias("sales_90"),
                                     F.round(F.sum(F.when(late, _money())), 4).alias("sales_30"))


def _sku_health_base(facts: Facts, town: str, end: dt.date) -> DataFrame:
    st = stock_by_sku(facts, town, latest_snapshot(facts, town, end))
    m = st.join(sales_two_windows(facts, town, end), "sku_code", "left").select(
        F.lit(town).alias("distributor_code"),
        "sku_code", F.col("stock_value").cast("double").alias("sv"),
        F.coalesce(F.col("sales_90").cast("double"), F.lit(0.0)).alias("s90"),
        F.coalesce(F.col("sales_30").cast("double"), F.lit(0.0)).alias("s30"))
    # Sales share of each SKU: the distributor's total is a partial aggregate
    # joined back on the distributor key (no window over all SKUs in one task).
    tot = m.groupBy("distributor_code").agg(F.sum("s90").alias("__t90"))
    m = m.join(F.broadcast(tot), "distributor_code")  # one row per distributor
    return m.withColumn("share", F.when(F.col("__t90") > 0, F.col("s90") / F.col("__t90"))
                        .otherwise(F.lit(0.0)))


def dead_stock(facts: Facts, town: str, end: dt.date) -> DataFrame:
    """I10 detail: SKUs with stock > 0, < 2 % of 90-day sales and cover > 25 days
    (no sales = infinite cover, reported as NULL), with SKU name."""
    m = _sku_health_base(facts, town, end)
    cover = F.when((F.col("sv") > 0) & (F.col("s90") > 0), F.col("sv") / (F.col("s90") / 90.0))
    dead = (F.col("sv") > 0) & (F.col("share") < DEAD_SHARE) & \
        (cover.isNull() | (cover > DEAD_COVER_DAYS))
    names = facts.orders_fact(["sku_code", "sku_name", "delivery_date"],
                              delivery=(end - dt.timedelta(days=89), end), distributor=town) \
        .where(F.col("sku_name").isNotNull() & (F.trim("sku_name") != "")) \
        .groupBy("sku_code").agg(F.trim(F.max("sku_name")).alias("sku_name"))
    d = m.where(dead).join(names, "sku_code", "left")
    return d.select(F.coalesce("sku_name", "sku_code").alias("sku_name"), "sku_code",
                    F.col("sv").alias("stock_value"), F.col("s90").alias("sales_90"),
                    F.round(F.col("share") * 100.0, 6).alias("sales_contribution_pct"),
                    F.round(cover, 4).alias("cover_days")) \
        .orderBy(F.desc("stock_value"), F.desc_nulls_first("cover_days"), "sku_code")


def inventory_health(facts: Facts, town: str, end: dt.date) -> DataFrame:
    """Turnover (sales90 / mean daily stock over 90 days), GMROII
    (sales30 / mean stock over 30 days), safety cover (stock / (sales30 / 30)),
    par level (Σ sales90 / 90 × 14), dead stock value / count, wastage %, and
    the replenishment cycle (mean gap between inflow days on un-filled snapshots)."""
    s90d, s30d = end - dt.timedelta(days=89), end - dt.timedelta(days=29)
    daily = _value_unit(_stock(facts, town, (s90d, end))).groupBy("report_date") \
        .agg(F.round(F.sum(F.coalesce("value", F.lit(0))), 4).cast("double").alias("sv"))
    w = W.partitionBy().orderBy("report_date")  # one row per snapshot day
    daily = daily.withColumn("inflow", F.greatest(
        F.col("sv") - F.coalesce(F.lag("sv").over(w), F.col("sv")), F.lit(0.0)))
    stock_stats = daily.agg(
        F.avg("sv").alias("avg90"), F.avg(F.when(F.col("report_date") >= F.lit(s30d), F.col("sv"))).alias("avg30"),
        F.min(F.when(F.col("inflow") > 0, F.col("report_date"))).alias("i0"),
        F.max(F.when(F.col("inflow") > 0, F.col("report_date"))).alias("i1"),
        F.count_distinct(F.when(F.col("inflow") > 0, F.col("report_date"))).alias("ni"))
    m = _sku_health_base(facts, town, end)
    cover = F.when((F.col("sv") > 0) & (F.col("s90") > 0), F.col("sv") / (F.col("s90") / 90.0))
    dead = (F.col("sv") > 0) & (F.col("share") < DEAD_SHARE) & (cover.isNull() | (cover > DEAD_COVER_DAYS))
    sku_stats = m.agg(F.sum("sv").alias("stock"), F.sum(F.when(dead, F.col("sv"))).alias("dead"),
                      F.count_distinct(F.when(dead, F.col("sku_code"))).alias("dead_n"),
                      F.sum("s90").alias("par_s90"))
    sales = facts.orders_fact(["delivery_date", "delivered_amount", "total_discount"],
                              delivery=(s90d, end), distributor=town).agg(
        F.round(F.sum(_money()), 4).cast("double").alias("sales_90"),
        F.round(F.sum(F.when(F.col("delivery_date") >= F.lit(s30d), _money()).otherwise(F.lit(0))), 4)
        .cast("double").alias("sales_30"))
    one = stock_stats.unionByName(sku_stats, allowMissingColumns=True) \
        .unionByName(sales, allowMissingColumns=True)
    cols = ["avg90", "avg30", "i0", "i1", "ni", "stock", "dead", "dead_n", "par_s90", "sales_90", "sales_30"]
    r = one.agg(*[F.max(c).alias(c) for c in cols])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return r.select(
        F.round(z("stock"), 4).alias("current_inventory_value"),
        F.round(z("par_s90") / 90.0 * PAR_COVER_DAYS, 4).alias("par_level_inventory_value"),
        F.when(z("avg90") > 0, F.round(z("sales_90") / F.col("avg90"), 4)).otherwise(F.lit(0.0))
         .alias("inventory_turnover"),
        F.round(z("dead"), 4).alias("dead_stock_value"),
        F.coalesce("dead_n", F.lit(0)).alias("dead_sku_count"),
        F.when(F.col("ni") >= 2, F.round(F.datediff("i1", "i0") / (F.col("ni") - 1), 4))
         .otherwise(F.lit(0.0)).alias("avg_replenishment_cycle"),
        F.when(z("stock") > 0, F.round(z("dead") / F.col("stock") * 100.0, 4)).otherwise(F.lit(0.0))
         .alias("wastage_rate"),
        F.when(z("avg30") > 0, F.round(z("sales_30") / F.col("avg30"), 4)).otherwise(F.lit(0.0))
         .alias("gmroii"),
        F.when(z("sales_30") > 0, F.round(z("stock") / (F.col("sales_30") / 30.0), 4))
         .otherwise(F.lit(0.0)).alias("safety_stock_coverage"))


def health_bands(i9: DataFrame) -> DataFrame:
    """Band per health metric (long form)."""
    def band(name):
        v = F.col(name)
        if name == "dead_stock_value":
            return F.when(v > 0, "bad").otherwise("good")
        if name == "wastage_rate":
            return F.when(v >= 2, "bad").when(v >= 1, "watch").otherwise("good")
        if name in ("inventory_turnover", "gmroii"):
            return F.when(v >= 3, "good").when(v >= 1.5, "watch").otherwise("low")
        if name in ("avg_replenishment_cycle", "safety_stock_coverage"):
            return F.when(v <= 5, "tight").when(v <= 10, "watch").otherwise("long")
        return F.lit("good")
    names = ["dead_stock_value", "wastage_rate", "inventory_turnover", "gmroii",
             "avg_replenishment_cycle", "safety_stock_coverage"]
    arr = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"),
                             band(n).alias("band")) for n in names])
    return i9.select(F.explode(arr).alias("m")).select("m.metric", "m.value", "m.band")
