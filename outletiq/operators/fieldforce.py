"""Booker, field-force and outlet builders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import exprs as X
from ..functions import periods as P
from ..functions.joins import small
from ..operators.targets import targets_for_window
from ..sources.dims import sku_by_code, universe_by_store
from ..sources.facts import Facts
from .staging import once

# Performance-score weights (F8) and segment/brand-focus limits.
SCORE_WEIGHTS = {"revenue": 0.35, "strike_rate": 0.25, "calls_per_day": 0.15,
                 "new_outlets": 0.15, "avg_order_val": 0.10}
SEGMENTS = ("Dormant (0 orders)", "Power Users (>4x/mo)", "Regular (2–4x/mo)",
            "Occasional (1x/mo)")
FOCUS_BANDS = (30, 15, 5)


def _scoped_orders(facts: Facts, cols, town, delivery=None, channels=None, bookers=None,
                   need_universe=False) -> DataFrame:
    """Order lines of one distributor with optional channel / booker IN-lists
    (FLT6); a channel list turns the universe left join into an inner one."""
    cols = list(dict.fromkeys(list(cols) + (["store_code"] if channels or need_universe else [])
                              + (["booker_name"] if bookers else [])))
    f = facts.orders_fact(cols, delivery=delivery, distributor=town)
    if channels or need_universe:
        f = f.join(small(universe_by_store(facts.universe())), "store_code", "left")
    if channels:
        f = f.where(F.col("channel_type").isin(*channels))
    if bookers:
        f = f.where(F.col("booker_name").isin(*bookers))
    return f


def visits(facts: Facts, window: tuple, town: str) -> DataFrame:
    """Visits of one distributor (code inside the brackets) in the window,
    with the booker name split from 'Name [CODE]'."""
    v = facts.visits_fact(visit_dates=window, distributor=town)
    return v.where((X.bracket_code("distributor") == town) & F.col("visit_date").isNotNull()) \
        .withColumn("booker", X.bracket_name("app_user"))


# ----------------------------------------------------------------- F1 / F2
def fieldforce(facts: Facts, window: tuple, town: str) -> DataFrame:
    """per booker × DM × channel: NMV, orders, stores, AOV, volume (0 digits)."""
    f = _scoped_orders(facts, ["booker_name", "dm_name", "invoice_number", "store_code",
                               "delivered_amount", "total_discount", "delivered_litres",
                               "delivered_kg"], town, delivery=window, need_universe=True)
    g = f.groupBy(F.col("booker_name").alias("booker"), F.col("dm_name").alias("deliveryman"),
                  X.channel_or_default("channel_type").alias("channel")).agg(
        F.sum(X.nmv()).alias("s"), F.count_distinct("invoice_number").alias("orders"),
        F.count_distinct("store_code").alias("stores"),
        F.sum(X.volume_additive()).alias("v"))
    return g.select("booker", "deliveryman", "channel", X.dbl(F.round("s", 0)).alias("nmv"),
                    "orders", "stores",
                    F.round(X.ratio("s", "orders"), 0).alias("aov"),
                    X.dbl(F.round("v", 0)).alias("volume")).orderBy(F.desc("nmv"), "booker")


def booker_rollup(f1: DataFrame) -> DataFrame:
    """F1 summed per booker (stores and orders are summed, so overlaps count twice)."""
    g = f1.groupBy("booker").agg(F.sum("nmv").alias("nmv"), F.sum("orders").alias("orders"),
                                 F.sum("stores").alias("stores"), F.sum("volume").alias("volume"))
    return g.select("*", F.round(X.ratio("nmv", "orders"), 2).alias("aov")) \
        .orderBy(F.desc("nmv"), "booker")


def top_bookers(f2: DataFrame, n: int = 12) -> DataFrame:
    """top ``n`` bookers by NMV with AOV."""
    return f2.select("booker", "nmv", "aov").orderBy(F.desc("nmv"), "booker").limit(n)


def dm_efficiency(f1: DataFrame) -> DataFrame:
    """per deliveryman: NMV, orders, stores, volume, AOV and NMV per store."""
    g = f1.groupBy("deliveryman").agg(F.sum("nmv").alias("nmv"), F.sum("orders").alias("orders"),
                                      F.sum("stores").alias("stores"),
                                      F.sum("volume").alias("volume"))
    return g.select("*", F.round(X.ratio("nmv", "orders"), 2).alias("aov"),
                    F.round(X.ratio("nmv", "stores"), 2).alias("nmv_per_store")) \
        .orderBy(F.desc("nmv"), "deliveryman")


# ----------------------------------------------------------------- F3–F6
def daily_calls(facts: Facts, window: tuple, town: str) -> DataFrame:
    """per visit date × booker: planned (rows), executed (complete 'Yes'),
    productive (complete and not non-productive)."""
    v = visits(facts, window, town)
    done = F.col("visit_complete") == "Yes"
    prod = done & (F.coalesce("non_productive", F.lit("No")) != "Yes")
    return v.groupBy(F.col("visit_date").alias("call_date"), "booker").agg(
        F.count(F.lit(1)).alias("planned_calls"),
        F.count_if(done).alias("executed_calls"),
        F.count_if(prod).alias("productive_calls")).orderBy("call_date", "booker")


def daily_calls_trend(f3: DataFrame, bookers: list[str] | None = None) -> DataFrame:
    """F3 summed per day over (selected) bookers."""
    if bookers:
        f3 = f3.where(F.col("booker").isin(*bookers))
    return f3.groupBy("call_date").agg(F.sum("planned_calls").alias("planned_calls"),
                                       F.sum("executed_calls").alias("executed_calls"),
                                       F.sum("productive_calls").alias("productive_calls")) \
        .orderBy("call_date")


def calls_kpi(facts: Facts, window: tuple, town: str) -> DataFrame:
    """strike rate (productive / planned), calls per day (planned / distinct
    days) for the window and the previous equal-length window, with deltas.
    Both windows come from one scan of the visits."""
    prev = P.previous_window(*window)
    v = visits(facts, (prev[0], window[1]), town)
    v = P.tag_periods(v, "visit_date", {"cur": window, "prev": prev})
    done = F.col("visit_complete") == "Yes"
    prod = done & (F.coalesce("non_productive", F.lit("No")) != "Yes")
    g = v.groupBy("period").agg(F.count(F.lit(1)).alias("planned"), F.count_if(done).alias("executed"),
                                F.count_if(prod).alias("productive"),
                                F.count_distinct("visit_date").alias("days"))
    m = g.select("period", "planned", "executed", "productive", "days",
                 F.when(F.col("planned") > 0, F.col("productive") / F.col("planned") * 100.0)
                  .otherwise(F.lit(0.0)).alias("strike"),
                 F.when(F.col("days") > 0, F.col("planned") / F.col("days"))
                  .otherwise(F.lit(0.0)).alias("cpd"))
    pick = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    r = m.agg(*[pick(p, c).alias(f"{p}_{c}") for p in ("cur", "prev")
                for c in ("planned", "executed", "productive", "days", "strike", "cpd")])
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return r.select(
        z("cur_planned").alias("planned_calls"), z("cur_executed").alias("executed_calls"),
        z("cur_productive").alias("productive_calls"), z("cur_days").alias("call_days"),
        F.round(z("cur_strike"), 2).alias("strike_rate"),
        F.round(z("cur_cpd"), 2).alias("calls_per_day"),
        F.round(z("prev_strike"), 2).alias("prev_strike_rate"),
        F.round(z("prev_cpd"), 2).alias("prev_calls_per_day"),
        F.round(z("cur_strike") - z("prev_strike"), 2).alias("strike_rate_delta"),
        F.round(z("cur_cpd") - z("prev_cpd"), 2).alias("calls_per_day_delta"))


def orders_placed(facts: Facts, window: tuple, town: str,
                  channels: list[str] | None = None) -> DataFrame:
    """distinct orders per order date × booker (by order date)."""
    f = facts.orders_fact(["order_date", "booker_name", "order_number", "store_code"],
                          order_dates=window, distributor=town)
    if channels:
        f = f.join(small(universe_by_store(facts.universe())), "store_code", "left") \
             .where(F.col("channel_type").isin(*channels))
    return f.groupBy("order_date", F.col("booker_name").alias("booker")).agg(
        F.count_distinct("order_number").alias("orders_placed")).orderBy("order_date", "booker")


def _booker_metrics(facts: Facts, window: tuple, town: str, channels: list[str] | None) -> DataFrame:
    """Order metrics of F7 from one read of the order lines.

    Each line becomes one row per metric it counts in: (tag, booker name or
    null, one or two values). A first aggregate over all of that makes the values distinct, a second one
    counts them by booker; what a booker has as a whole is spread to the rows
    of its names, which are a few."""
    cols = ["booker_code", "booker_name", "delivery_date", "invoice_number", "store_code",
            "sku_code", "delivered_amount", "total_discount"]
    hist = _scoped_orders(facts, cols, town, channels=channels, need_universe=True)
    text, none = lambda c: F.col(c).cast("string"), F.lit(None).cast("string")

    def row(tag: str, name, a, b=none):
        return F.struct(F.lit(tag).alias("tag"), name.alias("name"), a.alias("a"), b.alias("b"))

    first = F.array(row("first", none, text("store_code")))  # all history
    now = F.array(row("sale", text("booker_name"), text("invoice_number")),
                  row("outlet", text("booker_name"), text("store_code")),
                  row("bill", none, text("invoice_number")),
                  row("line", none, text("invoice_number"), text("sku_code")),
                  row("channel", none, X.channel_or_default("channel_type").cast("string")))
    tagged = hist.select("booker_code", "delivery_date", X.nmv().alias("nmv"), F.explode(
        F.when(P.between("delivery_date", window), F.concat(now, first)).otherwise(first)).alias("m"))
    one = tagged.groupBy("booker_code", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("nmv").alias("nmv"),
                                                 F.min("delivery_date").alias("first_date"))
    is_tag = lambda t: F.col("m.tag") == t
    has = lambda t: is_tag(t) & F.col("m.a").isNotNull()
    g = one.groupBy("booker_code", F.col("m.name").alias("booker_name")).agg(
        F.count_if(is_tag("sale")).alias("lines"),
        F.round(F.sum(F.when(is_tag("sale"), F.col("nmv"))), 0).alias("revenue"),
        F.count_if(has("sale")).alias("orders"), F.count_if(has("outlet")).alias("active_outlets"),
        F.count_if(has("bill")).alias("bills"), F.count_if(has("line") & F.col("m.b").isNotNull()).alias("skus"),
        F.count_if(has("first") & P.between("first_date", window)).alias("new_outlets"),
        F.min_by(F.when(is_tag("channel"), F.col("m.a")),
                 F.when(is_tag("channel"), F.struct((-F.col("n")).alias("n"), F.col("m.a").alias("a")))).alias("region"))
    of_booker = W.partitionBy("booker_code")
    known = F.col("booker_code").isNotNull()
    whole = {c: F.when(known, F.max(c).over(of_booker)) for c in ("bills", "skus", "new_outlets", "region")}
    return g.select("booker_code", "booker_name", "lines", "revenue", "orders", "active_outlets",
                    *[v.alias(c) for c, v in whole.items()]).where("lines > 0")


# ----------------------------------------------------------------- F7–F12
def leaderboard(facts: Facts, window: tuple, town: str,
                channels: list[str] | None = None) -> DataFrame:
    """per booker: revenue, orders, active outlets, main channel (most
    lines; ties by name), calls, new outlets (first-ever delivery inside the
    window), SKU per bill and target of the months touched."""
    sales = _booker_metrics(facts, window, town, channels).withColumn(
        "sku_per_bill", F.round(F.try_divide(F.col("skus").cast("double"), F.col("bills").cast("double")), 2))
    v = visits(facts, window, town)
    calls = v.groupBy("booker").agg(
        F.count(F.lit(1)).alias("planned_calls"),
        F.count_if(F.col("visit_complete") == "Yes").alias("executed_calls"),
        F.count_distinct("visit_date").alias("call_days"))
    tgt = targets_for_window(facts, town, window).groupBy("booker_code") \
        .agg(F.round(F.sum(F.coalesce("target", F.lit(0))), 0).alias("target_value"))
    j = (sales.join(calls, sales.booker_name == calls.booker, "left")
              .join(tgt, "booker_code", "left"))
    tv = F.coalesce("target_value", F.lit(0))
    return j.select(
        F.col("booker_name").alias("booker"), "booker_code",
        F.coalesce("region", F.lit("Unknown")).alias("region"),
        X.dbl(tv).alias("target_value"), X.dbl("revenue").alias("revenue"), "orders",
        "active_outlets", F.round(X.ratio("revenue", "orders"), 0).alias("avg_order_val"),
        F.coalesce("sku_per_bill", F.lit(0.0)).alias("sku_per_bill"),
        F.when(tv > 0, F.round(X.ratio("revenue", tv) * 100.0, 1)).otherwise(F.lit(0.0))
         .alias("achievement_pct"),
        F.coalesce("planned_calls", F.lit(0)).alias("planned_calls"),
        F.coalesce("executed_calls", F.lit(0)).alias("executed_calls"),
        F.coalesce("call_days", F.lit(0)).alias("call_days"),
        F.coalesce("new_outlets", F.lit(0)).alias("new_outlets")) \
        .orderBy(F.desc("revenue"), "booker")


def performance_score(f7: DataFrame, bookers: list[str] | None = None) -> DataFrame:
    """F8: min–max scaled revenue .35, strike .25, calls/day .15, new outlets .15,
    AOV .10, × 100; a constant metric scales to 0.5. Scaling runs after the
    booker filter, over the aggregated booker rows only."""
    if bookers:
        f7 = f7.where(F.col("booker").isin(*bookers))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    f7 = once(f7)  # the rows and their limits are read from one written table, a row per booker
    b = f7.select(
        "booker", "booker_code",
        z("revenue").alias("revenue"),
        F.when(z("planned_calls") > 0, z("executed_calls") / z("planned_calls") * 100.0)
         .otherwise(F.lit(0.0)).alias("strike_rate"),
        F.when(z("call_days") > 0, z("planned_calls") / z("call_days"))
         .otherwise(F.lit(0.0)).alias("calls_per_day"),
        z("new_outlets").alias("new_outlets"), z("avg_order_val").alias("avg_order_val"))
    # One row with both limits of every metric, as a scalar: no window over all bookers.
    ends = [f(m).alias(f"{side}_{m}") for m in SCORE_WEIGHTS for side, f in (("lo", F.min), ("hi", F.max))]
    b = b.withColumn("ends", b.agg(F.struct(*ends)).scalar())
    score = F.lit(0.0)
    for m, wgt in SCORE_WEIGHTS.items():
        lo, hi = F.col("ends")[f"lo_{m}"], F.col("ends")[f"hi_{m}"]
        score = score + F.when(hi > lo, (F.col(m) - lo) / (hi - lo)).otherwise(F.lit(0.5)) * wgt
    return b.select("*", F.round(score * 100.0, 4).alias("perf_score")) \
        .select("booker", "booker_code", F.round("strike_rate", 4).alias("strike_rate"),
                F.round("calls_per_day", 4).alias("calls_per_day"), "revenue", "new_outlets",
                "avg_order_val", "perf_score") \
        .orderBy(F.desc("perf_score"), "booker")


def top_bottom(f8: DataFrame, n: int = 5) -> DataFrame:
    """top ``n`` and bottom ``n`` bookers by score (ties by name)."""
    f8 = once(f8)
    def end(side: str, order) -> DataFrame:
        best = f8.select("booker", "perf_score").orderBy(*order).limit(n)
        rank = F.row_number().over(W.partitionBy(F.lit(side)).orderBy(*order))  # at most n rows
        return best.select(F.lit(side).alias("side"), "booker", "perf_score", rank.alias("rank"))

    return end("top", (F.desc("perf_score"), "booker")).unionByName(
        end("bottom", (F.asc("perf_score"), "booker"))).orderBy("side", "rank")


def under_performers(f7: DataFrame, limit_pct: float = 70) -> DataFrame:
    """bookers below ``limit_pct`` achievement, lowest first."""
    return f7.where(F.col("achievement_pct") < limit_pct) \
        .select("booker", "target_value", "revenue", "achievement_pct") \
        .orderBy("achievement_pct", "booker")


def _calls_per_booker(facts: Facts, window: tuple, town: str) -> DataFrame:
    f3 = daily_calls(facts, window, town)
    return f3.groupBy("booker").agg(F.sum("planned_calls").alias("planned"),
                                    F.sum("executed_calls").alias("executed"),
                                    F.sum("productive_calls").alias("productive"))


def booker_snapshot(facts: Facts, window: tuple, town: str) -> DataFrame:
    """leaderboard ⟗ calls per booker (full outer); call values from the
    visits side are preferred; strike rate recomputed (executed / planned)."""
    f7 = leaderboard(facts, window, town)
    c = _calls_per_booker(facts, window, town)
    j = f7.join(c, "booker", "full")
    planned = F.coalesce("planned", "planned_calls", F.lit(0))
    executed = F.coalesce("executed", "executed_calls", F.lit(0))
    return j.select("booker", F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
                    F.coalesce("orders", F.lit(0)).alias("orders"),
                    planned.alias("planned_calls"), executed.alias("executed_calls"),
                    F.coalesce("productive", F.lit(0)).alias("productive_calls"),
                    F.when(planned > 0, F.round(executed / planned * 100.0, 1))
                     .otherwise(F.lit(0.0)).alias("strike_rate")).orderBy(F.desc("revenue"), "booker")


def funnel(facts: Facts, window: tuple, town: str) -> DataFrame:
    """per booker: scheduled → executed → productive → placed (orders by
    order date) → delivered (invoices by delivery date); each step as % of the
    previous one (0 when the previous is 0)."""
    c = _calls_per_booker(facts, window, town)
    placed = orders_placed(facts, window, town).groupBy("booker") \
        .agg(F.sum("orders_placed").alias("placed"))
    dl = facts.orders_fact(["booker_name", "invoice_number"], delivery=window, distributor=town) \
        .groupBy(F.col("booker_name").alias("booker")) \
        .agg(F.count_distinct("invoice_number").alias("delivered"))
    j = c.join(placed, "booker", "full").join(dl, "booker", "full")
    z = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long")
    steps = ["planned", "executed", "productive", "placed", "delivered"]
    out = j.select("booker", *[z(s).alias(s) for s in steps])
    pct = [F.when(F.col(a) > 0, F.round(F.col(b) / F.col(a) * 100.0, 1)).otherwise(F.lit(0.0))
           .alias(f"{b}_pct") for a, b in zip(steps, steps[1:])]
    return out.select("*", *pct).orderBy("booker")


def funnel_overall(f12: DataFrame) -> DataFrame:
    """F12, all bookers: one row per stage with its total and its % of the stage
    before (NULL for the first, 0 after an empty stage)."""
    steps = ["planned", "executed", "productive", "placed"]
    t = f12.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in steps])
    stages = [F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("value"),
                       (F.lit(None).cast("double") if i == 0 else
                        F.when(F.col(steps[i - 1]) > 0, F.round(F.col(s) / F.col(steps[i - 1]) * 100.0, 4))
                        .otherwise(F.lit(0.0))).alias("pct")) for i, s in enumerate(steps)]
    return t.select(F.explode(F.array(*stages)).alias("x")).select("x.*").orderBy("step")


# ----------------------------------------------------------------- F13–F19
def store_activity(facts: Facts, window: tuple, town: str, channels=None,
                   bookers=None) -> DataFrame:
    """every active scoped store of the distributor (all history) with its
    distinct orders in the window (0 if none)."""
    hist = _scoped_orders(facts, ["store_code", "delivery_date", "invoice_number"], town,
                          channels=channels, bookers=bookers, need_universe=True)
    scoped = hist.where(F.col("status") == "Active").select("store_code").distinct()
    per = hist.where(P.between("delivery_date", window)).groupBy("store_code") \
        .agg(F.count_distinct("invoice_number").alias("orders_in_period"))
    return scoped.join(per, "store_code", "left").select(
        "store_code", F.coalesce("orders_in_period", F.lit(0)).alias("orders_in_period"))


def booker_store_activity(facts: Facts, window: tuple, town: str, channels=None,
                          bookers=None) -> DataFrame:
    """F13 per booker × store, with store name and last order date (all history)."""
    hist = _scoped_orders(facts, ["booker_name", "store_code", "store_name", "delivery_date",
                                  "invoice_number"], town, channels=channels, bookers=bookers,
                          need_universe=True)
    pairs = hist.where(F.col("status") == "Active").groupBy("booker_name", "store_code").agg(
        F.max("store_name").alias("store_name"), F.max("delivery_date").alias("last_order_date"))
    per = hist.where(P.between("delivery_date", window)).groupBy("booker_name", "store_code") \
        .agg(F.count_distinct("invoice_number").alias("orders_in_period"))
    return pairs.join(per, ["booker_name", "store_code"], "left").select(
        F.col("booker_name").alias("booker"), "store_code", "store_name", "last_order_date",
        F.coalesce("orders_in_period", F.lit(0)).alias("orders_in_period"))


def months_in_range(window: tuple) -> int:
    s, e = window
    return max((e.year - s.year) * 12 + (e.month - s.month) + 1, 1)


def segment(activity: DataFrame, window: tuple) -> DataFrame:
    """orders ÷ months touched; 0 → Dormant, > 4 → Power, ≥ 2 → Regular,
    otherwise Occasional (also below 1)."""
    n = months_in_range(window)
    avg = F.col("orders_in_period") / F.lit(float(n))
    lab = (F.when(F.col("orders_in_period") <= 0, SEGMENTS[0]).when(avg > 4, SEGMENTS[1])
           .when(avg >= 2, SEGMENTS[2]).otherwise(SEGMENTS[3]))
    return activity.select("*", F.round(avg, 4).alias("avg_orders_per_month"),
                           lab.alias("segment_label"))


def segment_summary(seg: DataFrame) -> DataFrame:
    """F15 summary: distinct outlets per segment."""
    return seg.groupBy("segment_label").agg(F.count_distinct("store_code").alias("outlet_count")) \
        .orderBy("segment_label")


def booker_segment_matrix(seg14: DataFrame, top: int = 15) -> DataFrame:
    """F16: booker × segment outlet counts (long form) for the top ``top``
    bookers by outlets."""
    g = seg14.groupBy("booker", "segment_label").agg(F.count_distinct("store_code").alias("outlets"))
    tot = g.groupBy("booker").agg(F.sum("outlets").alias("total"))
    best = tot.orderBy(F.desc("total"), "booker").limit(top)
    return g.join(best, "booker", "left_semi").orderBy("booker", "segment_label")


def booker_outlets(f14: DataFrame, booker: str) -> DataFrame:
    """outlets of one booker, orders descending, name ascending."""
    return f14.where(F.col("booker") == booker).orderBy(F.desc("orders_in_period"), "store_name")


def segmentation_table(seg14: DataFrame, bookers=None, segments=None) -> DataFrame:
    """the booker × store segmentation rows filtered for export."""
    if bookers:
        seg14 = seg14.where(F.col("booker").isin(*bookers))
    if segments:
        seg14 = seg14.where(F.col("segment_label").isin(*segments))
    return seg14.orderBy("booker", F.desc("orders_in_period"), "store_code")


def cohort_orders(facts: Facts, window: tuple, town: str, channels=None, bookers=None) -> DataFrame:
    """distinct store × delivery day in the window."""
    f = _scoped_orders(facts, ["store_code", "delivery_date"], town, delivery=window,
                       channels=channels, bookers=bookers)
    return f.select("store_code", F.col("delivery_date").alias("order_date")).distinct()


def tue_week(col) -> F.Column:
    """Start (Tuesday) of the Tuesday–Monday week holding ``col``."""
    return F.date_add(F.to_date(F.date_trunc("week", F.date_sub(col, 1))), 1)


def weekly_retention(f18: DataFrame) -> DataFrame:
    """cohort = each store's first Tuesday–Monday week in the window;
    retention % of week-0 outlets per cohort week × week number (long form)."""
    w = f18.select("store_code", tue_week(F.col("order_date")).alias("order_week"))
    first = w.groupBy("store_code").agg(F.min("order_week").alias("cohort_week"))
    j = w.join(first, "store_code")
    j = j.withColumn("week_number", (F.datediff("order_week", "cohort_week") / 7).cast("int"))
    counts = j.groupBy("cohort_week", "week_number").agg(
        F.count_distinct("store_code").alias("outlets"))
    size = counts.where(F.col("week_number") == 0).select(
        "cohort_week", F.col("outlets").alias("cohort_size"))
    c = counts.join(size, "cohort_week", "left")
    return c.select("cohort_week", "week_number", "outlets",
                    F.when(F.coalesce("cohort_size", F.lit(0)) > 0,
                           F.round(F.col("outlets") / F.col("cohort_size") * 100.0, 4))
                     .otherwise(F.lit(0.0)).alias("retention_pct")) \
        .orderBy("cohort_week", "week_number")


# ----------------------------------------------------------------- F20–F25
def sku_per_bill(facts: Facts, window: tuple, town: str, channels=None, bookers=None) -> DataFrame:
    """distinct (invoice, SKU) / distinct invoices for the window and the
    previous equal-length window, one scan, with the delta."""
    prev = P.previous_window(*window)
    f = _scoped_orders(facts, ["delivery_date", "invoice_number", "sku_code"], town,
                       delivery=(prev[0], window[1]), channels=channels, bookers=bookers)
    f = P.tag_periods(f, "delivery_date", {"cur": window, "prev": prev})
    g = f.groupBy("period").agg(F.count_distinct("invoice_number").alias("orders"),
                                F.count_distinct("invoice_number", "sku_code").alias("pairs"))
    pick = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    r = g.agg(pick("cur", "orders").alias("o"), pick("cur", "pairs").alias("p"),
              pick("prev", "orders").alias("po"), pick("prev", "pairs").alias("pp"))
    spb = F.round(X.ratio("p", "o"), 2)
    pspb = F.round(X.ratio("pp", "po"), 2)
    return r.select(F.coalesce("o", F.lit(0)).alias("total_orders"),
                    F.coalesce("p", F.lit(0)).alias("invoice_sku_count"),
                    spb.alias("sku_per_bill"), pspb.alias("prev_sku_per_bill"),
                    F.round(spb - pspb, 2).alias("delta"))


def sku_per_bill_vs_mean(f7: DataFrame) -> DataFrame:
    """SKU per bill per booker against the plain mean over bookers."""
    f7 = once(f7)
    mean = f7.agg(F.avg("sku_per_bill")).scalar()
    return f7.select("booker", "sku_per_bill", F.round(mean, 4).alias("mean_sku_per_bill"),
                     F.round(F.col("sku_per_bill") - mean, 4).alias("diff")).orderBy("booker")


def booker_brand_scoring(facts: Facts, window: tuple, town: str, channels=None,
                         bookers=None) -> DataFrame:
    """NMV (guarded) and orders per booker × brand; SKU master deduped by
    trimmed code with MAX non-blank brand; total > 0."""
    f = facts.orders_fact(["booker_name", "sku_code", "store_code", "invoice_number",
                           "delivered_amount", "total_discount"], delivery=window, distributor=town)
    sb = facts.sku_master().groupBy(F.trim("sku_code").alias("sk")).agg(
        F.max(F.nullif(F.trim("brand"), F.lit(""))).alias("brand"))
    f = f.join(small(sb), F.trim(f.sku_code) == sb.sk, "left")
    if channels:
        u = universe_by_store(facts.universe()).select(F.trim("store_code").alias("su"), "channel_type")
        f = f.join(small(u), F.trim(f.store_code) == u.su, "left") \
             .where(F.col("channel_type").isin(*channels))
    if bookers:
        f = f.where(F.col("booker_name").isin(*bookers))
    g = f.groupBy(F.trim("booker_name").alias("booker"), X.blank_to("brand").alias("brand")).agg(
        F.sum(X.nmv(guarded=True)).alias("s"), F.count_distinct("invoice_number").alias("orders"))
    return g.where(F.col("s") > 0).select("booker", "brand", X.dbl(F.round("s", 0)).alias("nmv"),
                                           "orders").orderBy("booker", F.desc("nmv"), "brand")


def brand_scores(f22: DataFrame) -> DataFrame:
    """brand share of booker NMV (1 digit, half-even) plus the booker's
    best and weakest brand (ties by brand name)."""
    tot = F.sum("nmv").over(W.partitionBy("booker"))
    s = f22.select("booker", "brand", "nmv", tot.alias("booker_total"))
    s = s.withColumn("brand_score", F.when(F.col("booker_total") > 0,
                                           F.bround(F.col("nmv") / F.col("booker_total") * 100.0, 1))
                     .otherwise(F.lit(0.0)))
    s = s.withColumn("rank_desc", F.row_number().over(
        W.partitionBy("booker").orderBy(F.desc("nmv"), "brand")))
    s = s.withColumn("rank_asc", F.row_number().over(
        W.partitionBy("booker").orderBy(F.asc("nmv"), "brand")))
    top = s.where("rank_desc = 1").select("booker", F.col("brand").alias("top_brand"),
                                           F.col("nmv").alias("top_brand_nmv"),
                                           F.col("brand_score").alias("top_brand_score"))
    bot = s.where("rank_asc = 1").select("booker", F.col("brand").alias("bottom_brand"),
                                          F.col("nmv").alias("bottom_brand_nmv"),
                                          F.col("brand_score").alias("bottom_brand_score"))
    return top.join(bot, "booker", "full").orderBy("booker")


def brand_focus(f22: DataFrame) -> DataFrame:
    """brand % of booker NMV with bands ≥ 30 / ≥ 15 / ≥ 5 / below."""
    tot = F.sum("nmv").over(W.partitionBy("booker"))
    pct = F.when(tot > 0, F.col("nmv") / tot * 100.0).otherwise(F.lit(0.0))
    hi, mid, lo = FOCUS_BANDS
    band = (F.when(pct >= hi, "strong").when(pct >= mid, "good").when(pct >= lo, "weak")
            .otherwise("minimal"))
    return f22.select("booker", "brand", "nmv", F.round(pct, 4).alias("pct"), band.alias("band")) \
        .orderBy("booker", F.desc("nmv"), "brand")


def top_brands(f22: DataFrame, n: int = 8) -> DataFrame:
    """top ``n`` brands overall by NMV."""
    return f22.groupBy("brand").agg(F.sum("nmv").alias("nmv")) \
        .orderBy(F.desc("nmv"), "brand").limit(n)


# ----------------------------------------------------------------- F28–F30
def visit_frequency(facts: Facts, town: str, as_of: dt.date, months: int = 6) -> DataFrame:
    """visits, completed and non-productive visits per month × booker over
    the last ``months`` months (the reference built this SQL but never ran it)."""
    v = visits(facts, (P.add_months(as_of, -months), as_of), town)
    return v.groupBy(X.month_key("visit_date").alias("visit_month"),
                     F.col("booker").alias("ob_name")).agg(
        F.count(F.lit(1)).alias("total_visits"),
        F.count_if(F.col("visit_complete") == "Yes").alias("completed_visits"),
        F.count_if(F.col("non_productive") == "Yes").alias("non_productive_visits")) \
        .orderBy(F.desc("visit_month"), "ob_name")


def half_carton(facts: Facts, town: str, as_of: dt.date, months_back: int = 3,
                towns: dict | None = None) -> DataFrame:
    """deliveries under half a carton per booker × store × brand over the
    last ``months_back`` months (units > 0).

    ``seq_deliveries`` is the reference's MAX(ROW_NUMBER) over store × brand by
    delivery date: the position of the booker's last delivery in the store's
    sequence, ties on a day counted in full. It is computed from per-day counts
    (a running sum over at most one row per day and store × brand), so no
    store × brand group is ever gathered row by row. ``deliveries`` is the
    booker's own count (Q14).
    """
    f = facts.orders_fact(["store_code", "store_name", "booker_code", "booker_name", "sku_code",
                           "delivered_units", "delivery_date", "distributor_code"],
                          delivery=(P.add_months(as_of, -months_back), as_of), distributor=town)
    f = f.where(F.col("delivered_units") > 0)
    f = f.join(small(sku_by_code(facts.sku_master()).select("sku_code", "brand", "uom")),
               "sku_code", "left")
    ctn = F.try_divide(F.col("delivered_units").cast("double"), F.col("uom").cast("double"))
    f = f.withColumn("half", F.when(ctn < 0.5, 1).otherwise(0))
    per_day = f.groupBy("store_code", "brand", "delivery_date").agg(F.count(F.lit(1)).alias("n"))
    run = per_day.withColumn("upto", F.sum("n").over(
        W.partitionBy("store_code", "brand").orderBy("delivery_date")
         .rowsBetween(W.unboundedPreceding, W.currentRow)))
    per_b = f.groupBy("brand", "store_code", "booker_code", "booker_name").agg(
        F.max("store_name").alias("store_name"), F.max("delivery_date").alias("last_day"),
        F.count(F.lit(1)).alias("deliveries"), F.sum("half").alias("half_ctn_del"),
        F.max("distributor_code").alias("distributor_code"))
    j = per_b.join(run, [per_b.store_code.eqNullSafe(run.store_code),
                         per_b.brand.eqNullSafe(run.brand),
                         per_b.last_day == run.delivery_date], "left") \
        .drop(run.store_code).drop(run.brand)
    return j.select("brand", "store_code", "store_name", "booker_code", "booker_name",
                    F.col("upto").alias("seq_deliveries"), "deliveries", "half_ctn_del",
                    X.town_label("distributor_code", towns).alias("town"))


def half_carton_by_booker(f29: DataFrame) -> DataFrame:
    """F29 summary: per booker × brand: Σ seq deliveries, Σ half-carton
    deliveries and their ratio; only pairs with a half-carton delivery."""
    g = f29.groupBy("booker_name", "brand").agg(F.sum("seq_deliveries").alias("t_del"),
                                                F.sum("half_ctn_del").alias("t_h_c_del"))
    return g.where(F.col("t_h_c_del") > 0).select(
        "booker_name", "brand", "t_del", "t_h_c_del",
        F.round(X.ratio("t_h_c_del", "t_del"), 4).alias("ratio")) \
        .orderBy("booker_name", "brand")


def half_carton_matrix(f29: DataFrame) -> DataFrame:
    """booker × brand unweighted mean of store ratios (long form)."""
    s = f29.where(F.col("half_ctn_del") > 0).select(
        "booker_name", "brand", X.ratio("half_ctn_del", "seq_deliveries").alias("r"))
    return s.groupBy("booker_name", "brand").agg(F.round(F.avg("r"), 4).alias("mean_ratio")) \
        .orderBy("booker_name", "brand")


def half_carton_drilldown(f29: DataFrame, booker: str | None = None, brand: str | None = None) -> DataFrame:
    """F30 drill-down: the stores behind a booker's (and brand's) cell, worst
    ratio first, the ratio in %."""
    d = f29.where(F.col("half_ctn_del") > 0)
    if booker is not None:
        d = d.where(F.col("booker_name") == booker)
    if brand is not None:
        d = d.where(F.col("brand") == brand)
    age = X.ratio("half_ctn_del", "seq_deliveries")
    return d.select("booker_name", "brand", "store_code", "store_name",
                    F.col("seq_deliveries").alias("total_deliveries"), "half_ctn_del",
                    F.round(age * 100.0, 2).alias("age_pct")) \
        .orderBy(F.desc("age_pct"), F.desc("half_ctn_del"), "booker_name", "brand", "store_code")
