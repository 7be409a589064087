"""Per-visit brand coverage.

The contract is long form: one row per (visit, brand sold). Flag columns for a
chosen brand set are pivoted last with explicit values, so every output has a
fixed schema whatever brands the data holds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.joins import small
from ..sources.facts import Facts
from .staging import once

# Brand classification rules of the order lines (PRJ11), in order.
TBA_SLUG = ".Olper TBA"
TBA_SLUG_PATTERN = ".olper tba"
TBA_CLASS = "Olpers TBA"
TARANG_PATTERN = "tarang"
TARANG_CLASS = "Tarang"
MILK_BRAND = "olpers milk"
MILK_CLASS = "Olpers Milk"
OTHER_CLASS = "Other"
SEP = "||"


def brand_col(brand: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", brand.lower()).strip("_")


def classified_skus(facts: Facts) -> DataFrame:
    """PRJ11 per trimmed SKU code: TBA slug → slug like '.olper tba' → brand or
    slug like 'tarang' → brand 'olpers milk' → own brand → 'Other'."""
    m = facts.sku_master()
    slug = F.lower(F.trim(F.coalesce("slug", F.lit(""))))
    brand = F.lower(F.trim(F.coalesce("brand", F.lit(""))))
    cls = (F.when(F.col("slug") == TBA_SLUG, TBA_CLASS)
           .when(slug.contains(TBA_SLUG_PATTERN), TBA_CLASS)
           .when(brand.contains(TARANG_PATTERN) | slug.contains(TARANG_PATTERN), TARANG_CLASS)
           .when(brand == MILK_BRAND, MILK_CLASS)
           .otherwise(X.blank_to("brand", OTHER_CLASS)))
    return m.groupBy(F.trim("sku_code").alias("sku_code")).agg(F.max(cls).alias("brand_classified"))


def coverage_visits(facts: Facts, window: tuple, town: str) -> DataFrame:
    """Visits of one distributor with names split and the document key
    (order number, else invoice number; NULL when both are blank)."""
    v = facts.visits_fact(visit_dates=window, distributor=town)
    v = v.where(X.bracket_code("distributor") == town)
    doc = F.trim(X.document_key())
    return v.select(
        "visit_date", F.trim("store_code").alias("store_code"), "store_name",
        X.bracket_name("app_user").alias("booker_name"), doc.alias("doc_no"),
        F.lower(F.trim(F.coalesce("visit_complete", F.lit("")))).alias("visit_complete"),
        F.lower(F.trim(F.coalesce("non_productive", F.lit("")))).alias("non_productive"))


def coverage_sales(facts: Facts, window: tuple, town: str) -> DataFrame:
    """Order lines (by order date, units > 0) with their brand class; NMV =
    order amount + discount (NULL as 0)."""
    f = facts.orders_fact(["store_code", "booker_name", "order_date", "order_number",
                           "invoice_number", "sku_code", "order_units", "order_amount",
                           "total_discount"], order_dates=window, distributor=town)
    f = f.where(F.coalesce("order_units", F.lit(0)) > 0)
    cls = classified_skus(facts)
    f = f.join(small(cls), F.trim(f.sku_code) == cls.sku_code, "left").drop(cls.sku_code)
    return f.select(F.trim("store_code").alias("store_code"), F.trim("booker_name").alias("booker_name"),
                    F.col("order_date").alias("visit_date"), F.trim(X.document_key()).alias("doc_no"),
                    F.coalesce("brand_classified", F.lit(OTHER_CLASS)).alias("brand"),
                    (F.coalesce("order_amount", F.lit(0)) + F.coalesce("total_discount", F.lit(0)))
                    .alias("nmv"))


def _visit_id():
    base = F.concat_ws(SEP, "store_code", "booker_name", F.date_format("visit_date", "yyyy-MM-dd"))
    return F.when(F.col("doc_no").isNotNull(), F.concat_ws(SEP, base, "doc_no")).otherwise(base)


def visit_brand_long(facts: Facts, window: tuple, town: str) -> tuple[DataFrame, DataFrame]:
    """C3 core: (visits, visit × brand sales).

    Visits with a document link to sales of the same store and document; visits
    without one link to sales of the same store, booker and day (Q4 fixed: a
    NULL document uses the day route). Returns one row per visit and one row
    per (visit, brand) with that brand's NMV.
    """
    vr = coverage_visits(facts, window, town).withColumn("visit_id", _visit_id())
    visits = once(vr.groupBy("visit_id", "visit_date", "store_code", "booker_name", "doc_no").agg(
        F.max("store_name").alias("store_name"), F.max("visit_complete").alias("visit_complete"),
        F.max("non_productive").alias("non_productive")), "visits")
    text, none = lambda c: F.col(c).cast("string"), F.lit(None).cast("string")
    # JN12: one link key, either (store, document) or (store, booker, day); a key with a gap links nothing
    by_doc = F.struct(text("store_code").alias("store"), none.alias("booker"), none.alias("day"), text("doc_no").alias("doc"))
    by_day = F.struct(text("store_code").alias("store"), text("booker_name").alias("booker"),
                      text("visit_date").alias("day"), none.alias("doc"))
    has_doc = F.col("doc_no").isNotNull() & F.col("store_code").isNotNull()
    has_day = F.col("booker_name").isNotNull() & F.col("visit_date").isNotNull() & F.col("store_code").isNotNull()
    sales = coverage_sales(facts, window, town).groupBy("store_code", "booker_name", "visit_date", "doc_no", "brand") \
        .agg(F.sum("nmv").alias("nmv"))
    keys = F.array_compact(F.array(F.when(has_doc, by_doc), F.when(has_day, by_day)))
    sold = sales.select(F.explode(keys).alias("link"), "brand", "nmv").groupBy("link", "brand").agg(F.sum("nmv").alias("nmv"))
    link = F.when(F.col("doc_no").isNotNull(), F.when(has_doc, by_doc)).otherwise(F.when(has_day, by_day))
    links = visits.select("visit_id", link.alias("link")).where("link is not null").distinct()
    long = links.join(sold, "link").groupBy("visit_id", "brand").agg(F.sum("nmv").alias("nmv"))
    return visits.drop("doc_no"), long


def visit_coverage(facts: Facts, window: tuple, town: str, brands) -> DataFrame:
    """One row per visit: sold_<brand> flag per chosen brand (fixed columns),
    sold_other (any other brand), total NMV, brands sold, all-brands flag and
    coverage score (1 digit)."""
    visits, long = visit_brand_long(facts, window, town)
    return _score(visits, long, brands)


def _score(visits: DataFrame, long: DataFrame, brands) -> DataFrame:
    brands = list(brands)
    flags = long.groupBy("visit_id").agg(
        F.sum("nmv").alias("total_nmv"),
        *[F.max(F.col("brand") == b).alias(f"sold_{brand_col(b)}") for b in brands],
        F.max(~F.col("brand").isin(*brands)).alias("sold_other"))
    v = visits.join(flags, "visit_id", "left")
    sold = [F.coalesce(F.col(f"sold_{brand_col(b)}"), F.lit(False)) for b in brands]
    count = sum((s.cast("int") for s in sold), F.lit(0))
    return v.select("visit_id", "visit_date", "store_code", "store_name", "booker_name",
                    "visit_complete", "non_productive",
                    X.dbl(F.coalesce("total_nmv", F.lit(0))).alias("total_nmv"),
                    *[s.alias(f"sold_{brand_col(b)}") for s, b in zip(sold, brands)],
                    F.coalesce("sold_other", F.lit(False)).alias("sold_other"),
                    count.alias("brands_sold_count"), (count == len(brands)).alias("all_brands"),
                    F.round(count / F.lit(float(len(brands))) * 100.0, 1).alias("coverage_score"))


def brand_universe(facts: Facts, window: tuple, town: str, brands) -> DataFrame:
    """ST4: the fixed brands and all brands found in the window's sales, sorted."""
    found = coverage_sales(facts, window, town).select(F.trim("brand").alias("brand")).where(F.col("brand") != "")
    fixed = facts.spark.createDataFrame([(b,) for b in brands], "brand string")
    return fixed.union(found).distinct().orderBy("brand")


def rescore(facts: Facts, window: tuple, town: str, brands) -> DataFrame:
    """C4: the visit table recomputed for another brand set (from the long table)."""
    return visit_coverage(facts, window, town, brands)


def coverage_levels(c3: DataFrame, n_brands: int) -> DataFrame:
    """Visits with k of n brands, k = n … 0."""
    g = c3.groupBy("brands_sold_count").agg(F.count(F.lit(1)).alias("visits"))
    return g.select("brands_sold_count", "visits",
                    F.when(F.col("brands_sold_count") == n_brands, F.lit(f"All {n_brands} Brands"))
                     .when(F.col("brands_sold_count") == 0, F.lit("0 Brands"))
                     .when(F.col("brands_sold_count") == 1, F.lit("1 Brand"))
                     .otherwise(F.concat(F.col("brands_sold_count").cast("string"), F.lit(" Brands")))
                     .alias("label")).orderBy(F.desc("brands_sold_count"))


def _brand_rows(c3: DataFrame, brands) -> DataFrame:
    """Visit × chosen brand rows with the sold flag (explode of a fixed array)."""
    arr = F.array(*[F.struct(F.lit(b).alias("brand"), F.col(f"sold_{brand_col(b)}").alias("sold"))
                    for b in brands])
    return c3.select("*", F.explode(arr).alias("__b")).select("*", "__b.brand", "__b.sold").drop("__b")


def sell_rate(c3: DataFrame, brands) -> DataFrame:
    """% of a booker's visits where each brand was sold (1 digit)."""
    r = _brand_rows(c3, brands)
    return r.groupBy("booker_name", "brand").agg(
        F.count(F.lit(1)).alias("visits"), F.count_if("sold").alias("sold_visits")) \
        .select("booker_name", "brand", "visits", "sold_visits",
                F.round(F.col("sold_visits") / F.col("visits") * 100.0, 1).alias("sell_rate")) \
        .orderBy("booker_name", "brand")


def daily_coverage(c3: DataFrame, brands) -> DataFrame:
    """Per day: visits, all-brands % and each brand's % (long form)."""
    r = _brand_rows(c3, brands)
    per = r.groupBy("visit_date", "brand").agg(F.count(F.lit(1)).alias("visits"),
                                              F.count_if("sold").alias("sold"),
                                              F.count_if("all_brands").alias("all_b"))
    return per.select("visit_date", "brand", "visits",
                      F.round(F.col("sold") / F.col("visits") * 100.0, 1).alias("brand_pct"),
                      F.round(F.col("all_b") / F.col("visits") * 100.0, 1).alias("all_brands_pct")) \
        .orderBy("visit_date", "brand")


def miss_matrix(c3: DataFrame, brands) -> DataFrame:
    """Booker × brand miss rate = 100 − sell rate; a booker × brand with no
    visits reads 100 (every booker × chosen brand appears)."""
    r = sell_rate(c3, brands)
    return r.select("booker_name", "brand",
                    F.when(F.col("visits") > 0, F.round(100.0 - F.col("sell_rate"), 1))
                     .otherwise(F.lit(100.0)).alias("miss_rate")).orderBy("booker_name", "brand")


def last_visit_gap(c3: DataFrame, brands) -> DataFrame:
    """% of shops where each brand was missing on their latest visit day
    (same-day visits of a shop are merged first)."""
    d = c3.where(F.col("store_code").isNotNull() & (F.col("store_code") != ""))
    sold = [f"sold_{brand_col(b)}" for b in brands]
    day = d.groupBy("store_code", "visit_date").agg(*[F.max(s).alias(s) for s in sold])
    ld = day.groupBy("store_code").agg(F.max_by(F.struct(*sold), "visit_date").alias("last")) \
        .where("last is not null").select("store_code", "last.*")
    r = _brand_rows(ld, brands)
    g = r.groupBy("brand").agg(F.count(F.lit(1)).alias("shops"), F.count_if(~F.col("sold")).alias("miss_count"))
    return g.select("brand", "miss_count", "shops",
                    F.round(F.col("miss_count") / F.col("shops") * 100.0, 1).alias("miss_pct")) \
        .orderBy(F.desc("miss_pct"), "brand")


def daily_brand_shops(facts: Facts, window: tuple, town: str, brands) -> DataFrame:
    """Per day: distinct shops that bought each chosen brand, 'Other' (any
    unselected brand), plus assigned / productive visits and shops."""
    visits, long = visit_brand_long(facts, window, town)
    v = visits.select("visit_id", "visit_date", "store_code", "visit_complete", "non_productive")
    j = long.join(v, "visit_id").withColumn(
        "bucket", F.when(F.col("brand").isin(*list(brands)), F.col("brand")).otherwise(F.lit("Other")))
    per = j.groupBy("visit_date", "bucket").agg(F.count_distinct("store_code").alias("shops"))
    prod = (F.col("visit_complete") == "yes") & (F.col("non_productive") != "yes")
    stats = v.groupBy("visit_date").agg(
        F.count(F.lit(1)).alias("assigned_visits"), F.count_distinct("store_code").alias("assigned_shops"),
        F.count_if(prod).alias("productive_visits"),
        F.count_distinct(F.when(prod, F.col("store_code"))).alias("productive_shops"))
    return per.join(stats, "visit_date", "left").orderBy("visit_date", "bucket")


def shop_day_detail(c3: DataFrame) -> DataFrame:
    """C11: per shop and day: Order / No Order (any brand sold that day), NMV,
    and the number of shops assigned that day."""
    g = c3.groupBy("visit_date", "store_code").agg(
        F.max("store_name").alias("store_name"), F.max("booker_name").alias("booker_name"),
        F.sum("total_nmv").alias("total_nmv"),
        F.max((F.col("brands_sold_count") > 0) | F.col("sold_other")).alias("ordered"))
    # Shops per day: a partial aggregate joined back on the day (no window that
    # would gather one day's shops into a single task).
    per_day = g.groupBy("visit_date").agg(F.count(F.lit(1)).alias("assigned_shops"))
    return g.join(small(per_day), "visit_date").select(
        "visit_date", "store_code", "store_name", "booker_name",
        F.round("total_nmv", 4).alias("total_nmv"),
        F.when(F.col("ordered"), "Order").otherwise("No Order").alias("status"),
        "assigned_shops").orderBy("visit_date", "store_code")


def booker_day_matrix(c3: DataFrame, brands, top: int = 60) -> DataFrame:
    """Booker × day: distinct visits and visits selling each chosen brand,
    for the ``top`` bookers by visits (long form)."""
    sold = [f"sold_{brand_col(b)}" for b in brands]
    g = c3.groupBy("booker_name", "visit_date").agg(
        F.count_distinct("visit_id").alias("visits"), *[F.count_if(s).alias(s) for s in sold])
    tot = c3.groupBy("booker_name").agg(F.count_distinct("visit_id").alias("n"))
    best = tot.orderBy(F.desc("n"), "booker_name").limit(top)
    return g.join(best.select("booker_name"), "booker_name", "left_semi") \
        .orderBy("booker_name", "visit_date")


def shop_table(c3: DataFrame, brands, missed_only: bool = False, top: int | None = None) -> DataFrame:
    """Per shop: flags at the last visit day, visit days, total NMV;
    optionally shops missing a brand at their last visit; optionally top n by NMV.

    A shop-day counts once: its NMV is that of the day's last visit (by id)."""
    sold = [f"sold_{brand_col(b)}" for b in brands]
    day = c3.groupBy("store_code", "visit_date").agg(
        F.max("store_name").alias("store_name"), F.max_by("total_nmv", "visit_id").alias("total_nmv"),
        F.struct(*[F.max(s).alias(f"last_{s}") for s in sold]).alias("flags"))
    t = day.groupBy("store_code").agg(
        F.max("store_name").alias("store_name"), F.count("*").alias("visit_days"),
        F.round(F.sum("total_nmv"), 4).alias("total_nmv"), F.max("visit_date").alias("last_visit"),
        F.max_by("flags", "visit_date").alias("flags")).where("store_code is not null and last_visit is not null")
    t = t.select("store_code", "store_name", "visit_days", "total_nmv", "last_visit", "flags.*")
    if missed_only:  # at least one chosen brand not sold at the last visit
        n_sold = sum((F.col(f"last_{s}").cast("int") for s in sold), F.lit(0))
        t = t.where(n_sold < len(sold))
    t = t.orderBy(F.desc("total_nmv"), "store_code")
    return t.limit(top) if top else t


def booker_detail(c3: DataFrame, booker: str | None = None, last_n: int = 50) -> DataFrame:
    """C14: one booker's latest ``last_n`` visits with their flags; without a
    name, the booker with most visits (ties by name) is chosen in-plan."""
    if booker is not None:
        mine = c3.where(F.col("booker_name") == booker)
    else:
        top = c3.groupBy("booker_name").agg(F.count(F.lit(1)).alias("n")) \
            .orderBy(F.desc("n"), "booker_name").limit(1).select("booker_name")
        mine = c3.join(top, "booker_name", "left_semi")
    return mine.orderBy(F.desc("visit_date"), F.desc("visit_id")).limit(last_n)


def booker_summary(c3: DataFrame, brands) -> DataFrame:
    """C14 header: per booker: visits, shops, all-brand %, sell rate per brand."""
    sold = [f"sold_{brand_col(b)}" for b in brands]
    return c3.groupBy("booker_name").agg(
        F.count(F.lit(1)).alias("visits"), F.count_distinct("store_code").alias("shops"),
        F.round(F.count_if("all_brands") / F.count(F.lit(1)) * 100.0, 1).alias("all_brands_pct"),
        *[F.round(F.count_if(s) / F.count(F.lit(1)) * 100.0, 1).alias(f"{s}_pct") for s in sold]) \
        .orderBy("booker_name")


def coverage_kpi(c3: DataFrame, brands) -> DataFrame:
    """Visits, all-brand visits and %, visits missing a brand, % per brand."""
    sold = [f"sold_{brand_col(b)}" for b in brands]
    n = F.count(F.lit(1))
    return c3.agg(n.alias("visits"), F.count_if("all_brands").alias("all_brand_visits"),
                  F.when(n > 0, F.round(F.count_if("all_brands") / n * 100.0, 1)).otherwise(F.lit(0.0))
                  .alias("all_brand_pct"),
                  F.count_if(~F.col("all_brands")).alias("visits_missing_a_brand"),
                  *[F.when(n > 0, F.round(F.count_if(s) / n * 100.0, 1)).otherwise(F.lit(0.0))
                    .alias(f"{s}_pct") for s in sold])
