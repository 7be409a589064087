"""Fact and dimension stand-ins derived from the driver tables (FIXTURES.md §2).

The application reads three facts (order lines, visits, stock snapshots) and
four small dimensions. Here they are lazy DataFrames derived from the TPC-H
style tables, so every builder's work grows with the input. In production the
same frames come from the ingest job's partitioned tables (``Facts.from_tables``).

Derivation rules (arithmetic only, so an SQL oracle can repeat them):
- order lines: lineitem ⋈ orders ⋈ customer→nation→region ⋈ part ⋈ supplier→nation
- visits: one per order; booker = smallest supplier key among its lines
- stock: every region × every part × snapshot days
- sku_master / universe / targets: from part / customer / prior-year sales
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.joins import small, spread
from ..functions.periods import month_end
from ..params import AS_OF
from .tables import Tables, exists

DEC = DecimalType(18, 4)

# Fixed values of the stand-in derivation.
KG_TYPES = ("SMALL", "ECONOMY")          # p_type sold by weight; others by volume
STOCK_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
STOCK_DAY0 = dt.date(1995, 1, 1)         # day_no origin of the stock value rule
NO_CHANNEL_MOD = 50                      # universe: channel NULL when key % 50 = 0
NOT_IN_UNIVERSE_MOD = 97                 # universe: store left out when key % 97 = 0
BLANK_BRAND_MOD = 40                     # sku_master: brand '' when key % 40 = 0
NOT_IN_MASTER_MOD = 89                   # sku_master: part left out when key % 89 = 0
NO_TARGET_MOD = 10                       # targets: booker left out when key % 10 = 0
NO_DOC_MOD = 20                          # visits: no document when order key % 20 = 0
TARGET_UPLIFT = "1.1"


def _d(c) -> F.Column:
    return F.col(c).cast(DEC)


def stock_days(as_of: dt.date = AS_OF) -> list[dt.date]:
    """The 90 days ending at ``as_of`` plus the last 12 month-ends, ascending."""
    days = {as_of - dt.timedelta(days=i) for i in range(90)}
    first = as_of.replace(day=1)
    for i in range(12):
        y, m = divmod(first.year * 12 + first.month - 1 - i, 12)
        nxt = dt.date(y + (m + 1) // 12, (m + 1) % 12 + 1, 1)
        month_end = nxt - dt.timedelta(days=1)
        if month_end <= as_of:
            days.add(month_end)
    if as_of.month == 12:
        last = dt.date(as_of.year, 12, 31)
    else:
        last = dt.date(as_of.year, as_of.month + 1, 1) - dt.timedelta(days=1)
    if last > as_of:  # a month whose end is after as_of has no month-end snapshot yet
        days.discard(last)
    return sorted(days)


_ORDER_COLS = {
    # column -> dims it needs: c=customer→region, o=orders, p=part, s=supplier, sn=supplier nation
    "report_date": set(), "account_label": {"o", "c"}, "distributor_code": {"o", "c"},
    "distributor_name": {"o", "c"}, "store_code": {"o"}, "store_name": {"o", "c"},
    "sku_code": set(), "sku_name": {"p"}, "category_code": {"p"}, "category_name": {"p"},
    "brand": {"p"}, "booker_code": set(), "booker_name": {"s"}, "dm_code": {"s"},
    "dm_name": {"s", "sn"}, "order_number": set(), "invoice_number": set(),
    "status": {"o"}, "order_date": {"o"}, "delivery_date": set(),
    "order_units": set(), "order_amount": set(), "order_kg": {"p"}, "order_litres": {"p"},
    "delivered_units": set(), "delivered_amount": set(), "delivered_kg": {"p"},
    "delivered_litres": {"p"}, "returned_units": set(), "returned_amount": set(),
    "total_discount": set(),
}
ORDER_COLUMNS = tuple(_ORDER_COLS)


class Facts:
    """Lazy facts and dimensions for one input directory."""

    def __init__(self, tables: Tables, as_of: dt.date = AS_OF):
        self.t = tables
        self.spark = tables.spark
        self.as_of = as_of

    @classmethod
    def from_dir(cls, spark, sf_dir: str, as_of: dt.date = AS_OF) -> "Facts":
        return cls(Tables(spark, sf_dir), as_of)

    # ------------------------------------------------------------------ dims
    def _customer_region(self, distributor: str | None = None) -> DataFrame:
        region = self.t.region.select("r_regionkey", "r_name")
        if distributor:
            region = region.where(F.col("r_name") == distributor)
        nation = self.t.nation.select("n_nationkey", "n_regionkey")
        # region (5 rows) and nation (25 rows) are fixed-size at every scale factor.
        geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
        cust = self.t.customer.select("c_custkey", "c_name", "c_nationkey")
        return cust.join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey) \
            .select("c_custkey", "c_name", "r_name")

    def orders_fact(self, columns=None, delivery: tuple | None = None,
                    order_dates: tuple | None = None,
                    distributor: str | None = None) -> DataFrame:
        """Order × SKU lines (orders_fact schema of FIXTURES.md §1).

        ``columns`` limits the output and therefore the dimensions joined.
        ``delivery`` / ``order_dates`` are inclusive date ranges applied on the
        raw timestamp columns so they reach the parquet scans as pushed
        filters (``delivery`` may have no first day); ``distributor`` filters the region dimension before joins.
        """
        cols = list(columns) if columns else list(ORDER_COLUMNS)
        need = set().union(*[_ORDER_COLS[c] for c in cols])
        if distributor:
            need |= {"o", "c"}
        li = self.t.lineitem.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_returnflag", "l_shipdate")
        if delivery:
            lo, hi = delivery
            li = li.where(F.col("l_shipdate") < F.lit(hi + dt.timedelta(days=1)))
            if lo:
                li = li.where(F.col("l_shipdate") >= F.lit(lo))
        df = li
        if "o" in need or order_dates:
            o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
            if order_dates:
                lo, hi = order_dates
                o = o.where((F.col("o_orderdate") >= F.lit(lo))
                            & (F.col("o_orderdate") < F.lit(hi + dt.timedelta(days=1))))
            if "c" in need:
                cr = self._customer_region(distributor)
                o = o.join(small(cr), o.o_custkey == cr.c_custkey)
            df = df.join(o, df.l_orderkey == o.o_orderkey)
        if "p" in need:
            p = self.t.part.select("p_partkey", "p_name", "p_type", "p_brand")
            df = df.join(small(p), df.l_partkey == p.p_partkey)
        if "s" in need:
            s = self.t.supplier.select("s_suppkey", "s_name", "s_nationkey")
            if "sn" in need:
                sn = self.t.nation.select(F.col("n_nationkey").alias("sn_key"),
                                          F.col("n_name").alias("sn_name"))
                s = s.join(F.broadcast(sn), s.s_nationkey == sn.sn_key)  # nation: 25 rows
            df = df.join(small(s), df.l_suppkey == s.s_suppkey)

        qty = _d("l_quantity")
        amt = _d("l_extendedprice")
        disc = F.round(amt * _d("l_discount"), 4).cast(DEC)
        zero = F.lit(0).cast(DEC)
        is_kg = F.col("p_type").isin(*KG_TYPES) if "p" in need else F.lit(False)
        ret = F.col("l_returnflag") == "R"
        exprs = {
            "report_date": F.to_date("l_shipdate"),
            "account_label": F.col("r_name") if "c" in need else None,
            "distributor_code": F.col("r_name") if "c" in need else None,
            "distributor_name": F.col("r_name") if "c" in need else None,
            "store_code": F.col("o_custkey").cast("string") if "o" in need else None,
            "store_name": F.col("c_name") if "c" in need else None,
            "sku_code": F.col("l_partkey").cast("string"),
            "sku_name": F.col("p_name") if "p" in need else None,
            "category_code": F.col("p_type") if "p" in need else None,
            "category_name": F.col("p_type") if "p" in need else None,
            "brand": F.col("p_brand") if "p" in need else None,
            "booker_code": F.col("l_suppkey").cast("string"),
            "booker_name": F.col("s_name") if "s" in need else None,
            "dm_code": F.col("s_nationkey").cast("string") if "s" in need else None,
            "dm_name": F.col("sn_name") if "sn" in need else None,
            "order_number": F.col("l_orderkey").cast("string"),
            "invoice_number": F.col("l_orderkey").cast("string"),
            "status": F.col("o_orderstatus") if "o" in need else None,
            "order_date": F.to_date("o_orderdate") if "o" in need else None,
            "delivery_date": F.to_date("l_shipdate"),
            "order_units": qty, "delivered_units": qty, "order_amount": amt,
            "total_discount": disc, "delivered_amount": (amt - disc).cast(DEC),
            "order_kg": F.when(is_kg, qty).otherwise(zero),
            "order_litres": F.when(is_kg, zero).otherwise(qty),
            "delivered_kg": F.when(is_kg, qty).otherwise(zero),
            "delivered_litres": F.when(is_kg, zero).otherwise(qty),
            "returned_units": F.when(ret, qty).otherwise(zero),
            "returned_amount": F.when(ret, amt).otherwise(zero),
        }
        return df.select([exprs[c].alias(c) for c in cols])

    def visits_fact(self, visit_dates: tuple | None = None,
                    distributor: str | None = None) -> DataFrame:
        """One visit per order that has lines (visits_fact schema)."""
        o = self._visit_orders(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"], visit_dates)
        lines = self.t.lineitem
        if visit_dates or distributor:
            # Only the lines of the wanted orders are aggregated.
            wanted = o.select("o_orderkey", "o_custkey")
            if distributor:
                here = self._customer_region(distributor).select("c_custkey")
                wanted = wanted.join(here, wanted.o_custkey == here.c_custkey, "left_semi")
            lines = lines.join(wanted, lines.l_orderkey == wanted.o_orderkey, "left_semi")
        # Partial aggregate per order (map-side combine), then one join on the
        # same key: the aggregate output is already hash-partitioned by it.
        lines = lines.groupBy("l_orderkey").agg(
            F.min("l_suppkey").alias("v_supp"),
            F.max("l_shipdate").alias("v_ship"),
            F.sum(_d("l_quantity")).cast(DEC).alias("total_units"),
            F.sum(_d("l_extendedprice")).cast(DEC).alias("total_value"),
            F.count_distinct("l_partkey").cast("int").alias("total_sku_sold"))
        cr = self._customer_region(distributor)
        s = self.t.supplier.select("s_suppkey", "s_name")
        df = (o.join(small(cr), o.o_custkey == cr.c_custkey)
              .join(lines, o.o_orderkey == lines.l_orderkey)
              .join(small(s), F.col("v_supp") == s.s_suppkey))
        doc = F.when(F.col("o_orderkey") % NO_DOC_MOD != 0, F.col("o_orderkey").cast("string"))
        return df.select(
            F.to_date("o_orderdate").alias("visit_date"),
            F.to_date("v_ship").alias("delivery_date"),
            F.concat(F.col("r_name"), F.lit(" ["), F.col("r_name"), F.lit("]")).alias("distributor"),
            F.concat(F.col("s_name"), F.lit(" ["), F.col("s_suppkey").cast("string"),
                     F.lit("]")).alias("app_user"),
            F.lit(None).cast("string").alias("pjp_name"),
            F.col("o_custkey").cast("string").alias("store_code"),
            F.col("c_name").alias("store_name"),
            doc.alias("order_number"), doc.alias("invoice_number"),
            F.when(F.col("o_orderstatus") == "P", "No").otherwise("Yes").alias("visit_complete"),
            F.when(F.col("o_orderstatus") == "O", "Yes").otherwise("No").alias("non_productive"),
            F.lit(None).cast("string").alias("close_reason"),
            "total_units", "total_value", "total_sku_sold",
            F.lit(1).alias("total_visits"))

    def _visit_orders(self, columns: list[str], visit_dates: tuple | None) -> DataFrame:
        o = self.t.orders.select(*columns)
        if visit_dates:
            lo, hi = visit_dates
            o = o.where((F.col("o_orderdate") >= F.lit(lo))
                        & (F.col("o_orderdate") < F.lit(hi + dt.timedelta(days=1))))
        return o

    def visit_days(self, visit_dates: tuple | None = None, distributor: str | None = None) -> DataFrame:
        """(visit_date, distributor_code) of every visit: no line is read but
        for its order key, which tells that the order has lines."""
        o = self._visit_orders(["o_orderkey", "o_custkey", "o_orderdate"], visit_dates)
        cr = self._customer_region(distributor)
        o = o.join(small(cr), o.o_custkey == cr.c_custkey)
        keys = self.t.lineitem.select("l_orderkey")
        return o.join(keys, o.o_orderkey == keys.l_orderkey, "left_semi").select(
            F.to_date("o_orderdate").alias("visit_date"), F.col("r_name").alias("distributor_code"))

    def order_days(self) -> DataFrame:
        """(order_date, distributor_code) of every order with lines."""
        return self.visit_days().withColumnRenamed("visit_date", "order_date")

    def account_dates(self, table: str, date_col: str) -> DataFrame:
        """(account_label, day): dates of a fact by account, among them each account's latest one."""
        if table == "stock_fact":
            return self.stock_fact().select("account_label", F.col(date_col).alias("day"))
        if table == "visits_fact":
            days = self.visit_days()
        else:
            days = self.order_days() if date_col == "order_date" else self.orders_fact(["distributor_code", date_col])
        return days.select(F.col("distributor_code").alias("account_label"), F.col(date_col).alias("day"))

    def accounts(self) -> DataFrame:
        """(account_label) of all accounts, with or without data."""
        return self.t.region.select(F.col("r_name").alias("account_label"))

    def stock_fact(self, report_dates: tuple | None = None, distributor: str | None = None) -> DataFrame:
        """Stock snapshots (stock_fact schema): region × part × snapshot day."""
        days = stock_days(self.as_of)
        if report_dates:
            lo, hi = report_dates
            days = [d for d in days if lo <= d <= hi]
        p = self.t.part.select("p_partkey", "p_name", "p_brand", "p_retailprice")
        regions = [distributor] if distributor else STOCK_REGIONS
        p = p.where(F.lit(set(regions) <= set(STOCK_REGIONS)))
        # Generators, not joins: each part row expands to its regions and days.
        df = (spread(p, len(regions) * len(days)).withColumn("account_label", F.explode(F.array(*[F.lit(r) for r in regions])))
               .withColumn("report_date", F.explode(F.array(*[F.lit(d) for d in days]))))
        day_no = F.datediff(F.col("report_date"), F.lit(STOCK_DAY0))
        mult = (F.col("p_partkey") * 7 + day_no * 13) % 41
        return df.select(
            "report_date", "account_label",
            F.col("account_label").alias("distributor_code"),
            F.col("account_label").alias("distributor_name"),
            F.col("p_partkey").cast("string").alias("sku_code"),
            F.col("p_name").alias("sku_description"),
            F.col("p_brand").alias("brand_code"), F.col("p_brand").alias("brand_name"),
            (_d("p_retailprice") * mult.cast(DEC)).cast(DEC).alias("value"),
            F.lit("Value").alias("unit"))

    def sku_master(self) -> DataFrame:
        p = self.t.part.where(F.col("p_partkey") % NOT_IN_MASTER_MOD != 0)
        return p.select(
            F.col("p_partkey").cast("string").alias("sku_code"),
            F.when(F.col("p_partkey") % BLANK_BRAND_MOD == 0, F.lit(""))
             .otherwise(F.col("p_brand")).alias("brand"),
            F.col("p_size").cast(DEC).alias("uom"),
            F.col("p_name").alias("master_sku"), F.col("p_name").alias("short_master"),
            F.col("p_name").alias("sku"), F.lower("p_type").alias("slug"))

    def universe(self) -> DataFrame:
        c = self.t.customer.where(F.col("c_custkey") % NOT_IN_UNIVERSE_MOD != 0)
        return c.select(
            F.col("c_custkey").cast("string").alias("store_code"),
            F.when(F.col("c_custkey") % NO_CHANNEL_MOD == 0, F.lit(None).cast("string"))
             .otherwise(F.col("c_mktsegment")).alias("channel_type"),
            F.when(F.col("c_acctbal") >= 0, "Active").otherwise("Inactive").alias("status"))

    def _target_lines(self, columns: list[str], months: list[tuple] | None, distributor: str | None) -> DataFrame:
        """Last year's lines behind the targets of ``months`` ((year, month) pairs; None: all).

        The covering date range of the prior-year months reaches the scan."""
        window = None
        if months:
            lo, hi = min(months), max(months)
            window = dt.date(lo[0] - 1, lo[1], 1), month_end(dt.date(hi[0] - 1, hi[1], 1))
        f = self.orders_fact(columns, delivery=window, distributor=distributor)
        f = f.where(F.col("booker_code").cast("long") % NO_TARGET_MOD != 0)
        return f.withColumn("year", F.year("delivery_date") + 1).withColumn("month", F.month("delivery_date"))

    def targets_new(self, months: list[tuple] | None = None, distributor: str | None = None) -> DataFrame:
        """Brand targets: prior-year same-month NMV × 1.1 (bookers % 10 = 0 left out).

        ``months`` and ``distributor`` limit what is read."""
        f = self._target_lines(["delivery_date", "distributor_code", "booker_code", "brand",
                                "delivered_amount", "total_discount"], months, distributor)
        out = (f.groupBy("year", "month", "distributor_code", "booker_code", "brand")
               .agg(F.round(F.sum(F.col("delivered_amount") + F.col("total_discount"))
                            * F.lit(TARGET_UPLIFT).cast(DecimalType(2, 1)), 4)
                    .cast(DEC).alias("target"))
               .select("year", "month", "distributor_code", "booker_code", "brand",
                       F.lit("Value").alias("kpi"), "target"))
        return in_months(out, months)

    def target_months(self, distributor: str) -> DataFrame:
        """Distinct (year, month) with targets: reads dates, bookers and the order's region, no amounts."""
        return self._target_lines(["delivery_date", "booker_code"], None, distributor).select("year", "month").distinct()

    def targets(self, months: list[tuple] | None = None, distributor: str | None = None) -> DataFrame:
        """Legacy booker targets: value and volume per booker and month."""
        f = self._target_lines(["delivery_date", "distributor_code", "booker_code",
                                "delivered_amount", "total_discount", "delivered_litres",
                                "delivered_kg"], months, distributor)
        up = F.lit(TARGET_UPLIFT).cast(DecimalType(2, 1))
        out = (f.groupBy("year", "month", "distributor_code", "booker_code")
               .agg(F.round(F.sum(F.col("delivered_amount") + F.col("total_discount")) * up, 4)
                    .cast(DEC).alias("target_in_value"),
                    F.round(F.sum(F.col("delivered_litres") + F.col("delivered_kg")) * up, 4)
                    .cast(DEC).alias("target_in_volume")))
        return in_months(out, months)


def in_months(df: DataFrame, months: list[tuple] | None) -> DataFrame:
    """Rows whose (year, month) is one of ``months``; None keeps all."""
    if months is None:
        return df
    return df.where((F.col("year") * 100 + F.col("month")).isin([y * 100 + m for y, m in months]))


class TableFacts(Facts):
    """Facts served from loaded tables (the ingest job's output) or from any
    DataFrames with the FIXTURES.md §1 schemas (hand-made test frames).

    Filters are applied on the fact columns, so with tables partitioned by
    ``distributor_code`` and month they prune partitions and reach the scans.
    """

    def __init__(self, spark, orders=None, visits=None, stock=None, sku_master=None,
                 universe=None, targets=None, targets_new=None, as_of: dt.date = AS_OF, marks=None):
        self.spark = spark
        #: date ranges of loaded tables by name (``snapshots.marks``)
        self._marks = marks or {}
        self.as_of = as_of
        self._o, self._v, self._s = orders, visits, stock
        self._m, self._u, self._t, self._tn = sku_master, universe, targets, targets_new

    @classmethod
    def from_path(cls, spark, root: str, as_of: dt.date = AS_OF) -> "TableFacts":
        """Facts from the loaded tables under ``root`` (one folder per table), each as of its latest version."""
        from ..operators import snapshots

        found, dates = [], {}
        for n in ("orders_fact", "visits_fact", "stock_fact", "sku_master", "universe", "targets", "targets_new"):
            path = f"{root.rstrip('/')}/{n}"
            version = snapshots.snapshot(spark, path)
            if version is not None:
                found.append(snapshots.read_version(spark, version))
                dates[n] = snapshots.marks(spark, path, version)
            else:  # plain parquet files of another writer, or not loaded yet
                found.append(spark.read.parquet(path) if exists(spark, path) else None)
        return cls(spark, *found, as_of, dates)

    @staticmethod
    def _window(df, col, w, month_col=None):
        if w:
            df = df.where(F.col(col) <= F.lit(w[1]))
            pruned = month_col and month_col in df.columns  # partition pruning on the month folder
            if pruned:
                df = df.where(F.col(month_col) <= F.lit(w[1]))
            if w[0]:
                df = df.where(F.col(col) >= F.lit(w[0]))
                if pruned:
                    df = df.where(F.col(month_col) >= F.lit(w[0].replace(day=1)))
        return df

    def orders_fact(self, columns=None, delivery=None, order_dates=None, distributor=None):
        df = self._window(self._window(self._o, "delivery_date", delivery, "delivery_month"),
                          "order_date", order_dates)
        if distributor:
            df = df.where(F.col("distributor_code") == distributor)
        cols = list(columns) if columns else [c for c in ORDER_COLUMNS if c in df.columns]
        return df.select(cols)  # a column that the table lacks is an error

    def visits_fact(self, visit_dates=None, distributor=None):
        df = self._window(self._v, "visit_date", visit_dates, "visit_month")
        if distributor:
            if "distributor_code" in df.columns:  # partition pruning
                return df.where(F.col("distributor_code") == distributor)
            df = df.where(_bracket_code("distributor") == distributor)
        return df

    def visit_days(self, visit_dates=None, distributor=None):
        df = self.visits_fact(visit_dates, distributor)
        code = F.col("distributor_code") if "distributor_code" in df.columns else _bracket_code("distributor")
        return df.select("visit_date", code.alias("distributor_code"))

    def order_days(self):
        return self._o.select("order_date", "distributor_code")

    def account_dates(self, table, date_col):
        if table in self._marks:  # written with each load, so no fact row is read
            m = self._marks[table].where(F.col("date_col") == date_col)
            return m.select("account_label", F.col("last_date").alias("day"))
        return super().account_dates(table, date_col)

    def accounts(self):
        if "orders_fact" in self._marks:
            return self._marks["orders_fact"].select("account_label").distinct()
        return self._o.select(F.col("distributor_code").alias("account_label")).distinct()

    def stock_fact(self, report_dates=None, distributor=None):
        df = self._window(self._s, "report_date", report_dates, "report_month")
        return df.where(F.col("distributor_code") == distributor) if distributor else df

    def sku_master(self):
        return self._m

    def universe(self):
        return self._u

    @staticmethod
    def _of(df, months, distributor):
        df = in_months(df, months)
        return df.where(F.col("distributor_code") == distributor) if distributor else df

    def targets(self, months=None, distributor=None):
        return self._of(self._t, months, distributor)

    def targets_new(self, months=None, distributor=None):
        return self._of(self._tn, months, distributor)

    def target_months(self, distributor):
        return self.targets_new(None, distributor).select("year", "month").distinct()


def _bracket_code(c: str):
    return F.trim(F.substring_index(F.substring_index(c, "[", -1), "]", 1))
