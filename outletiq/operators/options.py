"""Option lists and data-availability look-ups (SRC5–SRC10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import periods as P
from ..functions.joins import small
from ..sources.dims import universe_by_store
from ..sources.facts import Facts


def channel_options(facts: Facts, window: tuple, town: str) -> DataFrame:
    """SRC5/SRC6: distinct non-blank channels of the stores served in the window."""
    f = facts.orders_fact(["store_code", "delivery_date"], delivery=window, distributor=town)
    f = f.join(small(universe_by_store(facts.universe())), "store_code", "left")
    return f.where(F.col("channel_type").isNotNull() & (F.trim("channel_type") != "")) \
        .select(X.channel_or_default("channel_type").alias("channel")).distinct().orderBy("channel")


def month_channel_options(facts: Facts, town: str, period: str) -> DataFrame:
    """SRC6: channel options of one month given as 'YYYY-M'."""
    y, m = (int(x) for x in period.split("-"))
    lo = dt.date(y, m, 1)
    return channel_options(facts, (lo, P.month_end(lo)), town)


def target_period_options(facts: Facts, town: str) -> DataFrame:
    """SRC7: distinct target periods 'YYYY-M', newest first (numeric order, Q6)."""
    t = facts.target_months(town)
    return t.select(F.concat_ws("-", F.col("year").cast("string"), F.col("month").cast("string"))
                    .alias("period"), "year", "month") \
        .orderBy(F.desc("year"), F.desc("month"))


def latest_visit_date(facts: Facts, town: str) -> DataFrame:
    """SRC9: latest valid visit date of one distributor (one row)."""
    v = facts.account_dates("visits_fact", "visit_date").where(F.col("account_label") == town)
    return v.agg(F.max("day").alias("latest_visit_date"))


def window_with_fallback(facts: Facts, window: tuple, town: str, days: int = 30) -> tuple:
    """SRC10: the window itself when it holds visits, else the ``days`` days
    ending at the latest visit date (two tiny look-ups on the driver)."""
    if facts.visit_days(window, town).limit(1).count() > 0:
        return window
    r = latest_visit_date(facts, town).first()
    latest = r["latest_visit_date"] if r else None
    if latest is None:
        return window
    return latest - dt.timedelta(days=days - 1), latest
