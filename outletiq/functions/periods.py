"""Date windows (FLT1–FLT16) and multi-period tagging (§4.2 of the survey).

Window bounds are computed on the driver as plain dates (they are parameters,
not data) and bound into plans as literals.
"""

from __future__ import annotations

import calendar as _cal
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUR, LY, LM = "cur", "ly", "lm"


def add_months(d: dt.date, n: int) -> dt.date:
    """Calendar month shift that clamps to month end (like SQL ``add_months``)."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    m += 1
    return dt.date(y, m, min(d.day, _cal.monthrange(y, m)[1]))


def shift(window: tuple[dt.date, dt.date], months: int) -> tuple[dt.date, dt.date]:
    """FLT16: both bounds moved by ``months`` (−12 = last year, −1 = last month)."""
    return add_months(window[0], months), add_months(window[1], months)


def month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def month_end(d: dt.date) -> dt.date:
    return d.replace(day=_cal.monthrange(d.year, d.month)[1])


def previous_window(start: dt.date, end: dt.date) -> tuple[dt.date, dt.date]:
    """FLT15: the equal-length window ending the day before ``start``."""
    days = max((end - start).days + 1, 1)
    prev_end = start - dt.timedelta(days=1)
    return prev_end - dt.timedelta(days=days - 1), prev_end


def period_bounds(name: str, as_of: dt.date, custom: tuple | None = None):
    """FLT14: named presets relative to ``as_of``; a reversed custom range is swapped."""
    key = name.lower().replace(" ", "_")
    if key in ("last_7_days", "7d"):
        return as_of - dt.timedelta(days=6), as_of
    if key in ("last_30_days", "30d"):
        return as_of - dt.timedelta(days=29), as_of
    if key == "this_month":
        return as_of.replace(day=1), as_of
    if key == "last_month":
        end = as_of.replace(day=1) - dt.timedelta(days=1)
        return end.replace(day=1), end
    if key == "last_3_months":
        return add_months(as_of.replace(day=1), -2), as_of
    if key == "ytd":
        return as_of.replace(month=1, day=1), as_of
    if key == "custom":
        if not custom:
            return as_of - dt.timedelta(days=29), as_of
        a, b = custom
        return (b, a) if a > b else (a, b)
    raise ValueError(f"unknown period preset: {name}")


def check_period(start, end) -> tuple[dt.date, dt.date] | None:
    """ING15: both or none; ISO text or dates; start <= end."""
    if start is None and end is None:
        return None
    if start is None or end is None:
        raise ValueError("give both period start and end, or neither")
    s = start if isinstance(start, dt.date) else dt.date.fromisoformat(str(start))
    e = end if isinstance(end, dt.date) else dt.date.fromisoformat(str(end))
    if s > e:
        raise ValueError(f"period start {s} is after end {e}")
    return s, e


def between(c: Column | str, window: tuple[dt.date, dt.date]) -> Column:
    """FLT1: inclusive window."""
    col = F.col(c) if isinstance(c, str) else c
    return col.between(F.lit(window[0]), F.lit(window[1]))


def covering(*windows: tuple[dt.date, dt.date]) -> tuple[dt.date, dt.date]:
    """One window covering all the given ones (the single scan filter)."""
    return min(w[0] for w in windows), max(w[1] for w in windows)


def growth_windows(window: tuple[dt.date, dt.date]) -> dict[str, tuple[dt.date, dt.date]]:
    """Current, same window last year, same window last month."""
    return {CUR: window, LY: shift(window, -12), LM: shift(window, -1)}


def tag_periods(df: DataFrame, date_col: str, windows: dict[str, tuple],
                name: str = "period") -> DataFrame:
    """Explode each row into every period whose window holds its date.

    Windows may overlap (current vs last month when the range exceeds a month),
    so a row can carry several tags; rows in no window are dropped.
    """
    tags = F.array(*[F.when(between(date_col, w), F.lit(k)) for k, w in windows.items()])
    return df.withColumn(name, F.explode(F.filter(tags, lambda x: x.isNotNull())))
