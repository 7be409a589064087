"""Small SQL text helpers for the oracle queries (DuckDB dialect).

Dates are worked out here anew, so that a wrong rule of the package does not
count on both sides of a comparison.
"""

from __future__ import annotations

import datetime as dt

from ..params import OTHER_TOWN, TOWNS


def month_end(x: dt.date) -> dt.date:
    """The day before the first of the next month."""
    return (x.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)


def add_months(x: dt.date, n: int) -> dt.date:
    """The same day ``n`` months on, or that month's last day."""
    month = x.year * 12 + x.month - 1 + n
    last = month_end(dt.date(month // 12, month % 12 + 1, 1))
    return last.replace(day=min(x.day, last.day))


def previous_window(start: dt.date, end: dt.date) -> tuple[dt.date, dt.date]:
    """As many days, right before."""
    return start - (end - start) - dt.timedelta(days=1), start - dt.timedelta(days=1)


def stock_days(as_of: dt.date) -> list[dt.date]:
    """The 90 days to ``as_of`` and the month-ends of twelve months that are not after it."""
    ends = [month_end(add_months(as_of.replace(day=1), -i)) for i in range(12)]
    return sorted({as_of - dt.timedelta(days=i) for i in range(90)} | {e for e in ends if e <= as_of})


def d(x: dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def between(col: str, w) -> str:
    return f"{col} BETWEEN {d(w[0])} AND {d(w[1])}"


def town_case(col: str = "distributor_code", other: str = OTHER_TOWN) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in TOWNS.items())
    return f"CASE {whens} ELSE '{other}' END"


def growth(cur: str, base: str, digits: int = 0) -> str:
    return (f"ROUND((CAST({cur} AS DOUBLE) / NULLIF(CAST({base} AS DOUBLE), 0) - 1) * 100, "
            f"{digits})")


def growth_zero_base(cur: str, base: str, digits: int) -> str:
    return (f"CASE WHEN COALESCE({base}, 0) = 0 THEN CASE WHEN COALESCE({cur}, 0) > 0 "
            f"THEN 100.0 ELSE 0.0 END ELSE ROUND((CAST({cur} AS DOUBLE) / {base} - 1) * 100, "
            f"{digits}) END")


def windows(window):
    """The window, the same days a year before, and a month before."""
    return {"cur": window, **{k: tuple(add_months(x, -n) for x in window) for k, n in (("ly", 12), ("lm", 1))}}


def town_where(col: str, town: str | None) -> str:
    return "TRUE" if town in (None, "all") else f"{col} = '{town}'"
