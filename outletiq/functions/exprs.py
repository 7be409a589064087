"""Column expressions shared by the builders (PRJ1–PRJ12, AG5, growth)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import OTHER_TOWN, TOWNS


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nmv(guarded: bool = False) -> Column:
    """PRJ1: NMV = delivered amount + total discount.

    Un-guarded is NULL when either side is NULL; guarded treats NULL as 0.
    """
    if guarded:
        return F.coalesce(F.col("delivered_amount"), F.lit(0)) + \
            F.coalesce(F.col("total_discount"), F.lit(0))
    return F.col("delivered_amount") + F.col("total_discount")


def volume_row(litres="delivered_litres", kg="delivered_kg") -> Column:
    """PRJ2: litres, or kg when litres is 0 (row level)."""
    return F.when(c(litres) == 0, c(kg)).otherwise(c(litres))


def volume_group(litres_sum: Column, kg_sum: Column) -> Column:
    """PRJ3: Σ litres, or Σ kg when Σ litres is 0 (group level, not additive)."""
    return F.when(litres_sum == 0, kg_sum).otherwise(litres_sum)


def volume_additive(litres="delivered_litres", kg="delivered_kg") -> Column:
    """PRJ4: litres + kg."""
    return c(litres) + c(kg)


def town_label(code="distributor_code", towns: dict | None = None,
               other: str = OTHER_TOWN) -> Column:
    """PRJ5: distributor code -> town label."""
    towns = TOWNS if towns is None else towns
    expr = None
    for k, v in towns.items():
        expr = (F.when(c(code) == k, F.lit(v)) if expr is None
                else expr.when(c(code) == k, F.lit(v)))
    return F.lit(other) if expr is None else expr.otherwise(F.lit(other))


def channel_or_default(col="channel_type", blank_too: bool = False,
                       default: str = "Channel Empty") -> Column:
    """PRJ6: 'Channel Empty' for NULL (and blank when ``blank_too``)."""
    if blank_too:
        return F.when(c(col).isNull() | (F.trim(c(col)) == ""), F.lit(default)).otherwise(c(col))
    return F.coalesce(c(col), F.lit(default))


def bracket_name(col) -> Column:
    """PRJ7: text before the first '[' , trimmed ('Ali [B12]' -> 'Ali')."""
    return F.trim(F.substring_index(c(col), "[", 1))


def bracket_code(col) -> Column:
    """PRJ7: text inside the last '[...]' ('Ali [B12]' -> 'B12'); whole text if no bracket."""
    return F.trim(F.substring_index(F.substring_index(c(col), "[", -1), "]", 1))


def blank_to(col, default: str | None = "Unknown") -> Column:
    """PRJ8: COALESCE(NULLIF(TRIM(x), ''), default)."""
    v = F.nullif(F.trim(c(col)), F.lit(""))
    return v if default is None else F.coalesce(v, F.lit(default))


def document_key(order="order_number", invoice="invoice_number") -> Column:
    """PRJ9: order number, else invoice number; NULL when both blank."""
    return F.coalesce(blank_to(order, None), blank_to(invoice, None))


def month_start(col) -> Column:
    """PRJ12: first day of the month (YYYY-MM-01)."""
    return F.trunc(c(col), "month")


def month_key(col) -> Column:
    """PRJ12: 'YYYY-MM' text."""
    return F.date_format(c(col), "yyyy-MM")


def ratio(a, b) -> Column:
    """AG5: a / NULLIF(b, 0) in double precision (NULL when b is 0 or NULL)."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def growth_pct(cur, base, digits: int = 0) -> Column:
    """(cur / base − 1) × 100 rounded; NULL when base is NULL or 0."""
    return F.round((ratio(cur, base) - F.lit(1.0)) * F.lit(100.0), digits)


def growth_zero_base(cur, base, digits: int = 1) -> Column:
    """M8/M9 rule: base 0 and current > 0 -> 100; both 0 (or base 0) -> 0."""
    b = F.coalesce(c(base).cast("double"), F.lit(0.0))
    cu = F.coalesce(c(cur).cast("double"), F.lit(0.0))
    return (F.when(b == 0, F.when(cu > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
            .otherwise(F.round((cu / b - 1.0) * 100.0, digits)))


def dbl(x, digits: int | None = None) -> Column:
    """Output cast: exact decimals become doubles only at the end."""
    v = c(x).cast("double")
    return F.round(v, digits) if digits is not None else v
