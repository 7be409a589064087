"""Fixed parameters of the standard query set (see FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt

AS_OF = dt.date(2001, 6, 30)
WINDOW = (dt.date(2001, 3, 1), dt.date(2001, 3, 31))
OVERLAP_WINDOW = (dt.date(2001, 2, 1), dt.date(2001, 4, 15))
TOWN = "ASIA"
ALL = "all"
FOCUS_BRANDS = ("Brand#1", "Brand#2", "Brand#3")
BUCKET_LIMITS = (7, 15, 30, 45, 60)

# Distributor code -> town label used by the stand-in data.
# Any other code is labelled 'CBL', as in the reference's three-way CASE.
TOWNS = {"ASIA": "Karachi", "EUROPE": "Lahore"}
OTHER_TOWN = "CBL"
TARGET_PERIOD = "2001-3"            # T4 month, YYYY-M
FOCUS_BOOKER = "Supplier#000000001"  # F17 outlet list
EMPTY_WINDOW = (dt.date(2002, 12, 1), dt.date(2002, 12, 31))  # no visits: SRC10 fallback
