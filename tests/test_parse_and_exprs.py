"""ING7 / ING8 / ING1 / ING3 edge cases and column expressions (FIXTURES.md §4)."""

import datetime as dt

from pyspark.sql import functions as F

from outletiq.functions import exprs as X
from outletiq.functions import parse as PR


def _one(spark, expr, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"t {dtype}")
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def test_date_parser_edge_cases(spark):
    vals = ["0000-00-00", "November 30, -0001", "February, 28 2026", "01/02/2026", "n/a",
            "12/31/2026", "2026-03-05 10:22:01", "Mar 5 2026", "", None]
    got = _one(spark, PR.parse_date, vals)
    assert got == [None, None, dt.date(2026, 2, 28), dt.date(2026, 2, 1), None,
                   dt.date(2026, 12, 31), dt.date(2026, 3, 5), dt.date(2026, 3, 5), None, None]


def test_order_report_dates(spark):
    vals = ["2026-03-05T10:22:01Z", "05-Mar-2026", "01-02-2026", "(null)"]
    got = _one(spark, lambda c: PR.parse_date(c, order_report=True), vals)
    # a trailing '-dddd' is null in the first pass; '05-Mar-2026' parses in the second
    assert got == [dt.date(2026, 3, 5), dt.date(2026, 3, 5), None, None]


def test_staged_parser_equals_column_parser(spark):
    vals = ["0000-00-00", "February, 28 2026", "01/02/2026", "2026-03-05T10:22:01Z",
            "05-Mar-2026", " 'March 5, 2026' ", "1/2/2026 9:05 PM"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    for order in (False, True):
        a = [r[0] for r in df.select(PR.parse_date(F.col("t"), order)).collect()]
        b = [r[0] for r in PR.with_parsed_dates(df, ["t"], order).collect()]
        assert a == b


def test_number_parser(spark):
    got = _one(spark, PR.parse_number, ["1,234.50", "abc", "", "  42 ", None])
    assert [None if g is None else float(g) for g in got] == [1234.5, None, None, 42.0, None]


def test_header_rule(spark):
    got = _one(spark, PR.canonical_name, ["Order (KG)", "S.No#", " Non Productive\nw.r.t Order "])
    assert got == ["order_kg", "s_no", "non_productive_w_r_t_order"]


def test_bracket_split(spark):
    df = spark.createDataFrame([("Ali Khan [B 12]",), ("No Brackets",), ("A [x] [Y9]",)], "t string")
    rows = df.select(X.bracket_name("t"), X.bracket_code("t")).collect()
    assert [tuple(r) for r in rows] == [("Ali Khan", "B 12"), ("No Brackets", "No Brackets"),
                                        ("A", "Y9")]


def test_volume_and_nmv_forms(spark):
    df = spark.createDataFrame([(0.0, 5.0, 10.0, None), (2.0, 5.0, 10.0, 1.0)],
                               "delivered_litres double, delivered_kg double, "
                               "delivered_amount double, total_discount double")
    r = df.select(X.volume_row(), X.nmv(), X.nmv(guarded=True)).collect()
    assert [tuple(x) for x in r] == [(5.0, None, 10.0), (2.0, 11.0, 11.0)]


def test_growth_rules(spark):
    df = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (5.0, None), (15.0, 10.0)], "c double, b double")
    r = df.select(X.growth_pct("c", "b"), X.growth_zero_base("c", "b", 1)).collect()
    assert [tuple(x) for x in r] == [(None, 100.0), (None, 0.0), (None, 100.0), (50.0, 50.0)]


def test_fingerprint_stable_and_null_aware(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    h = [r[0] for r in df.select(PR.fingerprint(["y", "x"])).collect()]
    assert h[0] == h[2] and h[0] != h[1]
