"""Period arithmetic (FLT14–16, ING15), overlapping period tags and the SQL guard."""

import datetime as dt

import pytest

from outletiq.functions import periods as P
from outletiq.operators import sqlrunner as SQ


def test_month_end_clamp():
    assert P.add_months(dt.date(2001, 3, 31), -1) == dt.date(2001, 2, 28)
    assert P.add_months(dt.date(2000, 3, 31), -1) == dt.date(2000, 2, 29)
    assert P.shift((dt.date(2001, 3, 1), dt.date(2001, 3, 31)), -12) == (dt.date(2000, 3, 1),
                                                                          dt.date(2000, 3, 31))


def test_presets_and_previous_window():
    a = dt.date(2001, 6, 30)
    assert P.period_bounds("Last 7 Days", a) == (dt.date(2001, 6, 24), a)
    assert P.period_bounds("Last Month", a) == (dt.date(2001, 5, 1), dt.date(2001, 5, 31))
    assert P.period_bounds("Last 3 Months", a) == (dt.date(2001, 4, 1), a)
    assert P.period_bounds("YTD", a) == (dt.date(2001, 1, 1), a)
    assert P.period_bounds("Custom", a, (dt.date(2001, 2, 1), dt.date(2001, 1, 1))) == (
        dt.date(2001, 1, 1), dt.date(2001, 2, 1))
    assert P.previous_window(dt.date(2001, 3, 1), dt.date(2001, 3, 31)) == (dt.date(2001, 1, 29),
                                                                            dt.date(2001, 2, 28))


def test_period_check():
    assert P.check_period(None, None) is None
    assert P.check_period("2001-01-01", "2001-01-02") == (dt.date(2001, 1, 1), dt.date(2001, 1, 2))
    with pytest.raises(ValueError):
        P.check_period("2001-01-01", None)
    with pytest.raises(ValueError):
        P.check_period("2001-02-01", "2001-01-01")


def test_row_in_two_periods(spark):
    df = spark.createDataFrame([(dt.date(2001, 3, 10),), (dt.date(2001, 2, 10),)], "d date")
    w = P.growth_windows((dt.date(2001, 2, 1), dt.date(2001, 4, 15)))
    tags = sorted((str(r.d), r.period) for r in P.tag_periods(df, "d", w).collect())
    # 2001-03-10 is in the current window and in last month's (2001-01-01..2001-03-15)
    assert tags == [("2001-02-10", "cur"), ("2001-02-10", "lm"), ("2001-03-10", "cur"),
                    ("2001-03-10", "lm")]


@pytest.mark.parametrize("text,ok", [
    ("select 1; drop table t", False),
    ("select 'drop'", True),
    ("/* x */ select 1", True),
    ("with a as (select 1) select * from a", False),
    ("select 1;", True),
    ("SELECT * FROM t -- delete later", True),
    ("select * from t where x = 1 or set_flag", True),
    ("select 1 union select 2; select 3", False),
    ("update t set a = 1", False),
    ("", False),
    ("select '--x' as a, 1 as b", True),
    ("select replace(x, 'a', 'b') from t", True),
    ("select update, `drop` from t where set = 1", True),
    ("select 'it''s; fine', \"a;b\", 'back\\'slash;'", True),
    ("select 1 /* ; */ -- ; drop table t", True),
    ("select 1 /* open", False),
    ("select 'open", False),
    ("create table t as select 1", False),
    ("insert into t select 1", False),
    ("/* select */ drop table t", False),
    ("from t insert into u select *", False),
    ("set x = 1", False),
    ("explain select 1", False),
    (";", False),
    ("select transform(a) using 'cat' from t", False),
    ("select reflect('java.lang.System', 'exit', 1)", False),
    ("select `reflect`('a', 'b')", False),
    ("select * from a join b using (k)", True),
])
def test_select_guard(text, ok):
    if ok:
        SQ.check_select(text)
    else:
        with pytest.raises(SQ.UnsafeQuery):
            SQ.check_select(text)


def test_safe_select_and_preview(spark):
    text = "select id from range(100000)"
    assert SQ.safe_select(spark, text).count() == 100000  # no hidden cap
    assert SQ.preview(spark, text, limit=3).count() == 10  # clamped to at least 10
    assert SQ.preview(spark, text, limit=10 ** 6).count() == 5000
    row = SQ.safe_select(spark, "select '--x' as a, replace('abc', 'b', ';') as b -- note").first()
    assert (row.a, row.b) == ("--x", "a;c")
    assert SQ.template("t", ["a", "b"]) == "SELECT `a`, `b`\nFROM `t`\nLIMIT 100"


@pytest.mark.parametrize("text,ok", [
    ("select a from v", True),
    ("select V.a, count(*) over (partition by b order by a) as n from V where a in (select a from w)", True),
    ("select * from (with c as (select a from v) select * from c) x join w using (a)", True),
    ("select a, sum(b) as s from v group by all having sum(b) > 0 order by s limit 3", True),
    ("select e from v lateral view explode(array(a, b)) t as e", True),
    ("select a from v union all select a from w", True),
    ("select * from values (1, 2) as t(x, y)", True),
    ("select * from v pivot (sum(b) for a in (1, 2))", True),
    ("select (select max(a) from w) as m, exists (select 1 from w) as e", True),
    ("select * from text.`/etc/hostname`", False),
    ("select * from parquet.`/root/testdata/sf0.001/region.parquet`", False),
    ("select * from v where a in (select value from text.`/etc/hostname`)", False),
    ("select (select first(value) from `text`.`/etc/hostname`) as x", False),
    ("select * from (with c as (select * from csv.`/etc/hostname`) select * from c)", False),
    ("select * from identifier('text.`/etc/hostname`')", False),
    ("select * from other_view", False),
    ("select try_reflect('java.lang.System', 'getenv', 'HOME') as x", False),
    ("select upper(java_method('java.lang.System', 'getenv', 'HOME')) as x", False),
    ("select identifier('reflect')('java.lang.System', 'getenv', 'HOME') as x", False),
    ("select * from python_worker_logs()", False),
    ("select a from v where", False),
])
def test_plan_guard(spark, text, ok):
    for name in ("v", "w"):
        spark.createDataFrame([(1, 2), (3, 4)], "a int, b int").createOrReplaceTempView(name)
    if ok:
        SQ.safe_select(spark, text, ["v", "w"]).collect()
    else:
        with pytest.raises(SQ.UnsafeQuery):
            SQ.safe_select(spark, text, ["v", "w"])


def test_plan_guard_takes_the_sessions_views(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("mine")
    assert SQ.safe_select(spark, "select a from mine").first().a == 1
    with pytest.raises(SQ.UnsafeQuery, match="no such table"):
        SQ.safe_select(spark, "select * from text.`/etc/hostname`")
