"""Read-only SQL entry point (SQL1–SQL3).

A guard looks at the statement before anything reaches ``spark.sql`` (which
would execute DDL/DML eagerly). It reads the text as tokens, so comments,
string literals and quoted names are told apart from code wherever they stand.
Then Spark's own parser makes the logical plan of the text, and only plans of
query nodes over registered views and tables pass: no commands, no scripts, no files named as
relations, no functions that reach outside the engine.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..sources.facts import Facts

PREVIEW_MIN, PREVIEW_MAX, PREVIEW_DEFAULT = 10, 5000, 500
# Functions by which a SELECT can run code outside the engine.
OUTSIDE = ("reflect", "try_reflect", "java_method")
# What a parsed query may consist of. Everything else is refused, commands and scripts
# among them, and relations or functions named by an expression.
QUERY_NODES = frozenset("""Aggregate CTERelationRef Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin
Limit LocalLimit LocalRelation Offset OneRowRelation Pivot Project ResolvedHint Sample Sort SubqueryAlias Tail Union
UnresolvedGroupByAll UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedSubqueryColumnAliases
UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Unpivot UnresolvedRelation Window WithWindowDefinition""".split())
# Functions that make rows and read nothing.
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer",
                   "stack", "json_tuple")


class UnsafeQuery(ValueError):
    pass


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a statement: space, comment, literal, word, or a single other character."""
    i, n = 0, len(text)
    while i < n:
        c, start, kind = text[i], i, "other"
        if c.isspace():
            while i < n and text[i].isspace():
                i += 1
            kind = "space"
        elif text.startswith("--", i):
            i = n if (end := text.find("\n", i)) < 0 else end
            kind = "comment"
        elif text.startswith("/*", i):
            if (end := text.find("*/", i + 2)) < 0:
                raise UnsafeQuery("a comment has no end")
            i, kind = end + 2, "comment"
        elif c in "'\"`":
            i += 1
            while i < n and text[i] != c:
                i += 2 if text[i] == "\\" and c != "`" else 1
            if i >= n:
                raise UnsafeQuery("a quoted text has no end")
            i, kind = i + 1, "literal"  # a doubled quote reads as two literals side by side
        elif c.isalnum() or c == "_":
            while i < n and (text[i].isalnum() or text[i] == "_"):
                i += 1
            kind = "word"
        else:
            i += 1
        yield kind, text[start:i]


def check_select(text: str) -> str:
    """SQL1 guard: one statement, and it is a SELECT, which by its grammar
    changes nothing; scripts and Java calls in it are refused as well. Returns
    it without comments and closing semicolon, everything else as it was written
    (the reference's word check never matched — Q1; a word check is not needed)."""
    seen = [(kind, " " if kind == "comment" else t) for kind, t in tokens(str(text or ""))]
    while seen and (seen[-1][1] == ";" or not seen[-1][1].strip()):
        seen.pop()
    code = [(kind, t.lower()) for kind, t in seen if t.strip()]
    if not code:
        raise UnsafeQuery("empty query")
    if code[0] != ("word", "select"):
        raise UnsafeQuery("only SELECT queries are allowed")
    if ("other", ";") in code:
        raise UnsafeQuery("only a single SQL statement is allowed")
    for (kind, t), (next_kind, after) in zip(code, [*code[1:], ("", "")]):
        if t.strip("`") in OUTSIDE and after == "(" or (kind, t, next_kind) == ("word", "using", "literal"):
            raise UnsafeQuery(f"not allowed in a query: {t}")
    if code[-1] in (("word", "where"), ("word", "having")) and code[-2] != ("word", "as"):  # Spark takes it for an alias
        raise UnsafeQuery(f"nothing follows {code[-1][1]}")
    return "".join(t for _, t in seen).strip()


def _parts(spark: SparkSession, tree: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """(class name, object) of everything in a parsed plan: its nodes, their expressions, subqueries and lists."""
    gateway = spark.sparkContext._gateway
    waiting = [tree]
    while waiting:
        x = waiting.pop()
        if not isinstance(x, JavaObject):
            continue
        if is_instance_of(gateway, x, "scala.collection.Iterable"):
            it = x.iterator()
        elif is_instance_of(gateway, x, "scala.Product"):
            yield x.getClass().getName().rsplit(".", 1)[-1].rstrip("$"), x
            it = x.productIterator()
        else:
            continue
        while it.hasNext():
            waiting.append(it.next())


def _words(seq: JavaObject) -> list[str]:
    return [seq.apply(i) for i in range(seq.size())]


def check_plan(spark: SparkSession, text: str, views: list[str] | None = None) -> str:
    """SQL1 guard by plan: query nodes over ``views`` only (by default the session's views and
    the current database's tables, by their own names). Returns the text."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise UnsafeQuery(f"not a query: {e}") from e
    names = {v.lower() for v in (views if views is not None else [t.name for t in spark.catalog.listTables()])}
    gateway = spark.sparkContext._gateway
    relations = []
    for kind, x in _parts(spark, plan):
        if is_instance_of(gateway, x, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
            if kind not in QUERY_NODES:
                raise UnsafeQuery(f"not allowed in a query: {kind}")
            if kind == "UnresolvedRelation":
                relations.append(_words(x.multipartIdentifier()))
            elif kind == "UnresolvedWith":  # names that the query itself defines
                names |= {n.lower() for n in _cte_names(x)}
            elif kind == "UnresolvedTableValuedFunction" and _words(x.name())[-1].lower() not in TABLE_FUNCTIONS:
                raise UnsafeQuery(f"not allowed in a query: {'.'.join(_words(x.name()))}")
        elif kind == "UnresolvedFunction":
            if _words(x.nameParts())[-1].lower() in OUTSIDE:
                raise UnsafeQuery(f"not allowed in a query: {'.'.join(_words(x.nameParts()))}")
        elif "UnresolvedIdentifier" in kind:
            raise UnsafeQuery("names must be written out in a query")
    for parts in relations:
        if len(parts) != 1 or parts[0].lower() not in names:
            raise UnsafeQuery(f"no such table or view: {'.'.join(parts)}")
    return text


def _cte_names(node: JavaObject) -> list[str]:
    relations = node.cteRelations()
    return [relations.apply(i)._1() for i in range(relations.size())]


def safe_select(spark: SparkSession, text: str, views: list[str] | None = None) -> DataFrame:
    """SQL1: the guarded SELECT over ``views`` (see ``check_plan``), all of its rows."""
    return spark.sql(check_plan(spark, check_select(text), views))


def preview(spark: SparkSession, text: str, limit: int = PREVIEW_DEFAULT) -> DataFrame:
    """SQL1: the first rows of a guarded SELECT, for display; the number is
    clamped to [10, 5000] and is part of the plan."""
    return safe_select(spark, text).limit(max(PREVIEW_MIN, min(PREVIEW_MAX, int(limit))))


def register_views(facts: Facts) -> None:
    """Temp views the sample queries read (built lazily from the facts)."""
    facts.orders_fact().createOrReplaceTempView("orders_fact")
    facts.sku_master().createOrReplaceTempView("sku_master")
    facts.universe().createOrReplaceTempView("universe")
    facts.visits_fact().createOrReplaceTempView("visits_fact")
    facts.stock_fact().createOrReplaceTempView("stock_fact")


def sample_queries(town: str, as_of: dt.date) -> dict[str, str]:
    """SQL2: the four sample queries, in Spark SQL over the registered views."""
    return {
        "booker_nmv_top50": f"""SELECT booker_name, ROUND(SUM(delivered_amount + total_discount), 0) AS nmv
FROM orders_fact WHERE distributor_code = '{town}'
GROUP BY booker_name ORDER BY nmv DESC, booker_name LIMIT 50""",
        "brand_sales_top20": f"""SELECT m.brand AS brand, ROUND(SUM(o.delivered_amount + o.total_discount), 0) AS nmv
FROM orders_fact o LEFT JOIN (SELECT sku_code, MAX(brand) AS brand FROM sku_master GROUP BY sku_code) m
  ON m.sku_code = o.sku_code
WHERE o.distributor_code = '{town}'
GROUP BY m.brand ORDER BY nmv DESC, brand LIMIT 20""",
        "daily_trend_30d": f"""SELECT delivery_date AS day, ROUND(SUM(delivered_amount + total_discount), 0) AS nmv
FROM orders_fact WHERE distributor_code = '{town}'
  AND delivery_date >= DATE '{(as_of - dt.timedelta(days=30)).isoformat()}' AND delivery_date <= DATE '{as_of.isoformat()}'
GROUP BY delivery_date ORDER BY day""",
        "top25_outlets": f"""SELECT store_name AS outlet, ROUND(SUM(delivered_amount + total_discount), 0) AS nmv
FROM orders_fact WHERE distributor_code = '{town}'
GROUP BY store_name ORDER BY nmv DESC, outlet LIMIT 25""",
    }


def template(table: str, columns: list[str], limit: int = 100) -> str:
    """SQL3: a SELECT of chosen columns of one table."""
    cols = ", ".join(f"`{c}`" for c in columns) if columns else "*"
    return f"SELECT {cols}\nFROM `{table}`\nLIMIT {int(limit)}"
