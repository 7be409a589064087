"""The fact stand-ins of ``sources.facts`` written as ANSI SQL CTEs.

Used only to build independent oracle queries (DuckDB dialect) over the same
parquet tables; nothing here runs on Spark.
"""

from __future__ import annotations

from ..params import AS_OF
from .sqlbits import stock_days

D = "DECIMAL(18,4)"

_CTE = {
    "orders_fact": f"""orders_fact AS (
  SELECT CAST(l.l_shipdate AS DATE) AS report_date,
         r.r_name AS account_label, r.r_name AS distributor_code, r.r_name AS distributor_name,
         CAST(o.o_custkey AS VARCHAR) AS store_code, c.c_name AS store_name,
         CAST(l.l_partkey AS VARCHAR) AS sku_code, p.p_name AS sku_name,
         p.p_type AS category_code, p.p_type AS category_name, p.p_brand AS brand,
         CAST(l.l_suppkey AS VARCHAR) AS booker_code, s.s_name AS booker_name,
         CAST(s.s_nationkey AS VARCHAR) AS dm_code, sn.n_name AS dm_name,
         CAST(l.l_orderkey AS VARCHAR) AS order_number,
         CAST(l.l_orderkey AS VARCHAR) AS invoice_number,
         o.o_orderstatus AS status, CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(l.l_shipdate AS DATE) AS delivery_date,
         CAST(l.l_quantity AS {D}) AS order_units,
         CAST(l.l_quantity AS {D}) AS delivered_units,
         CAST(l.l_extendedprice AS {D}) AS order_amount,
         CAST(ROUND(CAST(l.l_extendedprice AS {D}) * CAST(l.l_discount AS {D}), 4) AS {D}) AS total_discount,
         CAST(CAST(l.l_extendedprice AS {D})
              - CAST(ROUND(CAST(l.l_extendedprice AS {D}) * CAST(l.l_discount AS {D}), 4) AS {D}) AS {D})
           AS delivered_amount,
         CASE WHEN p.p_type IN ('SMALL','ECONOMY') THEN CAST(l.l_quantity AS {D}) ELSE CAST(0 AS {D}) END AS order_kg,
         CASE WHEN p.p_type IN ('SMALL','ECONOMY') THEN CAST(0 AS {D}) ELSE CAST(l.l_quantity AS {D}) END AS order_litres,
         CASE WHEN p.p_type IN ('SMALL','ECONOMY') THEN CAST(l.l_quantity AS {D}) ELSE CAST(0 AS {D}) END AS delivered_kg,
         CASE WHEN p.p_type IN ('SMALL','ECONOMY') THEN CAST(0 AS {D}) ELSE CAST(l.l_quantity AS {D}) END AS delivered_litres,
         CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_quantity AS {D}) ELSE CAST(0 AS {D}) END AS returned_units,
         CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_extendedprice AS {D}) ELSE CAST(0 AS {D}) END AS returned_amount
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN region r ON cn.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey)""",
    "visits_fact": f"""visits_fact AS (
  SELECT CAST(o.o_orderdate AS DATE) AS visit_date, CAST(li.v_ship AS DATE) AS delivery_date,
         r.r_name || ' [' || r.r_name || ']' AS distributor,
         s.s_name || ' [' || CAST(s.s_suppkey AS VARCHAR) || ']' AS app_user,
         CAST(NULL AS VARCHAR) AS pjp_name,
         CAST(o.o_custkey AS VARCHAR) AS store_code, c.c_name AS store_name,
         CASE WHEN o.o_orderkey % 20 <> 0 THEN CAST(o.o_orderkey AS VARCHAR) END AS order_number,
         CASE WHEN o.o_orderkey % 20 <> 0 THEN CAST(o.o_orderkey AS VARCHAR) END AS invoice_number,
         CASE WHEN o.o_orderstatus = 'P' THEN 'No' ELSE 'Yes' END AS visit_complete,
         CASE WHEN o.o_orderstatus = 'O' THEN 'Yes' ELSE 'No' END AS non_productive,
         CAST(NULL AS VARCHAR) AS close_reason,
         li.total_units, li.total_value, li.total_sku_sold, 1 AS total_visits
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN region r ON cn.n_regionkey = r.r_regionkey
  JOIN (SELECT l_orderkey, MIN(l_suppkey) AS v_supp, MAX(l_shipdate) AS v_ship,
               CAST(SUM(CAST(l_quantity AS {D})) AS {D}) AS total_units,
               CAST(SUM(CAST(l_extendedprice AS {D})) AS {D}) AS total_value,
               CAST(COUNT(DISTINCT l_partkey) AS INTEGER) AS total_sku_sold
        FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
  JOIN supplier s ON li.v_supp = s.s_suppkey)""",
    "sku_master": f"""sku_master AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku_code,
         CASE WHEN p_partkey % 40 = 0 THEN '' ELSE p_brand END AS brand,
         CAST(p_size AS {D}) AS uom, p_name AS master_sku, p_name AS short_master,
         p_name AS sku, lower(p_type) AS slug
  FROM part WHERE p_partkey % 89 <> 0)""",
    "universe": """universe AS (
  SELECT CAST(c_custkey AS VARCHAR) AS store_code,
         CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_mktsegment END AS channel_type,
         CASE WHEN c_acctbal >= 0 THEN 'Active' ELSE 'Inactive' END AS status
  FROM customer WHERE c_custkey % 97 <> 0)""",
    "targets_new": f"""targets_new AS (
  SELECT year(delivery_date) + 1 AS year, month(delivery_date) AS month,
         distributor_code, booker_code, brand, 'Value' AS kpi,
         CAST(ROUND(SUM(delivered_amount + total_discount) * CAST(1.1 AS DECIMAL(2,1)), 4) AS {D}) AS target
  FROM orders_fact WHERE CAST(booker_code AS BIGINT) % 10 <> 0
  GROUP BY 1, 2, 3, 4, 5)""",
    "targets": f"""targets AS (
  SELECT year(delivery_date) + 1 AS year, month(delivery_date) AS month,
         distributor_code, booker_code,
         CAST(ROUND(SUM(delivered_amount + total_discount) * CAST(1.1 AS DECIMAL(2,1)), 4) AS {D}) AS target_in_value,
         CAST(ROUND(SUM(delivered_litres + delivered_kg) * CAST(1.1 AS DECIMAL(2,1)), 4) AS {D}) AS target_in_volume
  FROM orders_fact WHERE CAST(booker_code AS BIGINT) % 10 <> 0
  GROUP BY 1, 2, 3, 4)""",
}


def _stock_cte(as_of=AS_OF) -> str:
    days = ", ".join(f"DATE '{d.isoformat()}'" for d in stock_days(as_of))
    return f"""stock_fact AS (
  SELECT report_date, account_label, account_label AS distributor_code,
         account_label AS distributor_name, CAST(p_partkey AS VARCHAR) AS sku_code,
         p_name AS sku_description, p_brand AS brand_code, p_brand AS brand_name,
         CAST(CAST(p_retailprice AS {D})
              * CAST((p_partkey * 7 + (report_date - DATE '1995-01-01') * 13) % 41 AS {D}) AS {D}) AS value,
         'Value' AS unit
  FROM (SELECT *, unnest([{days}]) AS report_date
        FROM (SELECT p_partkey, p_name, p_brand, p_retailprice,
                     unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']) AS account_label
              FROM part) pr) pd)"""


_DEPS = {"targets_new": ["orders_fact"], "targets": ["orders_fact"]}


def with_facts(*names: str) -> str:
    """``WITH`` clause defining the named stand-ins (and what they depend on)."""
    order: list[str] = []

    def add(n):
        for dep in _DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [_stock_cte() if n == "stock_fact" else _CTE[n] for n in order]
    return "WITH " + ",\n".join(parts) + "\n"
