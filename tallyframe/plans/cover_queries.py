"""Queries over filings that cover what is asked for, and over pages that cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import planner, select
from tallyframe.plans.registry import query, table

#: Customers ask for the years before their latest order.
_REQUESTS = "SELECT o_custkey AS request, CAST(max(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS INT) AS p, CAST(1 + o_custkey % 12 AS INT) AS years FROM {orders} GROUP BY o_custkey"


@query(f"""WITH r AS (SELECT request, p // 4 AS y, p % 4 + 1 AS q, years FROM ({_REQUESTS.replace('{orders}', 'orders')})),
 s AS (SELECT *, CASE WHEN q = 4 THEN y ELSE y - 1 END AS last FROM r),
 t AS (SELECT request, y, q, last, unnest(range((last - years + 1) * 4, y * 4 + q)) AS i FROM s),
 quarters AS (SELECT request, last, y, q, i // 4 AS ty, i % 4 + 1 AS tq FROM t),
 given AS (SELECT request, CASE WHEN tq = 4 THEN '10-K' ELSE '10-Q' END AS form,
   CASE WHEN tq = 4 THEN last - 2 * ((last - ty) // 2) WHEN tq = 1 AND q = 1 AND ty = y THEN y WHEN tq = 3 THEN (CASE WHEN q >= 3 THEN y ELSE y - 1 END) - 2 * (((CASE WHEN q >= 3 THEN y ELSE y - 1 END) - ty) // 2)
     ELSE (CASE WHEN q >= 2 THEN y ELSE y - 1 END) - 2 * (((CASE WHEN q >= 2 THEN y ELSE y - 1 END) - ty) // 2) END AS year,
   CASE WHEN tq = 1 AND q = 1 AND ty = y THEN 1 WHEN tq = 1 THEN 2 ELSE tq END AS quarter FROM quarters
  UNION ALL SELECT request, '10-K', CASE WHEN f + 2 >= last THEN last ELSE last - 2 * ((last - f - 2 + 1) // 2) END, 4 FROM (SELECT request, last, unnest(range(last - years + 1, last + 1)) AS f FROM s))
 SELECT request, form, CAST(year AS INT) AS year, CAST(quarter AS INT) AS quarter, CAST(count(*) AS INT) AS score FROM given GROUP BY ALL""")
def q72_cover_plan(spark: SparkSession, d: str) -> DataFrame:
    """The reports that each customer's history needs, found by search; the SQL gives each period to its report in closed form."""
    asked = spark.sql(_REQUESTS, orders=table(spark, d, "orders"))
    requests = asked.select("request", F.floor(F.col("p") / 4).cast("int").alias("year"), (F.col("p") % 4 + 1).cast("int").alias("quarter"), "years")
    chosen, _ = planner.cover(planner.targets(requests), planner.reports(requests))
    return chosen.select("request", "form", "year", "quarter", "score")


#: Suppliers as documents, days as pages: few of them hold a statement of some kind.
_DAYS = """SELECT l_suppkey AS doc_id, CAST(datediff(CAST(l_shipdate AS DATE), DATE '1992-01-01') AS INT) AS page_idx, bool_or(l_quantity >= 49 AND l_returnflag = 'A') AS valid_balance,
 bool_or(l_quantity >= 49 AND l_returnflag = 'R') AS valid_income, bool_or(l_quantity <= 1 AND l_returnflag = 'N' AND l_suppkey % 4 > 0) AS valid_cash, bool_or(l_linenumber <= 3) AS goes FROM {lineitem} GROUP BY 1, 2"""
_DUCK_DAYS = _DAYS.replace("datediff(CAST(l_shipdate AS DATE), DATE '1992-01-01')", "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))").replace("{lineitem}", "lineitem")


@query(f"""WITH f AS ({_DUCK_DAYS}),
 t AS (SELECT doc_id, min({{'s': greatest(b.page_idx, i.page_idx, c.page_idx) - least(b.page_idx, i.page_idx, c.page_idx), 'b': b.page_idx, 'i': i.page_idx, 'c': c.page_idx}}) AS m
  FROM (SELECT * FROM f WHERE valid_balance) b JOIN (SELECT * FROM f WHERE valid_income) i USING (doc_id) JOIN (SELECT * FROM f WHERE valid_cash) c USING (doc_id) GROUP BY doc_id),
 s AS (SELECT doc_id, page_idx FROM f JOIN t USING (doc_id) WHERE page_idx BETWEEN least(m.b, m.i, m.c) - 4 AND greatest(m.b, m.i, m.c) + 5 AND (valid_balance OR valid_income OR valid_cash)),
 n1 AS (SELECT s.doc_id, f.page_idx FROM s JOIN f ON f.doc_id = s.doc_id AND f.page_idx = s.page_idx + 1 WHERE f.goes), n2 AS (SELECT n1.doc_id, f.page_idx FROM n1 JOIN f ON f.doc_id = n1.doc_id AND f.page_idx = n1.page_idx + 1 WHERE f.goes),
 p AS (SELECT doc_id, list_sort(flatten([coalesce(list(page_idx) FILTER (WHERE valid_balance), []), coalesce(list(page_idx) FILTER (WHERE valid_income), []), coalesce(list(page_idx) FILTER (WHERE valid_cash), [])])) AS pool,
  bool_or(valid_balance) AND bool_or(valid_income) AND bool_or(valid_cash) AS whole FROM f GROUP BY doc_id),
 m AS (SELECT doc_id, pool[len(pool) // 2 + 1] AS mid FROM p WHERE NOT whole AND len(pool) > 0)
 SELECT doc_id, page_idx FROM s UNION SELECT * FROM n1 UNION SELECT * FROM n2 UNION SELECT f.doc_id, f.page_idx FROM f JOIN m USING (doc_id) WHERE f.page_idx BETWEEN greatest(mid - 4, 0) AND mid + 4""")
def q73_cluster_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages around the tightest three of each document, or around its median page."""
    pages = spark.sql(_DAYS, lineitem=table(spark, d, "lineitem"))
    flags = pages.select("*", *[F.col("goes").alias(f"on_{s}") for s in select.STATEMENTS]).drop("goes")
    return select.cluster_pages(flags, pages)
