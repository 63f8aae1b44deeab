"""Queries over orders, line items, parts and events as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import labels as L
from tallyframe.functions import numbers as N
from tallyframe.functions import periods as R
from tallyframe.operators import certify as C
from tallyframe.operators import facts as A
from tallyframe.operators import planner, review
from tallyframe.operators import series as S
from tallyframe.operators import statements as M
from tallyframe.plans.registry import query, table


def money(c: Column | str) -> Column:
    """Exact sums of cents, so that the order of adding cannot show."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)")


def quarterly(spark: SparkSession, d: str) -> DataFrame:
    """Orders as facts: line (priority), year, quarter and exact totals."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("line"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.sum(money("o_totalprice")).alias("value"))


_Q = "SELECT o_orderpriority AS line, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS value FROM orders GROUP BY ALL"
#: Which slots each kind of year reports: some quarters direct, some year to date, some yearly.
_KIND = {0: ["q1", "q2", "q3", "q4"], 1: ["y1", "y2", "y3", "y4"], 2: ["q1", "q2", "q3", "fy"], 3: ["q1", "y2", "y3", "fy"]}


def slotted(spark: SparkSession, d: str) -> DataFrame:
    q = quarterly(spark, d)
    ytd = F.sum("value").over(Window.partitionBy("line", "year").orderBy("quarter"))
    q = q.withColumn("ytd", ytd)
    each = q.select("line", "year", F.explode(F.array(F.struct(F.concat(F.lit("q"), F.col("quarter")).alias("slot"), F.col("value").cast("decimal(28,2)").alias("value")), F.struct(F.concat(F.lit("y"), F.col("quarter")).alias("slot"), F.col("ytd").cast("decimal(28,2)").alias("value")))).alias("s")).select("line", "year", "s.*")
    fy = q.groupBy("line", "year").agg(F.when(F.count(F.lit(1)) == 4, F.sum("value").cast("decimal(28,2)")).alias("value")).select("line", "year", F.lit("fy").alias("slot"), "value")
    keep = F.lit(False)
    for k, names in _KIND.items():
        keep = keep | ((F.col("year") % 4 == k) & F.col("slot").isin(names))
    return S.slots(each.unionByName(fy).filter(keep), ["line", "year"])


def _wide() -> str:
    cols = []
    for s in S.SLOTS:
        kinds = [k for k, names in _KIND.items() if s in names]
        value = {"q": "CASE WHEN quarter = {n} THEN value END", "y": "CASE WHEN quarter = {n} THEN ytd END", "f": "CASE WHEN n = 4 THEN total END"}[s[0]].format(n=s[1])
        cols.append(f"max(CASE WHEN year % 4 IN ({', '.join(map(str, kinds))}) THEN {value} END) AS {s}")
    return f"""q AS ({_Q}), f AS (SELECT *, sum(value) OVER (PARTITION BY line, year ORDER BY quarter) AS ytd, count(*) OVER (PARTITION BY line, year) AS n, sum(value) OVER (PARTITION BY line, year) AS total FROM q),
 w AS (SELECT line, year, {', '.join(cols)} FROM f GROUP BY line, year)"""


_SERIES = f"""WITH {_wide()}, a AS (SELECT *, coalesce(q1, y1) AS d1 FROM w), b AS (SELECT *, coalesce(q2, y2 - d1) AS d2 FROM a), c AS (SELECT *, coalesce(q3, y3 - (d1 + d2)) AS d3 FROM b),
 e AS (SELECT *, coalesce(q4, y4 - (d1 + d2 + d3), fy - (d1 + d2 + d3)) AS d4 FROM c) SELECT line, year, d1 AS q1, d2 AS q2, d3 AS q3, d4 AS q4, coalesce(fy, y4, d1 + d2 + d3 + d4) AS fy FROM e"""


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem GROUP BY l_orderkey")
def q13_line_assembly(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1e12 + F.col("l_partkey") * 1e5 + F.col("l_suppkey")).alias("x"), F.col("l_partkey").cast("string").alias("t"), F.lit(1.0).alias("top"))
    return M.lines_of(w, ["l_orderkey"], "top", "x", "t").select("l_orderkey", "line")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS value FROM orders")
def q14_parse_number(spark: SparkSession, d: str) -> DataFrame:
    printed = F.format_number("o_totalprice", 2)
    k = F.col("o_orderkey")
    cell = F.when(k % 10 == 0, F.lit(" — ")).when(k % 3 == 0, F.concat(F.lit("("), printed, F.lit(")"))).otherwise(printed)
    return table(spark, d, "orders").select("o_orderkey", N.parse_number(cell).alias("value"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'In millions' WHEN 1 THEN 'In thousands' WHEN 2 THEN 'In billions' ELSE 'Unspecified' END AS units,
 round(p_retailprice * CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 0.001 WHEN p_size % 4 = 2 THEN 1000 ELSE 1 END, 4) AS value FROM part""")
def q15_detect_units(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 4
    text = F.concat(F.col("p_name"), F.when(size == 0, F.lit(" (In Millions)")).when(size == 1, F.lit(" (in thousands)")).when(size == 2, F.lit(" in BILLIONS")).otherwise(F.lit("")))
    label = F.concat(F.col("p_name"), F.when(F.col("p_size") % 5 == 0, F.lit(" per share")).otherwise(F.lit("")))
    u = N.units(text)
    return table(spark, d, "part").select("p_partkey", u["label"].alias("units"), F.round(N.scaled(label, F.col("p_retailprice"), u["scale"]), 4).alias("value"))


@query("SELECT p_partkey, p_size % 6 IN (0, 1) AS not_money FROM part")
def q16_non_monetary(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size") % 6
    label = F.concat(F.col("p_name"), F.when(s == 0, F.lit(" Operations")).when(s == 1, F.lit(" 5%")).otherwise(F.lit(" cost")))
    return table(spark, d, "part").select("p_partkey", N.non_monetary(label).alias("not_money"))


@query("""SELECT label, CAST(sum(CASE WHEN label = 'Total operating expenses' THEN v ELSE -abs(v) END) AS DOUBLE) AS value FROM (
 SELECT CASE l_returnflag WHEN 'A' THEN 'Provision for income taxes' WHEN 'R' THEN 'Cost of revenue' ELSE 'Total operating expenses' END AS label,
 CAST(l_extendedprice AS DECIMAL(18,2)) * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) AS v FROM lineitem) GROUP BY label""")
def q17_sign_income(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    label = F.when(flag == "A", "Provision for income taxes").when(flag == "R", "Cost of revenue").otherwise("Total operating expenses")
    v = money("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    rows = table(spark, d, "lineitem").select(label.alias("label"), v.alias("v"))
    return rows.groupBy("label").agg(F.sum(N.income_sign(F.col("label"), F.col("v"))).cast("double").alias("value"))


@query("""SELECT label, CAST(sum(CASE WHEN label IN ('Payments of debt', 'Purchase of property') THEN -abs(v) WHEN label = 'Proceeds from notes' THEN abs(v) ELSE v END) AS DOUBLE) AS value FROM (
 SELECT CASE event_type WHEN 'view' THEN 'Payments of debt' WHEN 'click' THEN 'Proceeds from notes' WHEN 'purchase' THEN 'Purchase of property' ELSE 'Other' END AS label,
 CAST(value AS DECIMAL(18,2)) * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS v FROM events) GROUP BY label""")
def q18_sign_cash(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    label = F.when(e == "view", "Payments of debt").when(e == "click", "Proceeds from notes").when(e == "purchase", "Purchase of property").otherwise("Other")
    v = money("value") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    rows = table(spark, d, "events").select(label.alias("label"), v.alias("v"))
    return rows.groupBy("label").agg(F.sum(N.cash_sign(F.col("label"), F.col("v"))).cast("double").alias("value"))


_ALIASES = [("economy", "Value"), ("PROMO ", "Promotional"), ("large:", "Big")]


@query("SELECT CASE p_type WHEN 'ECONOMY' THEN 'Value' WHEN 'PROMO' THEN 'Promotional' WHEN 'LARGE' THEN 'Big' ELSE p_type END AS canonical, count(*) AS n FROM part GROUP BY 1")
def q19_alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_type"), F.lit(":")).alias("label"))
    return A.with_aliases(lines, spark.createDataFrame(_ALIASES, "key string, value string"), "label").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


_YEARS = [1995, 1996, 1997, 2001, 2002]


@query("WITH w AS (SELECT n_name, " + ", ".join(f"sum(CASE WHEN year(o_orderdate) = {y} THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS y{y}" for y in _YEARS) + " FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name) " + " UNION ALL ".join(f"SELECT n_name, 'y{y}' AS period, CAST(y{y} AS DOUBLE) AS value FROM w" for y in _YEARS))
def q20_unpivot_long(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(money("o_totalprice")).alias("v"))
    joined = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    wide = joined.groupBy("n_name").agg(*[F.sum(F.when(F.col("y") == y, F.col("v"))).cast("double").alias(f"y{y}") for y in _YEARS])
    return A.unpivot(wide, ["n_name"], [f"y{y}" for y in _YEARS], "period", "value")


_PERIODS = [f"FY{y} Q{q}" for y in (1995, 1996) for q in (1, 2, 3, 4)]


@query(f"WITH q AS ({_Q}) SELECT line, " + ", ".join(f"CAST(sum(CASE WHEN 'FY' || year || ' Q' || quarter = '{p}' THEN value END) AS DOUBLE) AS \"{p}\"" for p in _PERIODS) + " FROM q WHERE year IN (1995, 1996) GROUP BY line")
def q21_pivot_series(spark: SparkSession, d: str) -> DataFrame:
    q = quarterly(spark, d).filter(F.col("year").isin(1995, 1996)).withColumn("p", F.concat(F.lit("FY"), F.col("year"), F.lit(" Q"), F.col("quarter")))
    return q.groupBy("line").pivot("p", _PERIODS).agg(F.sum("value").cast("double"))


@query("SELECT label, row_number() OVER (ORDER BY coalesce(CAST(nullif(regexp_extract(label, '\\d{4}', 0), '') AS INT), 9999), label) AS pos FROM (SELECT DISTINCT CASE WHEN o_orderkey % 50 = 0 THEN 'Other' ELSE 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) END AS label FROM orders)".replace("\\\\", "\\"))
def q22_period_order(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("o_orderkey") % 50 == 0, F.lit("Other")).otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate")))
    labels = table(spark, d, "orders").select(label.alias("label")).distinct()
    year = F.coalesce(F.nullif(F.regexp_extract("label", r"\d{4}", 0), F.lit("")).cast("int"), F.lit(9999))
    # as many rows as there are periods
    return labels.withColumn("pos", F.row_number().over(Window.orderBy(year, "label")).cast("long"))


@query("""SELECT o_orderstatus, (m).month AS month, (m).n AS n FROM (SELECT o_orderstatus, max_by({'month': month, 'n': n, 'first': first}, n * 1000000000 - first) AS m FROM (
 SELECT o_orderstatus, CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1)""")
def q23_fy_end_mode(spark: SparkSession, d: str) -> DataFrame:
    return S.mode_first(table(spark, d, "orders"), ["o_orderstatus"], F.month("o_orderdate").cast("long"), "o_orderkey", "month")


_FY = "make_date(year(d) + CASE WHEN month(d) > 6 OR (month(d) = 6 AND day(d) > 30) THEN 1 ELSE 0 END, 6, 30)"


@query(f"""SELECT fy_end, quarter, count(*) AS n FROM (SELECT fy_end, CAST(4 - ((year(fy_end) - year(d)) * 12 + month(fy_end) - month(d)) // 3 AS INT) AS quarter FROM (
 SELECT d, {_FY} AS fy_end FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders))) GROUP BY ALL""")
def q24_project_fy(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    fy = R.fiscal_year_end(day, F.lit(6), F.lit(31))
    rows = table(spark, d, "orders").select(fy.alias("fy_end"), R.quarter_index(F.lit("point"), F.lit(None).cast("int"), day, fy).alias("quarter"))
    return rows.groupBy("fy_end", "quarter").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH q AS ({_Q}) SELECT line, year, quarter, CAST(value AS DOUBLE) AS value FROM q")
def q25_ytd_diff(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("line", "year").orderBy("quarter")
    ytd = quarterly(spark, d).withColumn("ytd", F.sum("value").over(w))
    return ytd.select("line", "year", "quarter", (F.col("ytd") - F.coalesce(F.lag("ytd").over(w), F.lit(0))).cast("double").alias("value"))


def _doubles(df: DataFrame) -> DataFrame:
    return df.select("line", "year", *[F.col(c).cast("double").alias(c) for c in ("q1", "q2", "q3", "q4", "fy")])


@query("SELECT line, year, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("q1", "q2", "q3", "q4", "fy")) + f" FROM ({_SERIES})")
def q26_derive_series(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(S.derive_series(slotted(spark, d)))


_MEASURE = f"""WITH {_wide()}, a AS (SELECT *, coalesce(q1, y1) AS d1 FROM w), b AS (SELECT *, coalesce(q2, y2 - y1, y2 - d1) AS d2 FROM a), c AS (SELECT *, coalesce(q3, y3 - y2, y3 - (d1 + d2)) AS d3 FROM b),
 e AS (SELECT *, coalesce(q4, y4 - y3, fy - y3, fy - (d1 + d2 + d3), y4 - (d1 + d2 + d3)) AS d4 FROM c), g AS (SELECT *, coalesce(fy, y4, d1 + d2 + d3 + d4) AS df FROM e)"""


@query(_MEASURE + " " + " UNION ALL ".join(f"SELECT line, year, '{s}' AS slot, CAST({v} AS DOUBLE) AS value, {s} IS NULL AS derived FROM g WHERE {v} IS NOT NULL" for s, v in (("q1", "d1"), ("q2", "d2"), ("q3", "d3"), ("q4", "d4"), ("fy", "df"))))
def q27_derive_measure(spark: SparkSession, d: str) -> DataFrame:
    return S.derive_measurements(slotted(spark, d)).withColumn("value", F.col("value").cast("double"))


@query(f"SELECT year, count(*) AS lines, count(fy) AS known, CAST(sum(fy) AS DOUBLE) AS total FROM ({_SERIES}) GROUP BY year")
def q28_annual_fallback(spark: SparkSession, d: str) -> DataFrame:
    return S.derive_series(slotted(spark, d)).groupBy("year").agg(F.count(F.lit(1)).alias("lines"), F.count("fy").alias("known"), F.sum("fy").cast("double").alias("total"))


@query("SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_id % 5 <> 0) AS value FROM events GROUP BY user_id")
def q29_last_nonnull(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return A.latest_known(e, ["user_id"], "value", ["event_id"])


@query("SELECT o_custkey, (m).s AS o_orderstatus, (m).p AS o_orderpriority FROM (SELECT o_custkey, max({'d': o_orderdate, 'k': o_orderkey, 's': o_orderstatus, 'p': o_orderpriority}) AS m FROM orders GROUP BY 1)")
def q30_latest_presentation(spark: SparkSession, d: str) -> DataFrame:
    return A.presentation(table(spark, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate", "o_orderkey"])


@query("""WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS fy_end FROM orders WHERE month(o_orderdate) = 3)
 SELECT l_orderkey, l_linenumber, day, CASE WHEN date_diff('day', day, fy_end) <= 400 THEN fy_end END AS fy_end FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem) ASOF LEFT JOIN e ON day <= fy_end""")
def q31_asof_fy(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "orders").filter("month(o_orderdate) = 3").select(F.to_date("o_orderdate").alias("fy_end"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    return S.as_of(rows, ends, "day", "fy_end")


@query("""SELECT year(l_shipdate) AS year, CAST(sum(CASE WHEN l_returnflag = 'A' THEN p ELSE 0 END) + sum(CASE WHEN l_returnflag = 'N' THEN p ELSE 0 END) + sum(CASE WHEN l_returnflag = 'R' THEN p ELSE 0 END) - sum(p) AS DOUBLE) AS delta,
 'PASS' AS result FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem) GROUP BY 1""")
def q32_identity_check(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: parts by flag against the whole, by year, in one aggregation."""
    p = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag", money("l_extendedprice").alias("p"))
    parts = [F.sum(F.when(F.col("l_returnflag") == f, F.col("p")).otherwise(F.lit(0).cast("decimal(18,2)"))).alias(f) for f in "ANR"]
    wide = p.groupBy("year").agg(*parts, F.sum("p").alias("whole"))
    rows = C.identities(wide, {"parts": ((F.col("A") + F.col("N") + F.col("R") - F.col("whole")).cast("double"), ["A", "N", "R", "whole"], [])}, ["year"])
    return rows.select("year", "delta", F.when(F.col("ok"), "PASS").otherwise("CHECK").alias("result"))


_ROLL = """WITH q AS (SELECT o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) AS q, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS change FROM orders GROUP BY 1, 2),
 r AS (SELECT *, sum(change) OVER (PARTITION BY o_custkey ORDER BY q) AS closing FROM q), l AS (SELECT *, lag(closing) OVER (PARTITION BY o_custkey ORDER BY q) AS opening FROM r)"""


@query(_ROLL + " SELECT o_custkey, q, CAST(coalesce(opening, 0) + change - closing AS DOUBLE) AS delta, true AS ok FROM l")
def q33_roll_forward(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long").alias("q")).agg(F.sum(money("o_totalprice")).alias("change"))
    w = Window.partitionBy("o_custkey").orderBy("q")
    r = o.withColumn("end", F.sum("change").over(w)).withColumn("begin", F.coalesce(F.lag("end").over(w), F.lit(0)))
    rows = C.identities(r, {"roll": ((F.col("begin") + F.col("change") - F.col("end")).cast("double"), ["begin", "change", "end"], [])}, ["o_custkey", "q"])
    return rows.select("o_custkey", "q", "delta", "ok")


@query("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS p_day, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), t AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup')
 SELECT user_id, day, (m).o AS offset_days, (m).v AS value FROM (SELECT t.user_id, t.day, min({'f': abs(date_diff('day', day, p_day)), 'o': date_diff('day', day, p_day), 'v': value}) AS m FROM t JOIN p ON t.user_id = p.user_id AND abs(date_diff('day', day, p_day)) <= 3 GROUP BY 1, 2)""")
def q34_nearest_date(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    points = e.filter("event_type = 'purchase'").groupBy("user_id", F.col("day").alias("at")).agg(F.max("value").alias("value"))
    found = S.nearest_date(e.filter("event_type = 'signup'").select("user_id", "day").distinct(), points, ["user_id"], "day", "at", "value")
    return found.select("user_id", "day", F.col("offset").cast("long").alias("offset_days"), "value")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1, 2), f AS (SELECT l_orderkey, max(v) AS v FROM l GROUP BY 1)
 SELECT o_orderkey, CAST(coalesce(l.v, f.v) AS DOUBLE) AS value, CASE WHEN l.v IS NOT NULL THEN 'exact' WHEN f.v IS NOT NULL THEN 'period' END AS how FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey AND l.l_linenumber = o_orderkey % 7 + 1 LEFT JOIN f ON f.l_orderkey = o_orderkey""")
def q35_two_stage_link(spark: SparkSession, d: str) -> DataFrame:
    """Exact key first, then the looser one: both stages from one aggregation of the lines by order."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("v"))
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(money("l_extendedprice")).alias("v"))  # noqa: E741
    by_order = l.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(line)).alias("lines"), F.max("v").alias("best"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("n"))
    j = o.join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("exact", F.element_at("lines", F.col("n")))
    return j.select("o_orderkey", F.coalesce("exact", "best").cast("double").alias("value"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("best").isNotNull(), "period").alias("how"))


_CROSS = """WITH w AS (SELECT l_suppkey AS s, year(l_shipdate) AS year, sum(CASE WHEN l_returnflag = 'A' THEN p END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN p END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN p END) AS r, sum(p) AS t
 FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem) GROUP BY 1, 2)"""


def _supplier(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("year"), "l_returnflag", money("l_extendedprice").alias("p"))
    return p.groupBy("s", "year").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("p"))).alias(f.lower()) for f in "ANR"], F.sum("p").alias("t"))


def _crossfoot(spark: SparkSession, d: str) -> DataFrame:
    delta = (F.col("a") + F.col("n") + F.col("r") - F.col("t")).cast("double")
    return C.identities(_supplier(spark, d), {"crossfoot": (delta, ["a", "n", "r", "t"], [])}, ["s", "year"])


@query(_CROSS + " SELECT s, year, CAST(a + n + r - t AS DOUBLE) AS delta, a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL AS ok FROM w")
def q36_crossfoot(spark: SparkSession, d: str) -> DataFrame:
    return _crossfoot(spark, d).drop("check")


@query(_CROSS + " SELECT s, year, CAST(a + n + coalesce(r, 0) - t AS DOUBLE) AS delta, a IS NOT NULL AND n IS NOT NULL AS ok FROM w")
def q37_crossfoot_optional(spark: SparkSession, d: str) -> DataFrame:
    delta = (F.col("a") + F.col("n") + F.coalesce("r", F.lit(0)) - F.col("t")).cast("double")
    return C.identities(_supplier(spark, d), {"flow": (delta, ["a", "n", "t"], ["r"])}, ["s", "year"]).drop("check")


@query(_CROSS + " SELECT s, 'crossfoot' AS \"check\", 'CHECK' AS result, count(*) AS periods, count(*) FILTER (WHERE a IS NULL OR n IS NULL OR r IS NULL) AS failed FROM w GROUP BY s HAVING failed > 0")
def q38_issues(spark: SparkSession, d: str) -> DataFrame:
    return C.issues(C.verdicts(_crossfoot(spark, d), ["s"]))


@query("""SELECT o_custkey, (m).p AS o_orderpriority, (m).score AS score FROM (SELECT o_custkey, max_by({'p': o_orderpriority, 'score': score}, score * 1000000000 - first) AS m FROM (
 SELECT o_custkey, o_orderpriority, 10 * count(*) FILTER (WHERE o_orderstatus = 'F') + count(*) AS score, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1)""")
def q39_best_line(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("dur", F.when(F.col("o_orderstatus") == "F", "quarter").otherwise("ytd"))
    return C.best_line(o, ["o_custkey"], "o_orderpriority", "dur", "o_orderkey").select("o_custkey", "o_orderpriority", "score")


@query("SELECT o_custkey, (m).v AS o_totalprice, (m).d AS derived FROM (SELECT o_custkey, min({'d': o_orderstatus <> 'F', 'k': o_orderkey, 'v': o_totalprice}) AS m FROM orders GROUP BY 1)")
def q40_prefer_reported(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("derived", F.col("o_orderstatus") != "F")
    return C.prefer_reported(o, ["o_custkey"], "o_totalprice", "derived", "o_orderkey")


_PART_ROLES = [("part", "red", r"(?i)^red "), ("part", "ring", r"(?i) ring$"), ("part", "small", r"(?i)small")]


@query("SELECT p_brand, 'all' AS period, arg_min(p_retailprice, p_partkey) FILTER (WHERE regexp_matches(p_name, '^red ')) AS red, arg_min(p_retailprice, p_partkey) FILTER (WHERE regexp_matches(p_name, ' ring$')) AS ring, arg_min(p_retailprice, p_partkey) FILTER (WHERE regexp_matches(p_name, 'small')) AS small FROM part WHERE regexp_matches(p_name, '^red | ring$|small') GROUP BY 1")
def q41_role_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.lit("part").alias("statement"), F.lit("all").alias("period"), F.col("p_name").alias("label"), F.col("p_partkey").alias("order_index"), F.col("p_retailprice").alias("value"))
    return C.role_values(p, _PART_ROLES, ["p_brand"])


@query("""WITH r AS (SELECT n_nationkey AS request, 2015 + n_nationkey // 4 AS y, n_nationkey % 4 + 1 AS q, n_nationkey % 7 + 1 AS n FROM nation), b AS (SELECT *, CASE WHEN q = 4 THEN y ELSE y - 1 END AS latest FROM r), c AS (SELECT *, latest - n + 1 AS first FROM b)
 SELECT CAST(request AS BIGINT) AS request, form, CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter FROM (SELECT request, '10-K' AS form, unnest(range(latest, first - 1, -2)) AS year, 4 AS quarter FROM c UNION ALL SELECT request, '10-Q', y, 1 FROM c WHERE q = 1
 UNION ALL SELECT request, '10-Q', unnest(range(CASE WHEN q >= 2 THEN y ELSE y - 1 END, first - 1, -2)), 2 FROM c UNION ALL SELECT request, '10-Q', unnest(range(CASE WHEN q >= 3 THEN y ELSE y - 1 END, first - 1, -2)), 3 FROM c)""")
def q42_planner(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    requests = table(spark, d, "nation").select(n.alias("request"), (2015 + F.floor(n / 4)).cast("int").alias("year"), (n % 4 + 1).cast("int").alias("quarter"), (n % 7 + 1).cast("int").alias("years"))
    return planner.filings(requests).select(F.col("request").cast("long").alias("request"), "form", F.col("year").cast("long").alias("year"), F.col("quarter").cast("long").alias("quarter"))


@query("SELECT p_brand, lower(p_name) AS label, count(*) AS copies FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def q44_dup_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.repeated_labels(table(spark, d, "part"), "p_name", ["p_brand"])


@query("""WITH l AS (SELECT p_brand, p_partkey, p_name, p_size % 3 AS level FROM part), h AS (SELECT *, last_value(CASE WHEN level < 1 THEN {'l': level, 't': p_name} END IGNORE NULLS) OVER w AS a1, last_value(CASE WHEN level < 2 THEN {'l': level, 't': p_name} END IGNORE NULLS) OVER w AS a2
 FROM l WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT p_partkey, CASE level WHEN 1 THEN CASE WHEN (a1).l = 0 THEN (a1).t END WHEN 2 THEN CASE WHEN (a2).l = 1 THEN (a2).t END END AS parent FROM h""")
def q45_section_parent(spark: SparkSession, d: str) -> DataFrame:
    return A.section_parent(table(spark, d, "part"), ["p_brand"], "p_partkey", F.col("p_size") % 3, "p_name").select("p_partkey", "parent")


@query("""SELECT event_type, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id END) AS BIGINT) AS tokens, CASE WHEN count(*) = count(c) THEN CAST(sum(c) AS DOUBLE) END AS strict_cost, CAST(sum(c) AS DOUBLE) AS known_cost
 FROM (SELECT *, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS c FROM events) GROUP BY 1""")
def q48_usage_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("tokens"), F.when(~((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)), money("value")).alias("cost"))
    return review.usage(e, ["event_type"], "tokens", "cost").select("event_type", "tokens", F.col("strict_cost").cast("double").alias("strict_cost"), F.col("known_cost").cast("double").alias("known_cost"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q49_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    return A.without_existing(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query()
def q50_level_cluster(spark: SparkSession, d: str) -> DataFrame:
    xs = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("xs"))
    return xs.select("p_brand", F.array_join(M.levels(F.col("xs")), ",").alias("levels"))


@query("SELECT p_partkey, CASE WHEN p_size <= 15 THEN 0 WHEN p_size <= 30 THEN 1 ELSE 2 END AS col FROM part")
def q51_nearest_center(spark: SparkSession, d: str) -> DataFrame:
    centres = F.array(F.lit(10.0), F.lit(20.0), F.lit(40.0))
    return table(spark, d, "part").select("p_partkey", M.nearest_column(F.col("p_size"), centres).alias("col"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus = 'P' AS child, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM orders)
 SELECT o_custkey, parent, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM l WHERE child AND parent IS NOT NULL GROUP BY 1, 2""")
def q52_fragment_merge(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return A.parent_row(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", s == "P", s == "F", "o_totalprice")


_P = ["SELECT DISTINCT year(o_orderdate) * 10 + quarter(o_orderdate) AS p FROM orders", "SELECT DISTINCT year(l_shipdate) * 10 + quarter(l_shipdate) AS p FROM lineitem"]


@query(f"SELECT 'union' AS op, p FROM ({_P[0]} UNION {_P[1]}) UNION ALL SELECT 'intersect', p FROM ({_P[0]} INTERSECT {_P[1]}) UNION ALL SELECT 'except', p FROM ({_P[1]} EXCEPT {_P[0]})")
def q53_set_ops(spark: SparkSession, d: str) -> DataFrame:
    p = lambda t, c: table(spark, d, t).select((F.year(c) * 10 + F.quarter(c)).cast("long").alias("p")).distinct()
    a, b = p("orders", "o_orderdate"), p("lineitem", "l_shipdate")
    named = lambda n, df: df.select(F.lit(n).alias("op"), "p")
    return named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b))).unionByName(named("except", b.subtract(a)))


@query("SELECT event_id, event_type AS label, CAST(NULL AS DOUBLE) AS confidence FROM events WHERE event_type LIKE '%c%'")
def q54_request_json(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    reasons = F.array_compact(F.array(F.when(F.contains(c("event_type"), F.lit("c")), F.lit("contains_c"))))
    asked = review.requests(table(spark, d, "events"), F.lit("income"), c("event_type"), F.create_map(F.to_date("ts").cast("string"), c("value")), reasons, ["event_id"])
    return review.suggestions(review.reviewed(asked, ["event_id"]), ["event_id"]).select("event_id", "label", "confidence")


@query("""SELECT l_orderkey, CAST(v[1] AS BIGINT) AS v1, CAST(v[2] AS BIGINT) AS v2, CAST(v[3] AS BIGINT) AS v3 FROM (SELECT l_orderkey, CASE WHEN len(a) >= 3 THEN a[-3:] ELSE a END AS v FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1))""")
def q55_fit_columns(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    v = N.fit_columns(F.col("a.l_partkey"), 3)
    return a.select("l_orderkey", *[v[i].alias(f"v{i + 1}") for i in range(3)])


@query()
def q56_row_machine(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a statement: labels, numbers, or both, by line."""
    l = table(spark, d, "lineitem")  # noqa: E741
    number, label = F.format_number("l_quantity", 0), F.concat(F.lit("part "), F.lower("l_returnflag"))
    k = F.col("l_partkey") % 3
    tokens = F.when(k == 0, F.array(label, number)).when(k == 1, F.array(label)).otherwise(F.array(number))
    lines = l.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag").alias("at"), tokens.alias("tokens"))
    return M.row_machine(lines, ["l_orderkey"], "at", "tokens", 2).select("l_orderkey", "order_index", "label", F.array_join(F.transform("values", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), "|").alias("cells"))


@query("SELECT p_type, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN 'Net ' || p_type ELSE p_type END AS p_type FROM part) GROUP BY 1")
def q58_label_trim(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size") % 3
    raw = F.when(s == 0, F.concat("p_type", F.lit(" (amortized"))).when(s == 1, F.concat(F.lit("Net "), "p_type", F.lit(", and of;"))).otherwise(F.concat("p_type", F.lit(", respectively")))
    return table(spark, d, "part").select(L.trimmed(raw)["label"].alias("p_type")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
