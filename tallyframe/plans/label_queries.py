"""Queries over labels that rules rename, drop and merge until nothing changes, and over rules as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import rewrites as W
from tallyframe.operators import relabel, rules
from tallyframe.plans.registry import query, table

_LABELS = [
    "Restricted cash", "Current assets", "Affiliate", "Income before equity in earnings of unconsolidated affiliate", "Amounts", "Shares used", "Net sales", "Inventories",
    "Activities", "Other current items", "Net income attributable to Amkor", "Basic",
]
_ROWS = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS o, l_suppkey % 3 AS level, l_partkey % 12 AS kind, CASE WHEN l_linestatus = 'O' OR l_partkey % 5 = 0 THEN l_quantity END AS v FROM lineitem"
#: Rounds that the SQL spells out; a statement at rest stays as it is.
_ROUNDS = 7


def _round_sql(source: str, n: int) -> str:
    """CTEs of one round over the rows of ``source``: names, sections level by level, numbers of fragments, and what goes."""
    above = "OVER (PARTITION BY doc ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def section(level: int, rows: str) -> str:
        parent = f"last_value(CASE WHEN NOT out AND level < {level} THEN {{'l': level, 't': name}} END IGNORE NULLS) {above}" if level else "{'l': -1, 't': ''}"
        return f"""SELECT doc, o, level, raw, v, out, CASE WHEN level = {level} AND NOT out AND name = 'Restricted cash' THEN
          CASE WHEN p.l = {level} - 1 AND contains(lower(p.t), 'current') THEN 'Restricted cash (current)' WHEN level = 0 THEN 'Restricted cash (non-current)' ELSE name END ELSE name END AS name
          FROM (SELECT *, {parent} AS p FROM {rows})"""

    up = lambda k: f"last_value(CASE WHEN level < {k} AND contains(lower(name), 'income before equity in earnings') THEN {{'o': o, 'e': v IS NULL}} END IGNORE NULLS) {above}"
    return f"""
    a{n} AS (SELECT doc, o, level, raw, v, v IS NULL AND raw IN ('Amounts', 'Activities', 'Affiliate') AS out, CASE WHEN name = 'Basic' THEN CASE WHEN v <= 10 THEN 'Earnings per share - Basic' ELSE 'Shares used - Basic' END ELSE name END AS name FROM {source}),
    b{n} AS ({section(0, f'a{n}')}), c{n} AS ({section(1, f'b{n}')}), d{n} AS ({section(2, f'c{n}')}),
    e{n} AS (SELECT *, CASE WHEN name = 'Affiliate' AND v IS NOT NULL THEN CASE WHEN level = 1 AND p1.e THEN p1.o WHEN level = 2 AND p2.e THEN p2.o END END AS t FROM (SELECT *, {up(1)} AS p1, {up(2)} AS p2 FROM d{n})),
    f{n} AS (SELECT *, min(CASE WHEN t IS NOT NULL THEN {{'o': o, 'v': v}} END) OVER (PARTITION BY doc, coalesce(t, o)) AS f FROM e{n}),
    g{n} AS (SELECT doc, o, level, raw, name, out OR coalesce(t IS NOT NULL AND f.o = o, false) AS gone, CASE WHEN t IS NULL AND f IS NOT NULL THEN f.v ELSE v END AS v FROM f{n}),
    h{n} AS (SELECT *, CASE WHEN gone THEN 0 WHEN v IS NULL AND count(*) OVER (PARTITION BY doc, lower(name)) > 1 THEN 1 WHEN lower(name) = 'amounts' THEN 2 WHEN v IS NULL AND name IN ('Shares used', 'Net income attributable to Amkor') THEN 3 ELSE 4 END AS k FROM g{n}),
    r{n} AS (SELECT doc, o, level, raw, name, v FROM (SELECT *, min(k) OVER (PARTITION BY doc) AS least FROM h{n}) WHERE k = 4 OR k > least)"""


_SQL = f"""WITH r0 AS (SELECT doc, o, level, list_value({', '.join(f"'{x}'" for x in _LABELS)})[kind + 1] AS raw, raw AS name, v FROM ({_ROWS})),
 {', '.join(_round_sql(f'r{n - 1}', n) for n in range(1, _ROUNDS + 1))}
 SELECT doc, CAST(o AS BIGINT) AS o, CAST(level AS INT) AS level, name AS label, v, count(*) OVER (PARTITION BY doc, lower(name)) > 1 AS doubted FROM r{_ROUNDS}"""


@query(_SQL)
def q71_settled_labels(spark: SparkSession, d: str) -> DataFrame:
    """Orders as statements: labels by section, fragments merged into their parents, captions and empty copies gone."""
    rows = spark.sql(_ROWS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("kind") + 1).cast("int"))
    given = rows.select("doc", F.lit("income").alias("statement"), F.col("o").cast("long").alias("o"), F.col("level").cast("int").alias("level"), label.alias("label"), label.alias("raw"), F.array("v").alias("values"))
    found = relabel.settled(given, ["doc"], "o")
    return found.select("doc", "o", "level", "label", F.col("values")[0].alias("v"), F.array_contains("reasons", "duplicate_after_normalization").alias("doubted"))


def sample(tests: list[str]) -> tuple[str, str]:
    """A label and a printed line that a rule's tests hold for."""
    label, line = "", ""
    for t in tests:
        if t.startswith("raw:"):
            line += f" {t[4:]}"
        elif t[0] == "=":
            label = t[1:]
        elif t[0] == "^":
            label = f"{t[1:]} of it{label}"
        elif t[0] != "!":
            label = f"{label} {t}".strip()
    return label.capitalize(), line or label


_SAMPLES = [sample(tests) for _, found in (("cleaned", W.CLEANED), ("canonical", W.CANONICAL)) for tests, _ in found] + [("Own label", "x"), ("Other label", "own line"), ("Nothing fits", "")]
#: A user's rules: one in place of a usual one, one before all, one behind.
_OWN = [(10 * len(W.CANONICAL), "equals", "other, net", "Other items"), (5, "matches", r"^own\s+label$", "Named by its form"), (1000, "printed", "own line", "Named by its line")]


def _sql(found: list[tuple[list[str], str]], own: bool) -> str:
    """The first rule that fits, as one CASE."""
    text = lambda t: "'" + t.replace("'", "''") + "'"
    kinds = {"^": lambda t: f"starts_with(lower(label), {text(t)})", "=": lambda t: f"lower(label) = {text(t)}", "!": lambda t: f"NOT contains(lower(label), {text(t)})"}

    def test(t: str) -> str:
        return f"contains(lower(raw), {text(t[4:])})" if t.startswith("raw:") else kinds[t[0]](t[1:]) if t[0] in kinds else f"contains(lower(label), {text(t)})"

    cases = [f"WHEN {' AND '.join(map(test, tests))} THEN {text(out)}" for tests, out in found]
    if own:
        cases = ["WHEN regexp_matches(lower(label), '^own\\s+label$') THEN 'Named by its form'", *cases[:-1], "WHEN lower(label) = 'other, net' THEN 'Other items'", "WHEN contains(lower(raw), 'own line') THEN 'Named by its line'"]
    return f"CASE {' '.join(cases)} ELSE label END"


_PAIRS = ", ".join("{'label': '%s', 'raw': '%s'}" % tuple(x.replace("'", "''") for x in s) for s in _SAMPLES)


@query(f"SELECT o_orderkey, {_sql(W.CLEANED, False)} AS cleaned, {_sql(W.CANONICAL, False)} AS canonical, {_sql(W.CANONICAL, True)} AS own FROM (SELECT o_orderkey, s.label AS label, s.raw AS raw FROM (SELECT o_orderkey, ([{_PAIRS}])[o_orderkey % {len(_SAMPLES)} + 1] AS s FROM orders))")
def q78_label_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of both tables at work on the orders' labels, and a user's rules among them."""
    pairs = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("raw")) for a, b in _SAMPLES])
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(pairs, (F.col("o_orderkey") % len(_SAMPLES) + 1).cast("int")).alias("s")).select("o_orderkey", "s.*")
    usual = rules.table_of(spark, W.CANONICAL)
    own = rules.with_own(usual, spark.createDataFrame(_OWN, rules.SCHEMA))
    label, raw = F.col("label"), F.col("raw")
    return rows.select("o_orderkey", W.by_rules(label, rules.listed(rules.table_of(spark, W.CLEANED))).alias("cleaned"), W.by_rules(label, rules.listed(usual), raw).alias("canonical"), W.by_rules(label, rules.listed(own), raw).alias("own"))
