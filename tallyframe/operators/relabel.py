"""Labels of statement rows brought to rest: renamed, flagged, dropped and merged again until nothing changes.

One round names every row anew from its label, printed line, values and the section above it, then removes
the first of these kinds that a statement has any of: rows that the printed line or the new name gives up, and
fragments whose numbers moved to an empty row above; empty rows whose name stands twice; captions; empty
captions. A statement that lost a row goes to the next round with what is left; one that lost none is
done. Rounds are windows over the statements' rows, dealt by statement once; only what still
changes is read again, and each round is written, so plans do not grow. A statement of n rows takes
n + 1 rounds at most, in practice a handful.

A row's name depends on the rows above only through the name of its section, which is a row with a
lower level, so the names of one level are settled before those of the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import labels as L
from tallyframe.functions import normalise as M
from tallyframe.functions import rewrites as W
from tallyframe.operators.facts import small
from tallyframe.operators.rules import Rules, listed
from tallyframe.tables import written

LEVELS = 3


def _named(rows: DataFrame, aliases: DataFrame | None, statement: str, rules: Rules) -> DataFrame:
    """``_name`` and ``_reasons`` of every row by itself, ``_out`` where it is given up."""
    # a column for each value that is used more than once: inside lambdas Spark works a repeated expression out anew
    made = rows.withColumn("_empty", ~F.exists("values", lambda v: v.isNotNull())).withColumn("_early", M.dropped_before(F.col("raw"), F.col("_empty")))
    made = made.withColumn("_n", M.normalised(F.col(statement), F.col("label"), F.col("raw"), F.col("_empty"), rules))
    made = made.withColumn("_said", F.col("_n.label")).withColumn("_own", L.canonical(F.col("_said")))
    if aliases is not None:
        made = made.join(aliases, (F.lower("_own") == F.col("_key")) & (F.col(statement) == F.col("_of")), "left").withColumn("_own", F.coalesce("_alias", "_own"))
    changed = F.when((F.col("_own") != "") & (F.col("_own") != F.col("_said")), F.array(F.lit("alias_applied"))).otherwise(F.array().cast("array<string>"))
    made = made.withColumn("_reasons", F.array_distinct(F.concat("_n.reasons", changed)))
    first = lambda *columns: F.coalesce(*[F.when(F.btrim(c) != "", F.btrim(c)) for c in columns], F.lit(""))
    made = made.withColumn("_first", first(F.col("_own"), F.col("_said"), F.col("raw")))
    made = made.withColumn("_name", M.final_name(F.col("_first"), F.col("raw"), F.col("values")))
    # a row of values without any name keeps its place in the table as its name
    name = F.when(F.col("_name") != "", F.col("_name")).when(~F.col("_empty"), first(F.col("label"), F.col("raw"), F.concat(F.lit("Line "), F.col("_nth")))).otherwise("")
    made = made.withColumn("_name", F.when(F.col("_early"), F.col("label")).otherwise(name))
    given_up = F.col("_early") | (F.col("_empty") & F.lower("_name").isin("", "activities", "activity"))
    return made.withColumn("_out", given_up).drop("_n", "_said", "_own", "_first", "_early", "_key", "_of", "_alias")


def _sections(rows: DataFrame, above) -> DataFrame:
    """Names by section, level by level: the last row above that counts and has a lower level, if it is just one lower."""
    for n in range(LEVELS):
        parent = F.lit(None).cast("string")
        if n:
            last = F.last(F.when(~F.col("_out") & (F.col("level") < n), F.struct(F.col("level").alias("l"), F.col("_name").alias("t"))), ignorenulls=True).over(above)
            parent = F.when(last["l"] == n - 1, last["t"])
        rows = rows.withColumn("_parent", parent).withColumn("_name", F.when((F.col("level") == n) & ~F.col("_out"), M.by_parent(F.col("_name"), F.col("level"), F.col("_parent"))).otherwise(F.col("_name"))).drop("_parent")
    return rows


def _merged(rows: DataFrame, by: list[str], order: str, above) -> DataFrame:
    """Numbers of fragments move to the nearest fitting row above with a lower level, if it has none; ``_moved`` fragments go."""
    low = F.lower(F.btrim("_name"))
    target = F.lit(None).cast(rows.schema[order].dataType)
    for child, patterns in M.FRAGMENTS.items():
        fits = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in patterns])
        for n in range(1, LEVELS):
            last = F.last(F.when((F.col("level") < n) & fits, F.struct(F.col(order).alias("o"), F.col("_empty").alias("e"))), ignorenulls=True).over(above)
            target = F.when((low == child) & (F.col("level") == n) & ~F.col("_empty") & last["e"], last["o"]).otherwise(target)
    rows = rows.withColumn("_to", target)
    family = Window.partitionBy(*by, "_family")
    rows = rows.withColumn("_family", F.coalesce("_to", order))
    first = F.min(F.when(F.col("_to").isNotNull(), F.struct(F.col(order).alias("o"), F.col("values").alias("v")))).over(family)
    rows = rows.withColumn("_first", first).withColumn("_moved", F.col("_to").isNotNull() & (F.col("_first.o") == F.col(order)))
    return rows.withColumn("values", F.when(F.col("_to").isNull() & F.col("_first").isNotNull(), F.col("_first.v")).otherwise(F.col("values"))).drop("_to", "_family", "_first")


def _round(rows: DataFrame, by: list[str], order: str, statement: str, aliases: DataFrame | None, rules: Rules) -> DataFrame:
    """All rows with their new label; ``gone`` ones leave, ``again``: their statement lost a row."""
    above = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole, same = Window.partitionBy(*by), Window.partitionBy(*by, "_low")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("string"))
    rows = _merged(_sections(_named(rows, aliases, statement, rules), above), by, order, above)
    rows = rows.withColumn("_low", F.lower("_name")).withColumn("_empty", ~F.exists("values", lambda v: v.isNotNull())).withColumn("_copies", F.count(F.lit(1)).over(same))
    kinds = [F.col("_out") | F.col("_moved"), F.col("_empty") & (F.col("_copies") > 1), F.col("_low").isin(W.ALWAYS_DROPS), F.col("_empty") & F.col("_low").isin(W.EMPTY_DROPS)]
    kind = F.coalesce(*[F.when(k, i) for i, k in enumerate(kinds)], F.lit(len(kinds)))
    rows = rows.withColumn("_kind", kind).withColumn("_least", F.min("_kind").over(whole))
    again = F.col("_least") < len(kinds)
    core = F.array_except(W.kept_reasons(F.col("_name"), F.col("_reasons")), F.array(F.lit("alias_applied")))
    core = F.when(F.col("_copies") > 1, F.concat(core, F.array(F.lit("duplicate_after_normalization")))).otherwise(core)
    keep = [c for c in rows.columns if not c.startswith("_") and c not in ("label", "reasons")]
    return rows.select(*keep, F.col("_name").alias("label"), core.alias("reasons"), (again & (F.col("_kind") == F.col("_least"))).alias("_gone"), again.alias("_again"))


def settled(rows: DataFrame, by: list[str], order: str = "order_index", statement: str = "statement", aliases: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """``rows`` whose labels no round changes any more, with ``reasons`` to doubt a label (empty: none).

    ``rows``: by, order (unique in a statement), statement, level (int from 0), label, raw (the printed line), values (array of double),
    and any other columns, which stay with their row (names that begin with an underscore are for this function).
    ``aliases``: statement, key, value; of equal keys the last by value counts. ``rules``: a table of naming rules in place of the usual ones. Null labels and lines count as empty, null
    levels as 0, a null or empty array of values as a row without values; rows with equal order keep any order; statements
    without rows and an empty table give nothing.
    """
    start = rows.withColumn("level", F.coalesce("level", F.lit(0)).cast("int")).withColumn("label", F.coalesce("label", F.lit(""))).withColumn("raw", F.coalesce("raw", F.lit("")))
    start = start.withColumn("values", F.coalesce("values", F.array().cast("array<double>")))
    start = start.filter(~M.footnote_row(F.col("label"), ~F.exists("values", lambda v: v.isNotNull())))
    known = None
    if aliases is not None:
        known = small(aliases.groupBy(F.col("statement").alias("_of"), F.lower(L.canonical(F.col("key"))).alias("_key")).agg(F.max("value").alias("_alias")))
    chosen = W.CANONICAL if rules is None else listed(rules)
    now, done = start, []
    while True:
        out = written(_round(now, by, order, statement, known, chosen), "relabelled")
        done.append(out.filter(~F.col("_again")).drop("_gone", "_again"))
        left = out.filter(F.col("_again") & ~F.col("_gone")).drop("_gone", "_again", "reasons")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        now = left


def suspects(rows: DataFrame) -> DataFrame:
    """Rows of ``settled`` that have a reason to be doubted."""
    return rows.filter(F.size("reasons") > 0)
