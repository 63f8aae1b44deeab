"""From the facts of many reports to fiscal series and measurements.

Facts: ``by`` (whose reports), statement, canonical, label, level, order_index, column, raw_label,
duration, period_end (text), value, source, seq (order of ingestion). A key of a period is
period_end (date), duration and months.

Facts become values by line and period in one grouping and one window, and are written. What a fiscal year is, and
which period fills which slot of it, follows from the list of periods of one ``by``: a short array, on which array
functions do all the counting, so the calendar costs two small shuffles. Values then meet their slots in one join,
and lines their years in one grouping; everything a later step needs travels along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import describe as D
from tallyframe.functions import periods as R
from tallyframe.functions.text import let
from tallyframe.operators import series as S
from tallyframe.tables import written

KEY = ["period_end", "duration", "months"]
ISSUES = ["statement", "line", "issue", "period", "detail"]
STATEMENTS = ["balance", "income", "cash"]


def ingested(facts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Values by line and period (the last one that is not null) with their line's attributes (of the latest period) and least seq, written; and an issue for each column without a date."""
    end = R.period_end(F.coalesce(F.nullif("period_end", F.lit("")), F.nullif("column", F.lit("")), "raw_label"))
    dated = facts.withColumn("_end", end).withColumn("months", R.months_of(F.coalesce("raw_label", F.lit("")), F.col("duration")))
    lost = dated.filter("_end is null").select(*by, "statement", F.col("canonical").alias("line"), F.lit("missing-period").alias("issue"), F.col("column").alias("period"), F.lit("Could not parse period end date").alias("detail"))
    good = dated.filter("_end is not null").drop("period_end").withColumnRenamed("_end", "period_end")
    one = good.groupBy(*by, "statement", F.lower("canonical").alias("line"), *KEY).agg(
        F.max_by(F.struct("value", "source"), F.when(F.col("value").isNotNull(), F.col("seq"))).alias("v"), F.min("seq").alias("seq"),
        F.max(F.struct("period_end", "seq", "label", "level", "order_index")).alias("s"),
    )
    line = Window.partitionBy(*by, "statement", "line")
    whole = one.withColumn("s", F.max("s").over(line)).withColumn("line_seq", F.min("seq").over(line))
    return written(whole.select(*by, "statement", "line", *KEY, "v.*", "seq", "line_seq", "s.label", "s.level", "s.order_index"), "values"), lost


def period_keys(values: DataFrame, by: list[str]) -> DataFrame:
    """by, keys: the periods that the statements of each ``by`` have, an array of statement, period_end, duration, months, first (seq)."""
    keys = values.filter(F.year("period_end") >= 1900).groupBy(*by, "statement", *KEY).agg(F.min("seq").alias("first"))
    return keys.groupBy(*by).agg(F.collect_list(F.struct("statement", *KEY, "first")).alias("keys"))


def _mode(pairs: Column) -> Column:
    """The most frequent ``v`` of an array of (v, first); ties to the one seen first."""
    kinds = F.array_distinct(F.transform(pairs, lambda p: p["v"]))

    def weight(v: Column) -> Column:
        own = F.filter(pairs, lambda p: p["v"] == v)
        return F.struct(F.size(own).alias("n"), (-F.array_min(F.transform(own, lambda p: p["first"]))).alias("first"), v.alias("v"))

    return F.array_max(F.transform(kinds, weight))["v"]


def fiscal_year(keys: DataFrame) -> DataFrame:
    """``keys`` with fy_month, fy_day: the most frequent month in which years end, and the most frequent day of balances in it; ties to the first seen."""

    def flow_month(k: Column) -> Column:
        m = F.month(k["period_end"])
        ytd = F.when((k["duration"] == "ytd") & (k["months"] > 0), F.pmod(m - k["months"] - 1, F.lit(12)) + 1)
        return F.struct(ytd.when((k["duration"] == "annual") & (k["months"] == 12), m).alias("v"), k["first"].alias("first"))

    points = F.filter("keys", lambda k: k["duration"] == "point")
    flows = F.filter(F.transform("keys", flow_month), lambda p: p["v"].isNotNull())
    named = keys.withColumn("_flows", flows).withColumn("_points", points)
    months = F.transform("_points", lambda k: F.struct(F.month(k["period_end"]).alias("v"), k["first"].alias("first")))
    named = named.withColumn("fy_month", F.coalesce(_mode(F.col("_flows")), _mode(months), F.lit(12)))
    days = F.transform(F.filter("_points", lambda k: F.month(k["period_end"]) == F.col("fy_month")), lambda k: F.struct(F.dayofmonth(k["period_end"]).alias("v"), k["first"].alias("first")))
    return named.withColumn("fy_day", F.coalesce(_mode(days), F.lit(31))).drop("_flows", "_points")


def _clamped(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, F.least(day, F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))))


def calendar(years: DataFrame) -> DataFrame:
    """``years`` with ends: years that annual columns name, and balance dates in the last month."""

    def end(k: Column) -> Column:
        point = F.when((k["duration"] == "point") & (F.month(k["period_end"]) == F.col("fy_month")), k["period_end"])
        return F.when(k["duration"] == "annual", _clamped(F.year(k["period_end"]), F.col("fy_month"), F.col("fy_day"))).otherwise(point)

    return years.withColumn("ends", F.array_distinct(F.array_compact(F.transform("keys", end))))


def slot_keys(keys: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """by, statement, fy_end, slot (q1.., y1.., fy), the period key in it and at (dates of the year's slots), written; and an issue for each period without a quarter.

    A period belongs to the first year end that its own does not pass, if that is at most 400 days after it. Of several
    periods in a slot the first by date counts, of annual ones the last.
    """
    state = calendar(fiscal_year(keys))
    own_end = lambda k: R.fiscal_year_end(k["period_end"], F.col("fy_month"), F.col("fy_day"))
    annual = {s: F.transform(F.filter("keys", lambda k: (k["duration"] == "annual") & (k["statement"] == F.lit(s))), own_end) for s in STATEMENTS}  # noqa: B023
    state = state.select(*by, "keys", "fy_month", "fy_day", *[F.array_union("ends", annual[s]).alias(f"_known_{s}") for s in STATEMENTS])

    def placed(k: Column) -> Column:
        known = reduce(lambda other, s: F.when(k["statement"] == s, F.col(f"_known_{s}")).otherwise(other), STATEMENTS, F.array().cast("array<date>"))

        def within(own: Column) -> Column:
            first = F.array_min(F.filter(known, lambda e: (e >= own) & (F.datediff(e, k["period_end"]) <= 400)))
            return F.when(k["duration"] == "annual", own).otherwise(F.coalesce(first, own))

        return F.struct(*[k[c].alias(c) for c in ("statement", *KEY, "first")], let(own_end(k), within).alias("fy_end"))

    each = state.select(*by, F.explode(F.transform("keys", placed)).alias("_k")).select(*by, "_k.*")
    each = each.withColumn("q", F.when(F.col("duration") != "annual", R.quarter_index(F.col("duration"), F.col("months"), F.col("period_end"), F.col("fy_end"))))
    lost = each.filter("q is null and duration <> 'annual'").select(*by, "statement", F.lit("").alias("line"), F.lit("quarter-index").alias("issue"), D.date_text(F.col("period_end")).alias("period"), F.concat(F.lit("Unable to map duration "), "duration").alias("detail"))
    slot = F.when(F.col("duration") == "annual", "fy").when(F.col("duration") == "ytd", F.concat(F.lit("y"), F.col("q").cast("string"))).otherwise(F.concat(F.lit("q"), F.col("q").cast("string")))
    far = F.datediff("period_end", F.to_date(F.lit("1970-01-01")))
    order = F.struct(F.when(F.col("duration") == "annual", -far).otherwise(far), "first")
    # these groups lie within those of ``by``: no shuffle
    one = each.withColumn("slot", slot).filter("slot is not null").groupBy(*by, "statement", "fy_end", "slot").agg(F.min_by(F.struct(*KEY), order).alias("_k")).select(*by, "statement", "fy_end", "slot", "_k.*")
    dates = F.map_from_entries(F.collect_list(F.struct("slot", "period_end")).over(Window.partitionBy(*by, "statement", "fy_end")))
    return written(one.withColumn("at", dates), "slots"), lost


def slotted(values: DataFrame, slots: DataFrame, by: list[str]) -> DataFrame:
    """by, statement, line, fy_end, a struct (value, months, period_end, source) for each slot that the line fills, at, and the line's attributes."""
    at = slots.select(*[F.col(c).alias(f"s_{c}") for c in [*by, "statement", *KEY]], "fy_end", "slot", F.map_entries("at").alias("at"))
    met = values.filter("value is not null").join(at, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in [*by, "statement", *KEY]])
    cell = F.struct("value", "months", "period_end", "source")
    filled = met.groupBy(*by, "statement", "line", "fy_end").agg(*[F.max(F.when(F.col("slot") == s, cell)).alias(s) for s in S.SLOTS], F.first("at").alias("at"), F.first(F.struct("line_seq", "label", "level", "order_index")).alias("_l"))
    return filled.withColumn("at", F.map_from_entries("at")).select(*by, "statement", "line", "fy_end", *S.SLOTS, "at", "_l.*")


def _date_of(n: int) -> Column:
    """When the n-th quarter ended: by its own column, that of the year to date, else by the year's end."""
    return F.coalesce(F.col("at")[f"q{n}"], F.col("at")[f"y{n}"], F.add_months("fy_end", 3 * n - 12))


def fiscal_series(wide: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """q1..q4 and fy of every line and fiscal year (with what ``slotted`` says of both), and an issue for each quarter that lacks those before it."""
    keep = [*by, "statement", "line", "fy_end", "at", "line_seq", "label", "level", "order_index"]
    flat = wide.select(*keep, *[F.col(f"{s}.value").alias(s) for s in S.SLOTS])
    made = S.derive_series(flat)
    balance = F.col("statement") == "balance"
    out = made.withColumn("fy", F.when(balance, F.coalesce("fy", "q4")).otherwise(F.col("fy")))
    q1 = F.coalesce("q1", "y1")
    lacks = [(2, F.col("q2").isNull() & F.col("y2").isNotNull() & q1.isNull()), (3, F.col("q3").isNull() & F.col("y3").isNotNull() & (q1.isNull() | F.coalesce(F.col("q2"), F.col("y2") - q1).isNull()))]
    each = flat.withColumn("q", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lacks]))))
    lost = each.select(*by, "statement", F.col("label").alias("line"), F.lit("ytd-backfill").alias("issue"), R.describe_quarter(F.col("fy_end"), F.col("q")).alias("period"), F.lit("Missing prior quarters prevents YTD backfill").alias("detail"))
    return out, lost


def _can_difference(now: str, before: str) -> Column:
    """Three months apart: by months if both are known, else by calendar."""
    a, b = F.col(f"{now}.months"), F.col(f"{before}.months")
    apart = F.when(a.isNotNull() & b.isNotNull(), a - b).otherwise(R.calendar_months(F.col(f"{now}.period_end"), F.col(f"{before}.period_end")))
    return (F.col(f"{now}.period_end") > F.col(f"{before}.period_end")) & (apart == 3)


def measurements(values: DataFrame, slots: DataFrame, by: list[str]) -> DataFrame:
    """by, statement, label, duration_key, period_end, duration, months, value, derived, seq: what was reported and what follows from it.

    Quarters that lack are differences of year-to-date figures three months apart, else less the quarters
    before; the fourth also of the year's figure; years are their own, a year to date of twelve months, or
    four quarters. Balances are points as reported.
    """
    keys = [*by, "statement", "line"]
    wide = slotted(values.filter("statement <> 'balance'"), slots, by)
    v = lambda s: F.col(f"{s}.value")
    # each value is made once and named, then used by those after it
    wide = wide.withColumn("v1", F.coalesce(v("q1"), F.when(F.col("y1.months").isNull() | (F.col("y1.months") == 3), v("y1"))))
    wide = wide.withColumn("v2", F.coalesce(v("q2"), F.when(_can_difference("y2", "y1"), v("y2") - v("y1")), v("y2") - F.col("v1")))
    wide = wide.withColumn("v3", F.coalesce(v("q3"), F.when(_can_difference("y3", "y2"), v("y3") - v("y2")), v("y3") - (F.col("v1") + F.col("v2"))))
    three = F.col("v1") + F.col("v2") + F.col("v3")
    by_ytd = F.when(_can_difference("y4", "y3"), v("y4") - v("y3"))
    by_year = F.when(F.col("y3").isNotNull(), v("fy") - v("y3")).otherwise(v("fy") - three)
    wide = wide.withColumn("v4", F.coalesce(v("q4"), by_ytd, by_year, v("y4") - three))
    at4 = F.when(v("q4").isNull() & by_ytd.isNull() & by_year.isNotNull(), F.col("fy.period_end")).otherwise(_date_of(4))
    four = three + F.col("v4")
    long_year = F.coalesce(F.col("y4.months") > 0, F.lit(False))
    annual = F.coalesce(v("fy"), F.when(long_year, v("y4")), four)
    annual_end = F.when(v("fy").isNotNull(), F.col("fy.period_end")).when(long_year, F.col("y4.period_end")).otherwise(F.col("fy_end"))
    row = lambda kind, months, end, value, derived, first: F.struct(F.lit(kind).alias("duration"), months.alias("months"), end.alias("period_end"), value.alias("value"), derived.alias("derived"), F.lit(first).alias("rank"))
    quarters = [row("quarter", F.coalesce(F.col(f"q{n}.months"), F.lit(3)), F.coalesce(F.col(f"q{n}.period_end"), at4 if n == 4 else _date_of(n)), F.col(f"v{n}"), v(f"q{n}").isNull(), n) for n in (1, 2, 3, 4)]
    made = wide.select(*keys, "line_seq", F.explode(F.array(*quarters, row("annual", F.coalesce(F.col("fy.months"), F.lit(12)), annual_end, annual, v("fy").isNull(), 5))).alias("_m")).select(*keys, "line_seq", "_m.*").filter("value is not null")
    kind = F.when(F.col("statement") == "balance", "point").otherwise(F.coalesce(F.nullif(F.lower("duration"), F.lit("")), F.lit("unknown")))
    raw = values.filter("value is not null").filter(F.year("period_end") >= 1900).select(*keys, "line_seq", kind.alias("duration"), "months", "period_end", "value", F.lit(False).alias("derived"), F.lit(0).alias("rank"))
    every = raw.unionByName(made).withColumn("duration_key", R.duration_key(F.col("duration"), F.col("months")))
    one = every.groupBy(*keys, "duration_key", "period_end").agg(F.max_by(F.struct("duration", "months", "value", "derived"), "rank").alias("_m"), F.min("line_seq").alias("seq"))
    return one.select(*by, "statement", F.col("line").alias("label"), "duration_key", "period_end", "_m.*", "seq")


def frames(series: DataFrame, by: list[str]) -> DataFrame:
    """by, statement, order_index, level, line, position, column, value: the table of a statement, lines and fiscal years in order; ``workbooks.series_sheets`` makes it wide."""
    cells = [F.struct(F.lit(n).alias("n"), R.quarter_label(_date_of(n)).alias("column"), F.col(f"q{n}").alias("value")) for n in (1, 2, 3, 4)]
    cells.append(F.struct(F.lit(5).alias("n"), F.concat(F.lit("FY "), F.year("fy_end").cast("string")).alias("column"), F.col("fy").alias("value")))
    each = series.select(*by, "statement", "order_index", "level", F.col("label").alias("line"), "fy_end", F.explode(F.array(*cells)).alias("_c"))
    return each.select(*by, "statement", "order_index", "level", "line", F.struct("fy_end", "_c.n").alias("position"), "_c.column", "_c.value")


def diagnostics(*issues: DataFrame) -> DataFrame:
    """All issues, with their five columns also where there are none."""
    out = issues[0]
    for more in issues[1:]:
        out = out.unionByName(more)
    return out
