"""Batch certification: identities over the merged measurements of many reports.

Measurements: ``by`` (what a batch is), statement, label, duration_key, period_end, duration,
months, value, derived, seq. Each check takes its lines by role, lays their measurements out by
period and gives one row a batch: check, result, details. PASS needs every comparison to hold
and none to lack data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import describe as D
from tallyframe.operators import series
from tallyframe.tables import written

TOLERANCE = 1e-6
# Statement, role and the label pattern of its lines.
ROLES = [
    ("balance", "assets", r"total assets"),
    ("balance", "liabilities", r"total liabilities"),
    ("balance", "equity", r"total stockholders|total shareholders"),
    ("balance", "bs_cash", r"cash and cash equivalents"),
    ("cash", "begin", r"beginning cash and cash equivalents"),
    ("cash", "roll", r"^(?:increase|decrease).*cash and cash equivalents"),
    ("cash", "end", r"ending cash and cash equivalents"),
    ("cash", "cf_net", r"^net income"),
    ("cash", "cfo", r"^net cash .*operating activities"),
    ("cash", "cfi", r"^net cash .*investing activities"),
    ("cash", "cff", r"^net cash .*financing activities"),
    ("cash", "fx", r"effect of .*exchange"),
    ("cash", "change", r"increase|decrease in cash and cash equivalents"),
    ("income", "is_net", r"^net income"),
    ("income", "revenue", r"^net revenue|^revenue|^sales$"),
    ("income", "cost", r"^cost of revenue|^cost of sales"),
    ("income", "gross", r"^gross profit"),
    ("income", "opex", r"^total operating expenses"),
    ("income", "opinc", r"^operating income"),
    ("income", "other", r"other income|interest and other income"),
    ("income", "pretax", r"income before"),
    ("income", "tax", r"^provision|^benefit|income taxes"),
]
BALANCE = "Balance Sheet equality (Assets = Liabilities + Equity)"
ROLL = "Cash roll-through (Beg + Δ = End) & tie to BS cash"
NET = "Net income link (IS Net income vs CF Net income)"
INCOME = "IS cross-footing (subtotals)"
CASH = "CF cross-footing (Δ cash = CFO + CFI + CFF + FX)"
NAMES = [r for _, r, _ in ROLES]


def chosen_lines(store: DataFrame, by: list[str]) -> DataFrame:
    """by, role, statement, label: for each role the fitting line with the most data, ten points a quarter; ties to the first."""
    lines = store.groupBy(*by, "statement", "label").agg((10 * F.sum((F.col("duration_key") == "quarter").cast("long")) + F.count(F.lit(1))).alias("score"), F.min("seq").alias("first"))
    fits = F.array_compact(F.array(*[F.when((F.col("statement") == s) & F.col("label").rlike("(?i)" + p), F.lit(r)) for s, r, p in ROLES]))
    each = lines.withColumn("role", F.explode(fits))
    return each.groupBy(*by, "role").agg(F.max_by(F.struct("statement", "label"), F.struct(F.col("score"), -F.col("first"))).alias("_l")).select(*by, "role", "_l.*")


def laid_out(store: DataFrame, by: list[str]) -> DataFrame:
    """by, duration_key, period_end and for each role a struct of value, derived, duration, months (null: no measurement)."""
    met = store.join(chosen_lines(store, by), [*by, "statement", "label"])
    known = met.filter(F.when(F.col("statement") == "balance", F.col("duration_key") == "point").otherwise(F.col("duration_key") != "unknown"))
    return known.groupBy(*by, "duration_key", "period_end").pivot("role", NAMES).agg(F.min_by(F.struct("value", "derived", "duration", "months"), "seq"))


def _some(roles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(r).isNotNull() for r in roles])


def _every(roles: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in roles])


def _derived(roles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{r}.derived"), F.lit(False)) for r in roles])


def _v(role: str) -> Column:
    return F.col(f"{role}.value")


def _ok(delta: Column) -> Column:
    return F.abs(delta) <= TOLERANCE


def _verdict(rows: DataFrame, by: list[str], check: str, order: list[str]) -> DataFrame:
    """by, check, result, details of rows with ``ok``, ``detail`` and ``order``."""
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "detail"))), lambda x: x["detail"]), "; ")
    return rows.groupBy(*by).agg(F.when(F.bool_and("ok"), "PASS").otherwise("CHECK").alias("result"), put.alias("details")).select(*by, F.lit(check).alias("check"), "result", "details")


def balance_check(wide: DataFrame, by: list[str]) -> DataFrame:
    """B1: assets against liabilities and equity at every date that any of them has."""
    roles = ["assets", "liabilities", "equity"]
    rows = wide.filter((F.col("duration_key") == "point") & _some(roles))
    delta, whole = _v("assets") - (_v("liabilities") + _v("equity")), _every(roles)
    said = F.concat(D.date_text(F.col("period_end")), F.lit(": "), F.when(whole, D.delta_text("", delta)).otherwise("insufficient data"))
    return _verdict(rows.select(*by, "period_end", F.when(whole, _ok(delta)).otherwise(False).alias("ok"), said.alias("detail")), by, BALANCE, ["period_end"])


def _without_overlap(wide: DataFrame, by: list[str], roles: list[str], relevant: Column | None = None) -> DataFrame:
    """Rows (duration_key, period_end null, ok false, detail) of duration keys that all roles have, but never at one date."""
    kept = wide if relevant is None else wide.filter(relevant)
    seen = kept.groupBy(*by, "duration_key").agg(*[F.max(F.col(r).isNotNull()).alias(f"_{r}") for r in roles], F.max(_every(roles)).alias("_all"))
    lost = seen.filter(" and ".join([*[f"_{r}" for r in roles], "not _all"]))
    name = F.when(F.col("duration_key") == "quarter", "Quarter").otherwise(F.upper("duration_key"))
    return lost.select(*by, "duration_key", F.lit(None).cast("date").alias("period_end"), F.lit(False).alias("ok"), F.concat(name, F.lit(": insufficient overlapping data")).alias("detail"))


def roll_check(wide: DataFrame, by: list[str], days: int = 3) -> DataFrame:
    """B2: beginning cash and change against ending cash; the end tied to the balance at its date, the beginning to the one within ``days`` of its start."""
    roles = ["begin", "roll", "end"]
    points = wide.filter((F.col("duration_key") == "point") & F.col("bs_cash").isNotNull()).select(*by, F.col("period_end").alias("at"), F.col("bs_cash").alias("cash"))
    rows = wide.filter(_every(roles)).withColumn("start", F.when(F.col("begin.months") > 0, F.add_months("period_end", -F.col("begin.months"))))
    at_end = points.select(*[F.col(c).alias(f"e_{c}") for c in by], F.col("at").alias("e_at"), F.col("cash").alias("at_end"))
    rows = rows.join(at_end, [F.col("period_end") == F.col("e_at"), *[F.col(c) == F.col(f"e_{c}") for c in by]], "left")
    starts = series.nearest_date(rows.filter("start is not null").select(*by, "start").distinct(), points, by, "start", "at", "cash", days)
    starts = starts.select(*[F.col(c).alias(f"s_{c}") for c in by], F.col("start").alias("s_start"), F.col("cash").alias("at_start"))
    rows = rows.join(starts, [F.col("start") == F.col("s_start"), *[F.col(c) == F.col(f"s_{c}") for c in by]], "left")
    roll, tie, open_ = _v("begin") + _v("roll") - _v("end"), _v("end") - _v("at_end"), _v("begin") - _v("at_start")
    said = [
        D.delta_text("roll", roll, _derived(roles)),
        F.when(F.col("at_end").isNull(), "missing BS cash at end").otherwise(D.delta_text("end tie", tie, _derived(["end", "at_end"]))),
        F.when(F.col("start").isNotNull(), F.when(F.col("at_start").isNull(), "missing BS cash at start").otherwise(D.delta_text("start tie", open_, _derived(["begin", "at_start"])))),
    ]
    ok = _ok(roll) & F.coalesce(_ok(tie), F.lit(False)) & (F.col("start").isNull() | F.coalesce(_ok(open_), F.lit(False)))
    head = D.describe_measure(F.col("end.duration"), F.col("end.months"), F.col("period_end"))
    told = rows.select(*by, "duration_key", "period_end", ok.alias("ok"), F.concat(head, F.lit(": "), F.concat_ws("; ", *said)).alias("detail"))
    return _verdict(told.union(_without_overlap(wide, by, roles)), by, ROLL, ["duration_key", "period_end"])


def net_check(wide: DataFrame, by: list[str]) -> DataFrame:
    """B3: net income of both statements where duration and date agree; quarters, years and year to date."""
    roles, key = ["is_net", "cf_net"], F.col("duration_key")
    relevant = key.isin("quarter", "annual") | key.startswith("ytd")
    delta = _v("is_net") - _v("cf_net")
    head = D.describe_measure(F.col("is_net.duration"), F.col("is_net.months"), F.col("period_end"))
    told = wide.filter(relevant & _every(roles)).select(*by, "duration_key", "period_end", _ok(delta).alias("ok"), F.concat(head, F.lit(": "), D.delta_text("", delta, _derived(roles))).alias("detail"))
    return _verdict(told.union(_without_overlap(wide, by, roles, relevant)), by, NET, ["duration_key", "period_end"])


def _sample(roles: list[str]) -> Column:
    """The period as its first measurement names it, else by its key."""
    first = F.coalesce(*[F.col(r) for r in roles])
    return F.when(first.isNotNull(), D.describe_measure(first["duration"], first["months"], F.col("period_end"))).otherwise(D.describe_key(F.col("duration_key"), F.col("period_end")))


def income_check(wide: DataFrame, by: list[str]) -> DataFrame:
    """B4: subtotals of the income statement; a period that one term of a subtotal has must have them all."""
    parts = [
        ("GP", ["revenue", "cost", "gross"], (_v("revenue") + _v("cost")) - _v("gross")),
        ("OI", ["gross", "opex", "opinc"], (_v("gross") - _v("opex")) - _v("opinc")),
        ("PT", ["opinc", "other", "pretax"], (_v("opinc") + _v("other")) - _v("pretax")),
        ("NI", ["pretax", "tax", "is_net"], (_v("pretax") + _v("tax")) - _v("is_net")),
    ]
    every = list(dict.fromkeys(r for _, roles, _ in parts for r in roles))
    said = [F.when(_every(roles), D.delta_text(tag, delta, _derived(roles))).when(_some(roles), f"insufficient data ({tag})") for tag, roles, delta in parts]
    held = reduce(lambda a, b: a & b, [F.when(_every(roles), _ok(delta)).otherwise(~_some(roles)) for _, roles, delta in parts])
    rows = wide.filter(_some(every)).select(*by, "period_end", "duration_key", held.alias("ok"), F.concat(_sample(every), F.lit(": "), F.concat_ws(", ", *said)).alias("detail"))
    return _verdict(rows, by, INCOME, ["period_end", "duration_key"])


def cash_check(wide: DataFrame, by: list[str]) -> DataFrame:
    """B5: the three activities and exchange, if any, against the change in cash."""
    roles = ["change", "cfo", "cfi", "cff"]
    keys = wide.groupBy(*[F.col(c).alias(f"k_{c}") for c in by], F.col("duration_key").alias("k_key")).agg(F.max(_some(roles)).alias("used")).filter("used")
    rows = wide.filter(_some([*roles, "fx"])).join(keys, [F.col("duration_key") == F.col("k_key"), *[F.col(c) == F.col(f"k_{c}") for c in by]], "left_semi")
    delta = (_v("cfo") + _v("cfi") + _v("cff") + F.coalesce(_v("fx"), F.lit(0.0))) - _v("change")
    whole = _every(roles)
    said = F.concat(_sample(roles), F.lit(": "), F.when(whole, D.delta_text("", delta, _derived([*roles, "fx"]))).otherwise("insufficient data"))
    return _verdict(rows.select(*by, "period_end", "duration_key", F.when(whole, _ok(delta)).otherwise(False).alias("ok"), said.alias("detail")), by, CASH, ["period_end", "duration_key"])


def _coverage(wide: DataFrame, store: DataFrame, by: list[str]) -> DataFrame:
    """by, check, reason: why a check cannot be made at all (null: it can)."""
    has = store.groupBy(*by).agg(*[F.max(F.col("statement") == s).alias(s) for s in ("balance", "income", "cash")])
    lines = wide.groupBy(*[F.col(c).alias(f"w_{c}") for c in by]).agg(*[F.max(F.col(r).isNotNull()).alias(f"has_{r}") for r in NAMES], F.max(_every(["begin", "roll", "end"])).alias("rolls"), F.max(_every(["is_net", "cf_net"]) & (F.col("duration_key") != "point")).alias("nets"))
    held = has.join(lines, [F.col(c) == F.col(f"w_{c}") for c in by], "left")
    c, every = (lambda x: F.coalesce(F.col(x), F.lit(False))), (lambda *x: reduce(lambda a, b: a & b, [F.coalesce(F.col(f"has_{r}"), F.lit(False)) for r in x]))
    some = lambda *x: reduce(lambda a, b: a | b, [F.coalesce(F.col(f"has_{r}"), F.lit(False)) for r in x])
    reasons = [
        (BALANCE, F.when(~c("balance") | ~some("assets", "liabilities", "equity"), "No balance sheet data")),
        (ROLL, F.when(~c("cash") | ~c("balance"), "Missing statements").when(~every("begin", "roll", "end", "bs_cash"), "Insufficient data").when(~c("rolls"), "No overlapping duration data")),
        (NET, F.when(~c("income") | ~c("cash"), "Missing statements").when(~every("is_net", "cf_net") | ~c("nets"), "No overlapping duration data")),
        (INCOME, F.when(~c("income"), "Missing income statement").when(~some("revenue", "cost", "gross", "opex", "opinc", "other", "pretax", "tax", "is_net"), "Insufficient income statement data")),
        (CASH, F.when(~c("cash"), "Missing cash flow statement").when(~every("change", "cfo", "cfi", "cff"), "Insufficient cash flow data")),
    ]
    return held.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("check"), r.alias("reason")) for n, r in reasons])).alias("_c")).select(*by, "_c.*")


def certify_batches(store: DataFrame, by: list[str]) -> DataFrame:
    """by, check, result, details: five checks of every batch; a batch without measurements gives no rows.

    What all checks read, a row for each period of the chosen lines, is laid out once and written.
    """
    wide = written(laid_out(store, by), "laid-out")
    found = reduce(DataFrame.unionByName, [f(wide, by) for f in (balance_check, roll_check, net_check, income_check, cash_check)])
    found = found.select(*[F.col(c).alias(f"f_{c}") for c in by], F.col("check").alias("f_check"), "result", "details")
    named = _coverage(wide, store, by).join(found, [F.col("check") == F.col("f_check"), *[F.col(c) == F.col(f"f_{c}") for c in by]], "left")
    none = F.col("reason").isNotNull()
    return named.select(*by, "check", F.when(none, "CHECK").otherwise(F.col("result")).alias("result"), F.when(none, F.col("reason")).otherwise(F.col("details")).alias("details"))


def certify_all(store: DataFrame, source: str = "Batch") -> DataFrame:
    """The checks over everything as one batch, in the form of a certification table."""
    rows = certify_batches(store.withColumn("_batch", F.lit(source)), ["_batch"])
    return rows.select(F.col("_batch").alias("Source PDF"), F.col("check").alias("Check"), F.col("result").alias("Result"), F.col("details").alias("Details"))


def net_income_overview(store: DataFrame, by: list[str]) -> DataFrame:
    """B0: by, duration, period_end, income, cash, ok for every period that either statement has; ok null: only one has it.

    Of several measurements of a period the one from the last source wins; a year-to-date figure without its own
    quarter gives one, less the year-to-date figure exactly three months before.
    """
    lines = store.filter(F.col("statement").isin("income", "cash") & F.lower("label").startswith("net income") & (F.year("period_end") >= 1900))
    kind = D.normal_duration(F.col("statement"), F.col("duration"), F.col("months"))
    each = lines.withColumn("kind", kind).groupBy(*by, "statement", "kind", "months", "period_end").agg(F.max_by("value", "seq").alias("value"))
    # figures of one year so far begin in one month; the one three months shorter stands in a frame of its own
    begins = F.year("period_end") * 12 + F.month("period_end") - F.col("months")
    shorter = Window.partitionBy(*by, "statement", "kind", begins).orderBy("months").rangeBetween(-3, -3)
    ytd = (F.col("kind") == "ytd") & F.col("months").isNotNull()
    met = each.withColumn("_b", F.when(ytd, F.max(F.struct("period_end", "value")).over(shorter)))
    own = F.struct("kind", F.col("value").alias("value"), F.lit(0).alias("made"))
    made = F.struct(F.lit("quarter").alias("kind"), (F.col("value") - F.col("_b.value")).alias("value"), F.lit(1).alias("made"))
    rows = met.select(*by, "statement", "period_end", F.explode(F.array_compact(F.array(own, F.when(F.col("_b").isNotNull(), made)))).alias("_r")).select(*by, "statement", "period_end", "_r.*")
    wide = rows.groupBy(*by, "kind", "period_end").agg(*[F.min(F.when(F.col("statement") == s, F.struct("made", "value"))).alias(s) for s in ("income", "cash")])
    wide = wide.select(*by, "kind", "period_end", F.col("income.value").alias("income"), F.col("cash.value").alias("cash"))
    return wide.select(*by, F.col("kind").alias("duration"), "period_end", "income", "cash", _ok(F.col("income") - F.col("cash")).alias("ok"))
