"""Arithmetic checks over facts: identities by period, PASS where all hold, CHECK where one fails or lacks data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6
# Statement, role and the label patterns that fill it, in order of preference.
ROLES = [
    ("balance", "assets", r"(?i)total assets"),
    ("balance", "liabilities", r"(?i)total liabilities(?!.*(equity|and stock|and share))"),
    ("balance", "equity", r"(?i)total (stockholders|shareholders)"),
    ("balance", "bs_cash", r"(?i)cash and cash equivalents"),
    ("cash", "begin", r"(?i)beginning cash and cash equivalents"),
    ("cash", "change", r"(?i)^(?:increase|decrease)"),
    ("cash", "end", r"(?i)ending cash and cash equivalents"),
    ("cash", "cf_net", r"(?i)^net income"),
    ("cash", "operating", r"(?i)^net cash .*operating activities"),
    ("cash", "investing", r"(?i)^net cash .*investing activities"),
    ("cash", "financing", r"(?i)^net cash .*financing activities"),
    ("cash", "exchange", r"(?i)effect of .*exchange"),
    ("income", "is_net", r"(?i)^net income"),
    ("income", "revenue", r"(?i)^net revenue|^revenue|^sales$"),
    ("income", "cost", r"(?i)^cost of revenue|^cost of sales$"),
    ("income", "gross", r"(?i)^gross profit$"),
    ("income", "opex", r"(?i)^total operating expenses$"),
    ("income", "opinc", r"(?i)^operating income$"),
    ("income", "other", r"(?i)other income"),
    ("income", "pretax", r"(?i)income before"),
    ("income", "tax", r"(?i)^provision.*income taxes"),
]


def role_values(facts: DataFrame, roles: list[tuple[str, str, str]] = ROLES, keys: list[str] = ("doc_id",)) -> DataFrame:
    """keys, period, and a column for each role: the first line (by order_index) whose label fits.

    Roles are a few dozen expressions over the row, so facts are scanned and shuffled once.
    """
    fits = F.array_compact(F.array(*[F.when((F.col("statement") == s) & F.col("label").rlike(p), F.lit(r)) for s, r, p in roles]))
    found = facts.withColumn("role", F.explode(fits))
    # the first line of a role in its document, then its values by period
    names = [r for _, r, _ in roles]
    return found.groupBy(*keys, "period").pivot("role", names).agg(F.min_by("value", "order_index"))


def identities(wide: DataFrame, checks: dict[str, tuple[Column, list[str], list[str]]], keys: list[str]) -> DataFrame:
    """check, keys, delta, ok per row: each check's difference; terms it needs; terms that count as zero when missing.

    No term at all: the row says nothing on the check. Some but not all: not ok, delta null.
    """
    rows = []
    for name, (delta, needs, _) in checks.items():
        known = [F.col(c).isNotNull() for c in needs]
        every, some = known[0], known[0]
        for k in known[1:]:
            every, some = every & k, some | k
        rows.append(F.when(some, F.struct(F.lit(name).alias("check"), F.when(every, delta).alias("delta"), F.when(every, F.abs(delta) <= TOLERANCE).otherwise(False).alias("ok"))))
    return wide.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("_r")).select(*keys, "_r.*")


def verdicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, check, result, periods, failed: PASS where every period is ok."""
    return rows.groupBy(*keys, "check").agg(F.when(F.bool_and("ok"), "PASS").otherwise("CHECK").alias("result"), F.count(F.lit(1)).alias("periods"), F.sum((~F.col("ok")).cast("long")).alias("failed"))


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def document_checks() -> dict[str, tuple[Column, list[str], list[str]]]:
    """The identities of one document's three statements."""
    c = F.col
    return {
        "balance equality": (c("assets") - (c("liabilities") + c("equity")), ["assets", "liabilities", "equity"], []),
        "cash roll": (c("begin") + c("change") - c("end"), ["begin", "change", "end"], []),
        "net income link": (c("is_net") - c("cf_net"), ["is_net", "cf_net"], []),
        "gross profit": (c("revenue") + c("cost") - c("gross"), ["revenue", "cost", "gross"], []),
        "operating income": (c("gross") - c("opex") - c("opinc"), ["gross", "opex", "opinc"], []),
        "pretax income": (c("opinc") + c("other") - c("pretax"), ["opinc", "other", "pretax"], []),
        "net income": (c("pretax") + c("tax") - c("is_net"), ["pretax", "tax", "is_net"], []),
        "cash flow": (c("operating") + c("investing") + c("financing") + zero("exchange") - c("change"), ["operating", "investing", "financing", "change"], ["exchange"]),
    }


def certify(facts: DataFrame, keys: list[str] = ("doc_id",)) -> DataFrame:
    """Verdicts of every document; facts: keys, statement, order_index, label, period, value."""
    keys = list(keys)
    return verdicts(identities(role_values(facts, keys=keys), document_checks(), [*keys, "period"]), keys)


def issues(verdict: DataFrame) -> DataFrame:
    return verdict.filter(~F.col("result").isin("PASS", "INFO"))


def best_line(lines: DataFrame, by: list[str], line: str, duration: str, seq: str) -> DataFrame:
    """The line of each group with the most data: ten points a quarter, one a period; ties to the first."""
    scored = lines.groupBy(*by, line).agg((10 * F.sum((F.col(duration) == "quarter").cast("long")) + F.count(F.lit(1))).alias("score"), F.min(seq).alias("first"))
    return scored.groupBy(*by).agg(F.max_by(F.struct(line, "score"), F.struct(F.col("score"), -F.col("first"))).alias("_m")).select(*by, "_m.*")


def prefer_reported(rows: DataFrame, keys: list[str], value: str, derived: str, seq: str) -> DataFrame:
    """One measurement of each key: a reported one before a derived one, then the first."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(value, derived), F.struct(derived, seq)).alias("_m")).select(*keys, "_m.*")
