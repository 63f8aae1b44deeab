"""Numbers, units and signs as printed in statements: Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that mean missing, words that mark what is not money, and sign rules.
DASHES = ["", "-", "–", "—", "— —"]
NOT_MONEY = [
    "per share", "per common share", "earnings per share", "weighted-average shares", "shares outstanding", "percent", "%",
    "basis points", "ratio", "effective tax rate", "days", "headcount", "units",
]
KEEP_SIGN = ["total ", "gross profit", "operating income", "income before", "net income", "net revenue", "other (income)", "income (expense)", "earnings per share"]
EXPENSE = (
    r"(cost|cost of sales|cost of revenue|expense|selling|general|administrative|research and development|"
    r"\br&d\b|restructuring|impairment|acquisition-related|amortization of intangible|interest expense|provision)"
)
CASH_OUT = (
    r"(payment|paid|purchase|additions|acquisition|repayments|extinguishment|settlement|capital expenditure|"
    r"repurchase|dividend|taxes paid|withholding|lease payment)"
)
CASH_IN = r"(proceeds|issuance|collections|maturities|disposals|sale of|borrowings|draw|capital contribution)"
TAX_BENEFIT = r"(benefit|credit|relief)"
TAX_EXPENSE = r"(expense|provision|charge)"
PLAIN_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def parse_number(cell: Column) -> Column:
    """A printed number: commas dropped, parentheses mean negative, dashes and anything else are null."""
    t = F.btrim(cell)
    bare = F.replace(t, F.lit(","), F.lit(""))
    inside = bare.rlike(r"^\(.*\)$")
    digits = F.btrim(F.when(inside, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare))
    value = F.when(digits.rlike(PLAIN_NUMBER), digits.try_cast("double"))
    return F.when(~t.isin(DASHES), F.when(inside, -value).otherwise(value))


def units(text: Column) -> Column:
    """Struct of label, scale to millions and assumption; what is not stated counts as scale 1."""
    low = F.lower(text)

    def row(label: str, scale: float, assumption: str | None) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(scale).alias("scale"), F.lit(assumption).cast("string").alias("assumption"))

    return (
        F.when(F.contains(low, F.lit("in millions")), row("In millions", 1.0, None))
        .when(F.contains(low, F.lit("in thousands")), row("In thousands", 0.001, None))
        .when(F.contains(low, F.lit("in billions")), row("In billions", 1000.0, None))
        .otherwise(row("Unspecified", 1.0, "Assumed dollars"))
    )


def _any(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in words])


def non_monetary(label: Column) -> Column:
    """Substring test, so "operations" counts as a ratio: kept as the rule has it."""
    return _any(F.lower(label), NOT_MONEY)


def scaled(label: Column, value: Column, scale: Column) -> Column:
    return F.when(non_monetary(label), value).otherwise(value * scale)


def income_sign(label: Column, value: Column) -> Column:
    """Expenses negative, benefits positive; totals and results keep the sign that is printed."""
    low = F.lower(label)
    benefit, expense = low.rlike(TAX_BENEFIT), low.rlike(TAX_EXPENSE)
    flipped = F.when(value < 0, F.abs(value)).otherwise(-F.abs(value))
    tax = F.when(benefit & ~expense, F.abs(value)).when(expense & ~benefit, -F.abs(value)).otherwise(flipped)
    return (
        F.when(_any(low, KEEP_SIGN) | low.endswith(" net"), value)
        .when(F.contains(low, F.lit("tax")), tax)
        .when(low.rlike(EXPENSE), -F.abs(value))
        .otherwise(value)
    )


def cash_sign(label: Column, value: Column) -> Column:
    """Payments negative, then receipts positive, else as printed."""
    low = F.lower(label)
    return F.when(low.rlike(CASH_OUT), -F.abs(value)).when(low.rlike(CASH_IN), F.abs(value)).otherwise(value)


def fit_columns(values: Column, columns: int) -> Column:
    """An array of exactly ``columns`` values: too many keep the last, too few are filled with nulls at the end."""
    n = F.size(values)
    return F.when(n >= columns, F.slice(values, F.greatest(n - columns + 1, F.lit(1)), columns)).otherwise(
        F.concat(values, F.array_repeat(F.try_element_at(F.slice(values, 1, 0), F.lit(1)), F.greatest(F.lit(columns) - n, F.lit(0))))
    )
