"""Text of checks: differences, periods and measurements as they are reported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.periods import MONTHS
from tallyframe.functions.text import let

DATE = "MMMM dd, yyyy"


def significant(x: Column, digits: int = 6) -> Column:
    """A number with so many significant digits and no zeros at the end; by exponent below 1e-4 and from 10 ** digits on."""

    def shown(text: Column) -> Column:
        mantissa, power = F.substring_index(text, "e", 1), F.substring_index(text, "e", -1)
        bare = lambda t: F.regexp_replace(t, r"\.?0+$", "")
        plain = power.try_cast("int").between(-4, digits - 1)
        return F.when(plain, bare(text.try_cast("decimal(38,18)").cast("string"))).otherwise(F.concat(F.when(F.contains(mantissa, F.lit(".")), bare(mantissa)).otherwise(mantissa), F.lit("e"), power))

    value = x.cast("double")
    return F.when(value == 0, F.lit("0")).when(value.isNotNull(), let(F.format_string(f"%.{digits - 1}e", value), shown))


def delta_text(label: str, delta: Column, derived: Column | None = None) -> Column:
    """``label Δ number``, marked where a term was derived."""
    text = F.concat(F.lit(f"{label} Δ " if label else "Δ "), significant(delta))
    return text if derived is None else F.concat(text, F.when(derived, F.lit(" (derived)")).otherwise(""))


def date_text(end: Column) -> Column:
    return F.date_format(end, DATE)


def describe_measure(duration: Column, months: Column, end: Column) -> Column:
    """``3M ended``, ``FY ended`` or ``nM ended`` with the date, or the date."""
    date = date_text(end)
    return (
        F.when((duration == "quarter") | (months == 3), F.concat(F.lit("3M ended "), date))
        .when((duration == "annual") | (months == 12), F.concat(F.lit("FY ended "), date))
        .when(months > 0, F.concat(months.cast("string"), F.lit("M ended "), date))
        .otherwise(date)
    )


def describe_period(duration: Column, months: Column, end: Column) -> Column:
    """The same by kind first, as single reports name their columns: a year by its kind only, other months only if year to date."""
    date = date_text(end)
    return (
        F.when((duration == "quarter") | (months == 3), F.concat(F.lit("3M ended "), date))
        .when((duration == "ytd") & (months > 0), F.concat(months.cast("string"), F.lit("M ended "), date))
        .when(duration == "annual", F.concat(F.lit("FY ended "), date))
        .otherwise(date)
    )


def describe_key(key: Column, end: Column) -> Column:
    """A period by its duration key alone: quarter, annual or ytdN."""
    date, months = date_text(end), F.regexp_replace(key, r"\D", "")
    return (
        F.when(key == "quarter", F.concat(F.lit("3M ended "), date))
        .when(key == "annual", F.concat(F.lit("FY ended "), date))
        .when(key.startswith("ytd") & (months != "") & (months.try_cast("int") > 0), F.concat(months.cast("int").cast("string"), F.lit("M ended "), date))
        .otherwise(date)
    )


def period_signature(label: Column, period_end: Column, duration: Column | None = None) -> Column:
    """Struct of duration (empty unless given) and period: its end, else the year in the label, else the label."""
    year = F.nullif(F.regexp_extract(label, r"(20\d{2})", 1), F.lit(""))
    period = F.coalesce(F.nullif(period_end, F.lit("")), year, F.btrim(label))
    return F.struct(F.lit("").alias("duration") if duration is None else F.lower(F.coalesce(duration, F.lit(""))).alias("duration"), period.alias("period"))


def normal_duration(statement: Column, duration: Column, months: Column) -> Column:
    """Duration by kind, else by months; balances are points."""
    low = F.lower(F.coalesce(duration, F.lit("")))
    return (
        F.when(statement == "balance", "point")
        .when(low.isin("quarter", "ytd", "annual"), low)
        .when(months == 3, "quarter")
        .when(months.isin(6, 9), "ytd")
        .when(months == 12, "annual")
        .otherwise(F.when(low == "", "unknown").otherwise(low))
    )


def period_end_text(shown: Column, raw: Column) -> Column:
    """Month, day and year in the shown label, else in the raw one; else a year of either; else empty."""
    full = rf"(?i)(?:{MONTHS})\s+\d{{1,2}},\s*\d{{4}}"
    found = [F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for p in (full, r"(?:19|20)\d{2}") for t in (shown, raw)]
    return F.coalesce(*found, F.lit(""))
