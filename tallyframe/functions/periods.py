"""Reporting periods: parsing, durations, fiscal years and quarters as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
FULL_DATE = rf"((?:{MONTHS})\s+\d{{1,2}},\s*\d{{4}})"


def period_end(text: Column) -> Column:
    """ISO date, month-day-year, or a bare year (its last day); else null."""
    t = F.btrim(text)
    year = F.nullif(F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    tries = [F.try_to_date(t, f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")]
    return F.coalesce(*tries, F.make_date(year.cast("int"), F.lit(12), F.lit(31)))


def duration_of(statement: Column, label: Column) -> Column:
    low = F.lower(label)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return (
        F.when(statement == "balance", "point")
        .when(has("three months"), "quarter")
        .when(has("six months", "nine months", "year-to-date", "ytd"), "ytd")
        .when(has("year ended", "years ended", "twelve months"), "annual")
        .when(low.rlike(r"(19|20)\d{2}") & ~has("month"), "annual")
        .when(statement == "cash", "ytd")
        .otherwise("unknown")
    )


def months_of(label: Column, duration: Column) -> Column:
    low = F.lower(label)
    said = F.lit(None).cast("int")
    for word, n in reversed((("three months", 3), ("six months", 6), ("nine months", 9), ("twelve months", 12))):
        said = F.when(F.contains(low, F.lit(word)), n).otherwise(said)
    return F.when(duration == "quarter", 3).when(duration == "annual", 12).otherwise(said)


def duration_key(duration: Column, months: Column) -> Column:
    ytd = F.concat(F.lit("ytd"), months.cast("string"))
    return (
        F.when((duration == "ytd") & months.isNotNull(), ytd)
        .when(duration.isin("quarter", "annual", "point"), duration)
        .when(F.coalesce(duration, F.lit("")) != "", duration)
        .otherwise(F.coalesce(ytd, F.lit("unknown")))
    )


def calendar_months(a: Column, b: Column) -> Column:
    """Months from b to a by calendar month, whatever the days."""
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def fiscal_year_end(end: Column, month: Column, day: Column) -> Column:
    """The first fiscal year end that is not before ``end``; the day is cut to its month."""
    later = (F.month(end) > month) | ((F.month(end) == month) & (F.dayofmonth(end) > day))
    year = F.year(end) + later.cast("int")
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.make_date(year, month, F.least(day, last))


def quarter_index(duration: Column, months: Column, end: Column, fy_end: Column) -> Column:
    """1..4, by year-to-date months or the distance to the year's end; else null."""
    far = calendar_months(fy_end, end)
    q = F.when((duration == "ytd") & months.isNotNull(), F.floor(months / 3)).when(months == 12, F.lit(4)).otherwise(4 - F.floor(far / 3)).cast("int")
    return F.when(q.between(1, 4), q)


def quarter_label(end: Column) -> Column:
    return F.concat(F.lit("3M ended "), F.date_format(end, "MMMM dd, yyyy"))


def describe_quarter(fy_end: Column, quarter: Column) -> Column:
    return F.concat(F.lit("FY"), F.year(fy_end).cast("string"), F.lit(" Q"), quarter.cast("string"))
