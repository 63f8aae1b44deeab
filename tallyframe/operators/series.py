"""Fiscal series: calendars, and missing quarters and years by differencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ["q1", "q2", "q3", "q4", "y1", "y2", "y3", "y4", "fy"]


def mode_first(rows: DataFrame, by: list[str], value: Column, seq: str, name: str) -> DataFrame:
    """The most frequent value of each group; ties to the one seen first."""
    counted = rows.groupBy(*by, value.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    return counted.groupBy(*by).agg(F.max_by(F.struct(name, "n"), F.struct(F.col("n"), -F.col("first"))).alias("_m")).select(*by, "_m.*")


def slots(facts: DataFrame, keys: list[str], slot: str = "slot", value: str = "value") -> DataFrame:
    """One row per key with a column for each slot of a fiscal year."""
    return facts.groupBy(*keys).pivot(slot, SLOTS).agg(F.max(value))


def derive_series(wide: DataFrame) -> DataFrame:
    """q1..q4 and fy of rows of slots.

    A reported quarter wins; else year-to-date less all quarters before it. The fourth may also
    come from the year's total; the year from its own total, four quarters' year-to-date, or
    the sum of four known quarters.
    """
    q1 = F.coalesce("q1", "y1")
    q2 = F.coalesce(F.col("q2"), F.col("y2") - q1)
    q3 = F.coalesce(F.col("q3"), F.col("y3") - (q1 + q2))
    q4 = F.coalesce(F.col("q4"), F.col("y4") - (q1 + q2 + q3), F.col("fy") - (q1 + q2 + q3))
    fy = F.coalesce(F.col("fy"), F.col("y4"), q1 + q2 + q3 + q4)
    keys = [c for c in wide.columns if c not in SLOTS]
    return wide.select(*keys, q1.alias("q1"), q2.alias("q2"), q3.alias("q3"), q4.alias("q4"), fy.alias("fy"))


def derive_measurements(wide: DataFrame) -> DataFrame:
    """Like ``derive_series``, but by adjacent year-to-date figures first, with what was derived: slot, value, derived."""
    both = lambda a, b: F.col(a) - F.col(b)
    d = {
        "q1": (F.col("q1"), F.col("y1")),
        "q2": (F.col("q2"), F.coalesce(both("y2", "y1"), F.col("y2") - F.coalesce("q1", "y1"))),
    }
    v2 = F.coalesce(*d["q2"])
    v1 = F.coalesce(*d["q1"])
    d["q3"] = (F.col("q3"), F.coalesce(both("y3", "y2"), F.col("y3") - (v1 + v2)))
    v3 = F.coalesce(*d["q3"])
    d["q4"] = (F.col("q4"), F.coalesce(both("y4", "y3"), both("fy", "y3"), F.col("fy") - (v1 + v2 + v3), F.col("y4") - (v1 + v2 + v3)))
    d["fy"] = (F.col("fy"), F.coalesce(F.col("y4"), v1 + v2 + v3 + F.coalesce(*d["q4"])))
    keys = [c for c in wide.columns if c not in SLOTS]
    rows = F.array(*[F.struct(F.lit(s).alias("slot"), F.coalesce(a, b).alias("value"), (a.isNull() & b.isNotNull()).alias("derived")) for s, (a, b) in d.items()])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*").filter("value is not null")


def as_of(rows: DataFrame, ends: DataFrame, date: str, end: str, most_days: int = 400) -> DataFrame:
    """``end``: the first of ``ends`` not before the row's date and at most ``most_days`` after it.

    Both sides meet in cells of ``most_days`` days: a row looks in its own and the next.
    """
    day = lambda c: F.datediff(F.col(c), F.to_date(F.lit("1970-01-01")))
    cell = lambda c: F.floor(day(c) / most_days)
    dates = rows.select(date).distinct().withColumn("_cell", F.explode(F.array(cell(date), cell(date) + 1)))
    met = dates.join(ends.select(F.col(end)).distinct().withColumn("_cell", cell(end)), "_cell").filter((F.col(end) >= F.col(date)) & (F.datediff(end, date) <= most_days))
    first = met.groupBy(F.col(date).alias("_date")).agg(F.min(end).alias(end))
    return rows.join(first, F.col(date).eqNullSafe(F.col("_date")), "left").drop("_date")


def nearest_date(rows: DataFrame, points: DataFrame, by: list[str], target: str, at: str, value: str, days: int = 3) -> DataFrame:
    """``value`` at the closest date within ``days``; an earlier date wins over one as far after."""
    wanted = rows.select(*by, target, F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_d")).withColumn("_at", F.date_add(target, F.col("_d")))
    known = points.select(*[F.col(c).alias(f"_p_{c}") for c in by], F.col(at).alias("_p_at"), F.col(value).alias(value))
    met = wanted.join(known, [F.col("_at") == F.col("_p_at"), *[F.col(c) == F.col(f"_p_{c}") for c in by]])
    return met.groupBy(*by, target).agg(F.min(F.struct(F.abs("_d").alias("far"), F.col("_d").alias("offset"), F.col(value).alias(value))).alias("_m")).select(*by, target, "_m.offset", f"_m.{value}")
