"""Filings that cover a history of fiscal years and quarters: the least list in closed form, and a search among any filings at hand.

The search takes, for each request on its own, the latest period that is not covered yet and gives it to the filing that
holds it and most of the other open periods (of equal ones the oldest), until nothing is open or no
filing holds what is. It is one pass of array functions over a request's filings, so requests are rows
like any others. Over all the reports that a company files it gives the closed form.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.errors import PeriodError
from tallyframe.functions.text import let


def parse_period(spec: str) -> tuple[int, int]:
    """``FY2024``, ``FY-2024``, ``Q3 2025`` or ``Q3_2025`` as (year, quarter); a year is its fourth quarter."""
    m = re.fullmatch(r"(?:FY|Q([1-4]))[\s_-]?(\d{4})", spec.strip(), re.IGNORECASE)
    if not m:
        raise PeriodError(f"not a period: {spec!r}")
    return int(m[2]), int(m[1] or 4)


def filings(requests: DataFrame) -> DataFrame:
    """request, form, year, quarter of every filing for rows of (request, year, quarter, years).

    An annual report holds two balance sheets and three income statements; reports of second
    and third quarters also hold the year before. Every second year is enough of each, from the
    latest down. A first quarter has a report of its own only when it is the latest.
    """
    y, q, n = F.col("year"), F.col("quarter"), F.col("years")
    latest = F.when(q == 4, y).otherwise(y - 1)
    earliest = latest - n + 1
    down = lambda top: F.when(top >= earliest, F.sequence(top, earliest, F.lit(-2))).otherwise(F.array().cast("array<int>"))
    forms = [("10-K", 4, down(latest)), ("10-Q", 1, F.when(q == 1, F.array(y)).otherwise(F.array().cast("array<int>"))), ("10-Q", 2, down(F.when(q >= 2, y).otherwise(y - 1))), ("10-Q", 3, down(F.when(q >= 3, y).otherwise(y - 1)))]

    def named(form: str, number: int):
        return lambda x: F.struct(F.lit(form).alias("form"), x.alias("f_year"), F.lit(number).alias("f_quarter"))

    rows = F.flatten(F.array(*[F.transform(years, named(f, k)) for f, k, years in forms]))
    return requests.select("request", F.explode(rows).alias("_f")).select("request", F.col("_f.form").alias("form"), F.col("_f.f_year").alias("year"), F.col("_f.f_quarter").alias("quarter"))


def plan(spark: SparkSession, latest: str, years: int) -> DataFrame:
    """The filings for one history, annual reports first."""
    if years <= 0:
        raise ValueError("years must be positive")
    year, quarter = parse_period(latest)
    request = spark.createDataFrame([(latest, year, quarter, years)], "request string, year int, quarter int, years int")
    return filings(request).orderBy("form", "quarter", F.desc("year"))


def quarter_code(year: Column, quarter: Column) -> Column:
    """Quarters as numbers in order; the odd ones between are fiscal years, each just behind its fourth quarter."""
    return (year * 8 + (quarter - 1) * 2).cast("int")


def year_code(year: Column) -> Column:
    return (year * 8 + 7).cast("int")


def code_name(code: Column) -> Column:
    """``Q3 2025`` or ``FY 2025`` of a number."""
    year = F.floor(code / 8).cast("string")
    return F.when(code % 2 == 1, F.concat(F.lit("FY "), year)).otherwise(F.concat(F.lit("Q"), (F.floor((code % 8) / 2) + 1).cast("string"), F.lit(" "), year))


def targets(requests: DataFrame) -> DataFrame:
    """request, targets (array of period numbers, in order): what a history of (year, quarter, years) asks for.

    The last ``years`` whole fiscal years, and all quarters from the first of them to the latest.
    """
    last = F.when(F.col("quarter") == 4, F.col("year")).otherwise(F.col("year") - 1)
    first = last - F.col("years") + 1
    quarters = F.sequence(quarter_code(first, F.lit(1)), quarter_code(F.col("year"), F.col("quarter")), F.lit(2))
    years = F.transform(F.sequence(first, last), year_code)
    asked = F.when(F.col("years") > 0, F.array_sort(F.concat(quarters, years))).otherwise(F.array().cast("array<int>"))
    return requests.select("request", asked.alias("targets"))


def _annual(y: Column) -> Column:
    """Two balance sheets and three income statements."""
    return F.array(quarter_code(y, F.lit(4)), quarter_code(y - 1, F.lit(4)), year_code(y), year_code(y - 1), year_code(y - 2))


def _interim(y: Column, quarter: int) -> Column:
    """This year's and last year's quarters; a second-quarter report lets the first ones be known too, a first-quarter one holds its own."""
    held = [quarter_code(x, F.lit(q)) for x in (y, y - 1) for q in ((1, 2) if quarter == 2 else (quarter,))]
    return F.array(*(held[:1] if quarter == 1 else held))


def reports(requests: DataFrame) -> DataFrame:
    """request, form, year, quarter, covers: every report that can be filed by the latest period and reaches into the history.

    First-quarter reports count only as the latest one.
    """
    last = F.when(F.col("quarter") == 4, F.col("year")).otherwise(F.col("year") - 1)
    first = last - F.col("years") + 1
    kinds = []
    for form, q in (("10-K", 4), ("10-Q", 1), ("10-Q", 2), ("10-Q", 3)):
        top = F.when(F.col("quarter") >= q, F.col("year")).otherwise(F.col("year") - 1)
        years = F.when(F.col("quarter") == 1, F.array("year")).otherwise(F.array().cast("array<int>")) if q == 1 else F.when(top >= first, F.sequence(first, top)).otherwise(F.array().cast("array<int>"))
        kinds.append(F.transform(years, partial(_report, form, q)))
    return requests.filter("years > 0").select("request", F.explode(F.concat(*kinds)).alias("_r")).select("request", "_r.*")


def _report(form: str, quarter: int, y: Column) -> Column:
    return F.struct(F.lit(form).alias("form"), y.cast("int").alias("year"), F.lit(quarter).alias("quarter"), (_annual(y) if quarter == 4 else _interim(y, quarter)).alias("covers"))


_FILING = "struct<form: string, year: int, quarter: int, covers: array<int>>"
_CHOICE = "struct<form: string, year: int, quarter: int, covers: array<int>, score: int>"


def cover(wanted: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The filings chosen for each request, with the periods each is taken for; and the periods that no filing holds.

    wanted: request, targets (array of int). filings: request, form, year, quarter, covers (array of int). Gives (request, nth, form,
    year, quarter, covers, score), ``covers`` being only what the filing is chosen for, and (request, target). Repeated targets and
    filings count once, nulls among them do not count; a request without targets gives no row, filings of
    unknown requests none either. A request's filings meet in one row: those of one company.
    """
    own = F.struct("form", F.col("year").cast("int").alias("year"), F.col("quarter").cast("int").alias("quarter"), F.array_sort(F.array_compact(F.col("covers").cast("array<int>"))).alias("covers"))
    at_hand = filings.filter("covers is not null").groupBy(F.col("request").alias("_r")).agg(F.collect_set(own).alias("_f"))
    met = wanted.join(at_hand, F.col("request").eqNullSafe(F.col("_r")), "left").select("request", F.array_sort(F.array_distinct(F.array_compact(F.col("targets").cast("array<int>")))).alias("_t"), F.coalesce("_f", F.array().cast(f"array<{_FILING}>")).alias("_f"))
    none = F.array().cast(f"array<{_CHOICE}>")
    start = F.struct(F.col("_t").alias("open"), none.alias("chosen"), F.array().cast("array<int>").alias("lost"))
    kind = f"struct<open: array<int>, chosen: array<{_CHOICE}>, lost: array<int>>"

    def step(s: Column, _: Column) -> Column:
        # each value is bound once: a chain of columns would work it out anew at every use
        def choose(latest: Column, held: Column) -> Column:
            best = let(F.array_max(held), lambda x: F.struct(F.array_except(s["open"], x["took"]).alias("open"), F.concat(s["chosen"], F.array(
                F.struct(x["form"].alias("form"), (-x["y"]).alias("year"), (-x["q"]).alias("quarter"), x["took"].alias("covers"), x["score"].alias("score")),
            ).cast(f"array<{_CHOICE}>")).alias("chosen"), s["lost"].alias("lost")).cast(kind))
            missed = F.struct(F.array_remove(s["open"], latest).alias("open"), s["chosen"].alias("chosen"), F.concat(s["lost"], F.array(latest)).alias("lost")).cast(kind)
            return F.when(F.size(held) > 0, best).otherwise(missed)

        def ranked(f: Column) -> Column:
            return let(F.array_intersect(f["covers"], s["open"]), lambda took: F.struct(F.size(took).alias("score"), (-f["year"]).alias("y"), (-f["quarter"]).alias("q"), f["form"].alias("form"), f["covers"].alias("covers"), took.alias("took")))

        def chosen(latest: Column) -> Column:
            return let(F.transform(F.filter(F.col("_f"), lambda f: F.array_contains(f["covers"], latest)), ranked), lambda held: choose(latest, held))

        return F.when(F.size(s["open"]) == 0, s).otherwise(let(F.array_max(s["open"]), chosen))

    rounds = F.when(F.size("_t") > 0, F.sequence(F.lit(1), F.size("_t"))).otherwise(F.array().cast("array<int>"))
    done = met.withColumn("_s", F.aggregate(rounds, start.cast(kind), step))
    # an inner explode would have Spark test the array first, and search once more for each test
    chosen = done.select("request", F.posexplode_outer("_s.chosen").alias("nth", "_c")).filter("nth is not null").select("request", (F.col("nth") + 1).alias("nth"), "_c.*")
    return chosen, done.select("request", F.explode_outer("_s.lost").alias("target")).filter("target is not null")


def plan_json(requests: DataFrame) -> DataFrame:
    """request, plan: targets and chosen filings of each request as JSON, annual reports first, by year and quarter."""
    wanted = targets(requests)
    chosen, _ = cover(wanted, reports(requests))
    names = lambda codes, odd: F.transform(F.filter(codes, lambda c: c % 2 == odd), code_name)
    filing = F.struct((F.col("form") != "10-K").alias("o"), F.col("year").alias("oy"), F.col("quarter").alias("oq"), F.struct(
        F.col("form").alias("type"), "year", F.when(F.col("form") != "10-K", F.col("quarter")).alias("quarter"), names("covers", 0).alias("covers_quarters"), names("covers", 1).alias("covers_fiscal_years"),
    ).alias("f"))
    listed = chosen.withColumn("covers", F.array_sort("covers")).groupBy(F.col("request").alias("_r")).agg(F.transform(F.array_sort(F.collect_list(filing)), lambda x: x["f"]).alias("filings"))
    met = requests.join(wanted.withColumnRenamed("request", "_w"), F.col("request") == F.col("_w")).join(listed, F.col("request") == F.col("_r"))
    return met.select("request", F.to_json(F.struct(F.col("request").alias("latest"), "years", names("targets", 0).alias("required_quarters"), names("targets", 1).alias("required_fiscal_years"), "filings")).alias("plan"))
