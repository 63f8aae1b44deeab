"""The search for covering filings against the closed form and against a plain search over random filings."""

import json
import random

from pyspark.sql import functions as F

from tallyframe.operators import planner


def test_equals_the_closed_form(spark):
    requests = spark.createDataFrame([(f"{y}-{q}-{n}", y, q, n) for y in range(2015, 2030) for q in (1, 2, 3, 4) for n in range(1, 25)], "request string, year int, quarter int, years int").repartition(4)
    chosen, lost = planner.cover(planner.targets(requests), planner.reports(requests))
    assert lost.count() == 0
    got = {(r.request, r.form, r.year, r.quarter) for r in chosen.collect()}
    want = [(r.request, r.form, r.year, r.quarter) for r in planner.filings(requests).collect()]
    assert got == set(want) and len(want) == len(got) == chosen.count()
    # every period is given to exactly one filing that holds it
    each = chosen.select("request", F.explode("covers").alias("t")).groupBy("request").agg(F.sort_array(F.collect_list("t")).alias("t")).join(planner.targets(requests), "request")
    assert each.count() == 15 * 4 * 24 and each.filter("t <> targets").count() == 0


def plain(targets, filings):
    left, chosen, lost = set(targets), [], []
    while left:
        latest = max(left)
        holds = [f for f in filings if latest in f[3]]
        if not holds:
            left.discard(latest)
            lost.append(latest)
            continue
        best = max(holds, key=lambda f: (len(left & set(f[3])), -f[1], -f[2], f[0], sorted(set(f[3]))))
        chosen.append((*best[:3], tuple(sorted(left & set(best[3])))))
        left -= set(best[3])
    return chosen, sorted(lost)


def test_random_filings(spark):
    rng = random.Random(5)
    wanted, filings = [], []
    for i in range(150):
        wanted.append((i, [rng.randrange(30) for _ in range(rng.randrange(12))] + [None] * (i % 2)))
        filings += [(i, rng.choice(["10-K", "10-Q"]), rng.randrange(2010, 2015), rng.randrange(1, 5), [rng.randrange(30) for _ in range(rng.randrange(9))]) for _ in range(rng.randrange(9))]
    filings += [(3, "10-K", 2011, 1, None), (999, "10-K", 2011, 1, [1])]
    chosen, lost = planner.cover(spark.createDataFrame(wanted, "request int, targets array<int>"), spark.createDataFrame(filings, "request int, form string, year int, quarter int, covers array<int>"))
    got, missed = {}, {}
    for r in sorted(chosen.collect(), key=lambda r: (r.request, r.nth)):
        got.setdefault(r.request, []).append((r.form, r.year, r.quarter, tuple(sorted(r.covers))))
        assert r.score == len(r.covers)
    for r in lost.collect():
        missed.setdefault(r.request, []).append(r.target)
    for i, targets in wanted:
        a, b = plain([t for t in targets if t is not None], [f[1:] for f in filings if f[0] == i and f[4] is not None])
        assert (got.get(i, []), sorted(missed.get(i, []))) == (a, b)


def test_names_and_json(spark):
    requests = spark.createDataFrame([("Q1 2026", 2026, 1, 2)], "request string, year int, quarter int, years int")
    plan = json.loads(planner.plan_json(requests).first().plan)
    assert plan["required_fiscal_years"] == ["FY 2024", "FY 2025"] and plan["required_quarters"] == [f"Q{q} {y}" for y in (2024, 2025) for q in (1, 2, 3, 4)] + ["Q1 2026"]
    assert plan["filings"] == [
        {"type": "10-K", "year": 2025, "covers_quarters": ["Q4 2024", "Q4 2025"], "covers_fiscal_years": ["FY 2024", "FY 2025"]},
        {"type": "10-Q", "year": 2025, "quarter": 2, "covers_quarters": ["Q1 2024", "Q2 2024", "Q1 2025", "Q2 2025"], "covers_fiscal_years": []},
        {"type": "10-Q", "year": 2025, "quarter": 3, "covers_quarters": ["Q3 2024", "Q3 2025"], "covers_fiscal_years": []},
        {"type": "10-Q", "year": 2026, "quarter": 1, "covers_quarters": ["Q1 2026"], "covers_fiscal_years": []},
    ]
    none = requests.filter("false")
    assert planner.cover(planner.targets(none), planner.reports(none))[0].count() == 0


def test_a_request_is_searched_once(spark):
    """The plan holds the search, and each costly step in it, one time."""
    requests = spark.createDataFrame([("Q1 2026", 2026, 1, 2)], "request string, year int, quarter int, years int")
    for found in planner.cover(planner.targets(requests), planner.reports(requests)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert [plan.count(w) for w in ("aggregate(", "array_intersect(", "array_contains(", "array_except(")] == [1, 1, 1, 1]
