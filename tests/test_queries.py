"""Every query over the reference's operators against DuckDB, and the two without SQL by hand."""

import __spark_entry__ as entry
import pytest
from tests.conftest import SF
from tests.oracle import connect, difference

from tallyframe.operators.certify import certify
from tallyframe.plans.catalogue import ORACLES, QUERIES
from tallyframe.sources.demo import demo_facts

WITHOUT_SQL = {"q50_level_cluster", "q56_row_machine"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert difference(df.collect(), df.columns, duck, ORACLES[name]) == ""


def test_names():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_level_cluster(spark, duck):
    want = {}
    for brand, sizes in duck.execute("SELECT p_brand, list(DISTINCT p_size) FROM part GROUP BY 1").fetchall():
        starts = []
        for x in sorted(map(float, sizes)):
            if not starts or x - starts[-1] > 3:
                starts.append(x)
        want[brand] = ",".join(map(str, starts))
    assert {r.p_brand: r.levels for r in QUERIES["q50_level_cluster"](spark, SF).collect()} == want


def test_row_machine(spark, duck):
    lines = duck.execute("SELECT l_orderkey, l_partkey % 3, 'part ' || lower(l_returnflag), CAST(l_quantity AS BIGINT) FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag").fetchall()
    want, state = [], {}
    for order, kind, label, n in lines:
        rows, held = state.setdefault(order, ([], {}))
        if kind == 0:
            rows.append([label, n])
            held.pop("open", None)
        elif kind == 1:
            rows.append([label, held.pop("number", None)])
            held.pop("open", None)
            if rows[-1][1] is None:
                held["open"] = rows[-1]
        elif "open" in held:
            held.pop("open")[1] = n
        else:
            held["number"] = n
    for order, (rows, _) in state.items():
        want += [(order, i, label, "-|-" if n is None else f"-|{float(n)}") for i, (label, n) in enumerate(rows, 1)]
    got = [(r.l_orderkey, r.order_index, r.label, r.cells) for r in QUERIES["q56_row_machine"](spark, SF).collect()]
    short = lambda rows: sorted((o, i, label, c.replace("-|", "").replace("|-", "")) for o, i, label, c in rows)
    assert short(got) == short(want)


def test_demo_certification(spark):
    got = {r.check: r.result for r in certify(demo_facts(spark)).collect()}
    assert got.pop("operating income") == "CHECK"
    assert len(got) == 7 and set(got.values()) == {"PASS"}
