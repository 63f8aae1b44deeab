"""Rules as a table: order, kinds, a user's own, and what is no rule."""

import pytest
from pyspark.sql import functions as F

from tallyframe.errors import PeriodError, RuleError, TallyError
from tallyframe.functions import rewrites as W
from tallyframe.operators import relabel, rules
from tallyframe.plans.label_queries import sample


def test_tables_hold_the_rules(spark):
    for found in (W.CLEANED, W.CANONICAL):
        assert [(sorted(t), out) for t, out in rules.listed(rules.table_of(spark, found))] == [(sorted(t), out) for t, out in found]


@pytest.mark.parametrize("found", [W.CLEANED, W.CANONICAL], ids=["cleaned", "canonical"])
def test_every_rule_is_reached(spark, found):
    """Each sample is named by a rule, and by its own unless one before it fits too."""
    rows = [(i, *sample(tests)) for i, (tests, _) in enumerate(found)]
    got = {r.i: r.y for r in spark.createDataFrame(rows, "i int, label string, raw string").select("i", W.by_rules(F.col("label"), found, F.col("raw")).alias("y")).collect()}
    own = [i for i, (_, out) in enumerate(found) if got[i] == out]
    assert len(own) >= len(found) - 1 and all(got[i] in {out for _, out in found} for i in got)


def test_kinds_and_own_rules(spark):
    usual = spark.createDataFrame([(10, "contains", "cash", "Cash"), (20, "starts", "net", "Net"), (20, "lacks", "loss", "Net"), (30, "contains", "^odd", "Odd")], rules.SCHEMA)
    own = spark.createDataFrame([(10, "equals", "cash", "Only cash"), (15, "matches", r"^net\s+sales", "Sales"), (40, "printed", "note", "By line")], rules.SCHEMA)
    labels = spark.createDataFrame([("Cash", ""), ("Cash flow", ""), ("Net sales", ""), ("Net loss", ""), ("x ^odd", ""), ("y", "see Note 3"), (None, None)], "label string, raw string")
    name = lambda t: [r[0] for r in labels.select(W.by_rules(F.col("label"), rules.listed(t), F.col("raw"))).collect()]
    assert name(usual) == ["Cash", "Cash", "Net", "Net loss", "Odd", "y", None]
    assert name(rules.with_own(usual, own)) == ["Only cash", "Cash flow", "Sales", "Net loss", "Odd", "By line", None]


@pytest.mark.parametrize("rows", [[(1, "like", "x", "y")], [(None, "equals", "x", "y")], [(1, "equals", None, "y")], [(1, "equals", "x", "y"), (1, "starts", "x", "z")], [(i, "equals", "x", "y") for i in range(rules.MOST + 1)]])
def test_no_rules(spark, rows):
    with pytest.raises(RuleError):
        rules.listed(spark.createDataFrame(rows, rules.SCHEMA))
    assert issubclass(RuleError, TallyError) and issubclass(PeriodError, ValueError)


def test_rules_settle_labels(spark):
    rows = spark.createDataFrame([(1, "income", 1, 0, "Turnover", "Turnover", [1.0]), (1, "income", 2, 0, "Net income (loss)", "x", [2.0])], "doc_id int, statement string, order_index int, level int, label string, raw string, values array<double>")
    own = rules.with_own(rules.table_of(spark, W.CANONICAL), spark.createDataFrame([(1, "equals", "turnover", "Revenue")], rules.SCHEMA))
    assert {r.label for r in relabel.settled(rows, ["doc_id"], rules=own).collect()} == {"Revenue", "Net income"}
