"""Label rules as a table: ordinal, kind, pattern, output; a rule is the rows of one ordinal, and all its tests must hold.

Kinds: contains, starts, equals, lacks, matches (a regular expression) of the label in lower case, and printed (contained in the printed
line). The first rule by ordinal that fits gives its output. Rules are few: a table is counted and
read once, and becomes one expression, so lines are neither joined nor shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyframe.errors import RuleError

SCHEMA = "ordinal int, kind string, pattern string, output string"
#: Rows of a table of rules at most.
MOST = 2000
_MARKS = {"starts": "^", "equals": "=", "lacks": "!", "matches": "~", "printed": "raw:", "contains": ""}
Rules = list[tuple[list[str], str]]


def table_of(spark: SparkSession, rules: Rules) -> DataFrame:
    """A list of rules (as ``rewrites`` holds them) as a table, ten ordinals apart."""
    rows = []
    for i, (tests, output) in enumerate(rules, 1):
        for t in tests:
            kind = next(k for k, mark in _MARKS.items() if t.startswith(mark))
            rows.append((10 * i, kind, t.removeprefix(_MARKS[kind]), output))
    return spark.createDataFrame(rows, SCHEMA)


def listed(rules: DataFrame) -> Rules:
    """The rules in order, as expressions take them. Unknown kinds, rules of two outputs, null patterns and too many rows are errors."""
    rows = rules.select("ordinal", "kind", "pattern", "output").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise RuleError(f"more than {MOST} rows of rules")
    out: dict[int, tuple[list[str], str]] = {}
    for r in sorted(rows, key=lambda r: (r["ordinal"] is None, r["ordinal"], str(r["kind"]), str(r["pattern"]))):
        if r["kind"] not in _MARKS or r["ordinal"] is None or not r["pattern"]:
            raise RuleError(f"not a rule: {r}")
        tests, output = out.setdefault(r["ordinal"], ([], r["output"] or ""))
        if output != (r["output"] or ""):
            raise RuleError(f"rule {r['ordinal']} has several outputs")
        pattern = r["pattern"]
        if r["kind"] == "contains" and pattern.startswith(tuple(m for m in _MARKS.values() if m)):
            tests.append("~" + re.escape(pattern))  # a text that looks like a mark
        else:
            tests.append(_MARKS[r["kind"]] + pattern)
    return [out[k] for k in sorted(out)]


def with_own(rules: DataFrame, own: DataFrame) -> DataFrame:
    """``rules`` with a user's: those of an ordinal that is there take its place, others come between."""
    return rules.join(own.select("ordinal").distinct(), "ordinal", "left_anti").select("ordinal", "kind", "pattern", "output").unionByName(own.select("ordinal", "kind", "pattern", "output"))
