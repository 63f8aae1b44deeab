"""Line labels: canonical form, clean-up with reasons, and suspicions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONNECTOR = r"(?i)((?:[,;]\s*|\s+)(?:and|or|of|in|the))+$"


def canonical(label: Column) -> Column:
    """Single spaces, and without a colon at the end if that is the only one."""
    t = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(label), "\t", " "), " +", " "))
    colons = F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit("")))
    return F.when((colons == 1) & t.endswith(":"), F.btrim(F.regexp_replace(t, ":$", ""))).otherwise(t)


def trimmed(label: Column) -> Column:
    """Struct of the label without dangling ends, and the reasons for each change in order."""
    steps = [
        ("collapsed_connectors", lambda x: F.regexp_replace(x, r"(?i)\b(and|or|of)(\s+\1)+\b", "$1")),
        ("dropped_respectively", lambda x: F.btrim(F.regexp_replace(x, r"(?i)[,;]?\s*respectively\.?$", ""))),
        (None, lambda x: F.when(F.contains(x, F.lit("(")) & ~F.contains(x, F.lit(")")) & (F.btrim(F.split(x, r"\(")[0]) != ""), F.btrim(F.split(x, r"\(")[0])).otherwise(x)),
        ("stripped_trailing_punctuation", lambda x: F.regexp_replace(x, "[;,]+$", "")),
        ("trimmed_dangling_connector", lambda x: F.btrim(F.regexp_replace(x, CONNECTOR, ""))),
    ]
    now, reasons = F.btrim(label), []
    for name, step in steps:
        new = step(now)
        if name:
            reasons.append(F.when(new != now, F.lit(name)))
        now = new
    return F.struct(now.alias("label"), F.array_compact(F.array(*reasons)).alias("reasons"))


def suspicions(label: Column, footnotes: list[str] = ("see accompanying",)) -> Column:
    """Reasons to doubt a label, each once, in order."""
    low = F.lower(label)
    foot = F.exists(F.array(*map(F.lit, footnotes)), lambda w: F.contains(low, w))
    found = F.array(
        F.when(foot, F.lit("footnote_fragment")),
        F.when(label.rlike(r"\d"), F.lit("contains_digits")),
        F.when(label.rlike("[:,;]$"), F.lit("dangling_punctuation")),
        F.when(F.contains(label, F.lit("(")) & ~F.contains(label, F.lit(")")), F.lit("dangling_parenthesis")),
        F.when(~label.rlike("[A-Za-z]"), F.lit("non_text_label")),
        F.when(low.isin("respectively", "issued", "none issued"), F.lit("standalone_fragment")),
    )
    return F.when(F.coalesce(label, F.lit("")) == "", F.array(F.lit("missing_label"))).otherwise(F.array_distinct(F.array_compact(found)))
