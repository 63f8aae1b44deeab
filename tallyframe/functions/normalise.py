"""Line labels brought to one form, with the reasons to doubt them: Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import rewrites as W
from tallyframe.functions.text import let

# Words that shares' details are told by, and labels that are no line by themselves.
DETAIL_WORDS = ["respectively", "issued", "authorized", "outstanding"]
SHARE_WORDS = r"(?i)(?:shares?|issued|outstanding|authorized)"
NO_LINE = ["respectively", "issued", "none issued"]
SHARE_SUFFIX = r"(?i)[;,]?\s*(and\s+)?(?:\d[\d,()]*\s+)?shares?.*$"
CONNECTORS = r"\b(and|or|of|in|the)"
#: What every trim needs to find; a label without any of it leaves them as it came.
TOUCHED = r"(?i)\b(?:and|or|of|in|the)\s+(?:and|or|of|in|the)\b|respectively|share|\(|[;,]$|(?:[,;]\s*|\s)(?:and|or|of|in|the)$"
PER_SHARE_LINE = "Net income attributable to Amkor per common share"
SECURITIES = ["common stock", "preferred stock", "treasury stock"]
# Children whose numbers belong to the row above them that holds one of these.
FRAGMENTS = {"unconsolidated affiliate": ["income before income taxes", "income before equity in earnings"], "affiliate": ["income before equity in earnings"]}


def _trims() -> list[tuple[str | None, object]]:
    """Reason and step, in order."""

    def open_bracket(x: Column, raw: Column) -> Column:
        head = F.btrim(F.substring_index(x, "(", 1))
        return F.when(F.contains(x, F.lit("(")) & ~F.contains(x, F.lit(")")) & (head != ""), head).otherwise(x)

    def share_suffix(x: Column, raw: Column) -> Column:
        return F.when(raw.rlike("(?i)" + W.SECURITY), F.btrim(F.regexp_replace(x, SHARE_SUFFIX, ""))).otherwise(x)

    return [
        ("collapsed_connectors", lambda x, raw: F.regexp_replace(x, rf"(?i){CONNECTORS}\s+(and|or|of|in|the)\b", "$1")),
        ("dropped_respectively", lambda x, raw: F.btrim(F.regexp_replace(x, r"(?i)[;,]?\s*respectively\)?$", ""))),
        ("trimmed_share_suffix", share_suffix),
        (None, open_bracket),
        (None, lambda x, raw: F.btrim(F.regexp_replace(x, r"\([^)]*$", ""))),
        ("stripped_trailing_punctuation", lambda x, raw: F.regexp_replace(x, "[;,]+$", "")),
        ("trimmed_dangling_connector", lambda x, raw: F.btrim(F.regexp_replace(x, r"(?i)((?:[,;]\s*|\s+)(?:and|or|of|in|the))+$", ""))),
    ]


def doubts(statement: Column, label: Column, raw: Column, empty: Column) -> Column:
    """Array of reasons to doubt a trimmed label, in order; ``empty``: the row has no value."""
    low, said = F.lower(label), F.lower(raw)
    found = [
        (reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in DETAIL_WORDS]), "footnote_fragment"),
        (label.rlike(r"\d"), "contains_digits"),
        (label.rlike("[:,;]$"), "dangling_punctuation"),
        (F.contains(label, F.lit("(")) & ~F.contains(label, F.lit(")")), "dangling_parenthesis"),
        (~label.rlike("[A-Za-z]") & ~label.rlike(r"^\s+$"), "non_text_label"),
        (low.isin(NO_LINE), "standalone_fragment"),
        (empty & raw.rlike(r"[\d$,()]+$"), "likely_footnote_row"),
        ((statement == "balance") & said.rlike(SHARE_WORDS) & ~low.rlike(W.SECURITY), "share_details_without_security"),
    ]
    return F.when(label == "", F.array(F.lit("missing_label"))).otherwise(F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in found])))


def normalised(statement: Column, label: Column, raw: Column, empty: Column, rules: list[tuple[list[str], str]] = W.CANONICAL) -> Column:
    """Struct of the label in its canonical form and the reasons, each once and in order.

    An empty label takes the printed line; nulls count as empty.
    """
    none = F.lit(None).cast("string")

    def from_start(t: Column, said: Column) -> Column:
        falls = (t == "") & (F.btrim(said) != "")
        start = F.named_struct(F.lit("x"), F.when(falls, F.btrim(said)).otherwise(t), F.lit("r"), F.array(F.when(falls, F.lit("fallback_to_raw")).otherwise(none)))

        def step(name: str | None, change) -> object:
            def go(s: Column) -> Column:
                return let(change(s["x"], said), lambda y: F.named_struct(F.lit("x"), y, F.lit("r"), F.concat(s["r"], F.array(F.when(y != s["x"], F.lit(name)).otherwise(none))) if name else s["r"]))

            return go

        def trimmed(state: Column) -> Column:
            for name, change in _trims():
                state = let(state, step(name, change))
            return state

        return let(let(start, lambda s: F.when(s["x"].rlike(TOUCHED), trimmed(s)).otherwise(s)), lambda s: let(W.canonical_name(s["x"], said, rules), lambda c: F.named_struct(
            F.lit("label"), F.btrim(F.regexp_replace(c, r"\s+", " ")),
            F.lit("reasons"), F.array_distinct(F.array_compact(F.concat(s["r"], doubts(statement, s["x"], said, empty), F.array(F.when(c == "", F.lit("empty_after_normalization")).otherwise(none))))),
        )))

    return let(F.btrim(F.coalesce(label, F.lit(""))), lambda t: let(F.coalesce(raw, F.lit("")), lambda said: from_start(t, said)))


def dropped_before(raw: Column, empty: Column) -> Column:
    """Rows that the printed line alone gives up: captions of per-share data, share counts of two securities, bare fragments."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words])
    caption = has("per common", "net income") | has("shares used in computing per common share") | F.btrim(low).isin(W.RAW_DROPS)
    return (empty & caption) | has("preferred stock", "common stock", "shares outstanding") | has("per common share:") | has("shares used in computing per common share amounts")


def footnote_row(label: Column, empty: Column) -> Column:
    return empty & label.rlike(W.FOOTNOTE_ROW)


def final_name(label: Column, raw: Column, values: Column) -> Column:
    """Names that depend on the printed line and on the row's magnitude."""
    said = F.lower(F.coalesce(raw, F.lit("")))
    share_line = F.contains(said, F.lit("per common share")) & F.contains(said, F.lit("net income")) & ~F.contains(F.lower(label), F.lit("per share"))
    return let(F.when(share_line, PER_SHARE_LINE).otherwise(label), lambda name: W.per_share_name(name, values))


def by_parent(label: Column, level: Column, parent: Column) -> Column:
    """Restricted cash by the section it stands in, and two names that have a form of their own."""
    low = F.lower(label)
    cash = F.when(F.contains(F.lower(F.coalesce(parent, F.lit(""))), F.lit("current")), "Restricted cash (current)").when(level == 0, "Restricted cash (non-current)").otherwise(label)
    return F.when(low == "restricted cash", cash).when(low == "long-term debt, related party", "Long-term debt (related party)").when(low == "share", PER_SHARE_LINE).otherwise(label)
