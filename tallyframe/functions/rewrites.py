"""Rewriting line labels: clean-up of what a page prints, canonical names, and which rows to drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import lines as N
from tallyframe.functions.text import let

SECURITY = r"(?:common|preferred|treasury)\s+stock"
# Tests of a cleaned, lower-cased label (all parts; "^": starts with, "=": equal) and what it becomes, in order.
CLEANED = [
    (["accompanying notes"], ""),
    (["^except per share"], ""),
    (["^in "], ""),
    (["^(in "], ""),
    (["net income attributable to amk net income attributable to amkor per common share"], "Net income attributable to Amkor per common share"),
    (["net income (loss) attributable to amk", "per common share"], "Net income attributable to Amkor per common share"),
    (["^net income attributable to amk"], "Net income attributable to Amkor"),
    (["net income attributable to non-controlling interests"], "Net income attributable to non-controlling interests"),
    (["net loss (income) attributable to non-controlling interests"], "Net income attributable to non-controlling interests"),
    (["proceeds from long-term debt", "issuance"], "Proceeds from issuance of long-term debt"),
    (["=retained earnings"], "Retained earnings (accumulated deficit)"),
    (["=retained earnings (accumulated deficit)"], "Retained earnings (accumulated deficit)"),
    (["restricted cash", "short-term investments"], "Restricted cash"),
    (["=shares outstanding"], "Shares outstanding"),
]
# Canonical names, in order; "raw:" tests the printed line.
CANONICAL = [
    (["net income", "per common"], "Net income attributable to Amkor per common share"),
    (["=share", "raw:net income", "raw:per common"], "Net income attributable to Amkor per common share"),
    (["=amounts"], ""),
    (["=amount"], ""),
    (["=amounts:"], ""),
    (["^adjustments to reconcile net income to net cash provided by operating"], "Adjustments to reconcile net income to net cash provided by operating activities"),
    (["^income (loss) before", "unconsolidated"], "Income before equity in earnings of unconsolidated affiliate"),
    (["^income before equity in earnings", "unconsolidated"], "Income before equity in earnings of unconsolidated affiliate"),
    (["^income (loss) before taxes"], "Income before income taxes"),
    (["^income before taxes"], "Income before income taxes"),
    (["=income before income taxes and equity in earnings of unconsolidated affiliate"], "Income before income taxes"),
    (["=income before equity in earnings of unconsolidated"], "Income before equity in earnings of unconsolidated affiliate"),
    (["=total other expense, net"], "Total other (income) expense, net"),
    (["=total other income (expense), net"], "Total other (income) expense, net"),
    (["=net income (loss) attributable to non-controlling interests"], "Net income attributable to non-controlling interests"),
    (["=net income (loss)"], "Net income"),
    (["=net income"], "Net income"),
    (["net increase (decrease) in cash and cash equivalents", "!restricted"], "Net increase (decrease) in cash, cash equivalents and restricted cash"),
    (["=proceeds from long-term debt"], "Proceeds from issuance of long-term debt"),
    (["=proceeds from the issuance of stock through share-based compensation plans"], "Proceeds from issuance of stock through share-based compensation plans"),
    (["=proceeds from issuance of stock through share-based compensation plans"], "Proceeds from issuance of stock through share-based compensation plans"),
    (["=payments for the retirement of debt"], "Payments for retirement of debt"),
    (["=other, net"], "Other, net"),
]
RESET = ["total ", "net ", "gross profit", "operating income", "income before", "beginning cash", "ending cash", "increase (decrease)"]
FOOTNOTE_ROW = (
    r"(?i)(?:accompanying notes|condensed consolidated statements|consolidated statements|\(in thousands|\(in millions|shares issued|issued(?:[,;]|$)|respectively|"
    r"the accompanying notes|shares used in computing per common share amounts|shares used\s+-|net income attributable to amkor per common share)"
)
EMPTY_DROPS = ["net income attributable to amkor", "amounts", "shares used in computing per common share", "shares used"]
RAW_DROPS = ["amounts", "amounts:", "activities", "activity", "affiliate", "unconsolidated affiliate"]
ALWAYS_DROPS = ["shares used in computing per common share", "amounts", "amounts:"]
HELD_REASONS = ["footnote_fragment", "share_details_without_security", "standalone_fragment", "missing_label", "empty_after_normalization"]


def _test(part: str, low: Column, raw: Column) -> Column:
    if part.startswith("raw:"):
        return F.contains(raw, F.lit(part[4:]))
    if part[0] == "~":
        return low.rlike(part[1:])
    if part[0] in "^=!":
        word = F.lit(part[1:])
        return {"^": low.startswith(word), "=": low == word, "!": ~F.contains(low, word)}[part[0]]
    return F.contains(low, F.lit(part))


def by_rules(label: Column, rules: list[tuple[list[str], str]], raw: Column | None = None) -> Column:
    """The output of the first rule whose tests all hold, else the label."""

    def ruled(low: Column, said: Column) -> Column:
        out = F.when(F.lit(False), low)
        for tests, name in rules:
            out = out.when(reduce(lambda a, b: a & b, [_test(t, low, said) for t in tests]), F.lit(name))
        return out

    said = F.lower(F.coalesce(raw if raw is not None else label, F.lit("")))
    return F.coalesce(let(F.lower(label), lambda low: let(said, lambda said: ruled(low, said))), label)


def without_footnotes(label: Column) -> Column:
    """Words without footnote tokens at the end."""
    words = F.filter(F.split(F.btrim(label), r"\s+"), lambda w: w != "")

    def cut(words: Column) -> Column:
        last = F.array_max(F.transform(words, lambda w, i: F.when(~N.footnote_token(w), i + 1)))
        return F.array_join(F.slice(words, 1, F.coalesce(last, F.lit(0))), " ")

    return let(words, cut)


def _sub(t: Column, pattern: str, by: str = "") -> Column:
    return F.btrim(F.regexp_replace(t, "(?i)" + pattern, by))


def _bare(t: Column) -> Column:
    """Without units, share counts and dangling words at the end."""
    for p in (r",?\s*respectively\)?$", r",?\s*respectively\s*\([^)]*\)$", r",?\s*in thousands\)?$", r",?\s*in millions\)?$"):
        t = _sub(t, p)
    t = F.regexp_replace(t, ":+$", "")
    both = lambda x: F.contains(F.lower(x), F.lit("total assets")) & F.contains(F.lower(x), F.lit("liabilities and equity"))
    t = let(t, lambda x: F.when(both(x), _sub(x, r"\bLIABILITIES AND EQUITY\b")).otherwise(x))
    t = F.btrim(_sub(t, r"\bCommitments and contingencies.*$"), F.lit(" ,;"))
    t = let(t, lambda x: F.when(x.rlike("(?i)" + SECURITY), _sub(x, r"[;,]?\s*(?:and\s+)?shares?.*$")).otherwise(x))
    t = F.regexp_replace(_sub(t, r",?\s*shares issued.*$"), r"(?i)\b(and|or)\s+(?:and|or)\b", "$1")
    return _sub(t, r"(?:(?:[,;]\s*|\s+)(?:and|or|of|in|the))+$")


def _named(t: Column) -> Column:
    """Issuer's and securities' names where no rule fits."""

    def last(x: Column) -> Column:
        has = lambda w: F.contains(F.lower(x), F.lit(w))
        computing = has("shares used in computing per common share amounts")
        return (
            F.when(computing & has("diluted") & ~has("basic"), "Diluted")
            .when(computing & has("basic") & ~has("diluted"), "Basic")
            .when(has("preferred stock"), "Preferred stock")
            .when(has("common stock"), "Common stock")
            .otherwise(x)
        )

    return let(F.regexp_replace(t, r"(?i)\bamk\b", "Amkor"), last)


def clean_label(printed: Column) -> Column:
    """A printed line label without footnotes, units, share counts and dangling words; empty if nothing of it names a line."""

    def whole(bare: Column) -> Column:
        counted = F.contains(F.lower(bare), F.lit("shares outstanding"))
        return F.when(counted, "Shares outstanding").otherwise(let(_bare(bare), lambda t: F.when(F.lower(t).isin("", "(", ")", "-"), "").otherwise(let(by_rules(t, CLEANED), lambda r: F.when(r != t, r).otherwise(_named(t))))))

    return let(without_footnotes(printed), whole)


def canonical_name(label: Column, raw: Column, rules: list[tuple[list[str], str]] = CANONICAL) -> Column:
    return by_rules(label, rules, raw)


def per_share_name(label: Column, values: Column) -> Column:
    """Basic and diluted lines by their magnitude: up to ten they are earnings a share, else share counts."""
    kind = F.when(F.coalesce(F.array_max(F.transform(values, lambda v: F.abs(v))) <= 10, F.lit(False)), "Earnings per share - ").otherwise("Shares used - ")

    def named(low: Column) -> Column:
        used = F.contains(low, F.lit("shares used")) & F.contains(low, F.lit("per common share")) & ~low.startswith("shares used -")
        return (
            F.when(low == "basic", F.concat(kind, F.lit("Basic")))
            .when(low == "diluted", F.concat(kind, F.lit("Diluted")))
            .when(used & F.contains(low, F.lit("diluted")), "Shares used - Diluted")
            .when(used & F.contains(low, F.lit("basic")), "Shares used - Basic")
        )

    return F.coalesce(let(F.lower(label), named), label)


def level_of(label: Column, level: Column) -> Column:
    """Totals and results stand at the outermost level."""
    top = let(F.lower(label), lambda low: reduce(lambda a, b: a | b, [low.startswith(p) for p in RESET]))
    return F.when(top, 0).otherwise(level)


def dropped_row(label: Column, raw: Column, empty: Column) -> Column:
    """Rows that are captions of per-share data, footnotes or fragments, by cleaned label and printed line; ``empty``: no value."""

    def judged(label: Column, said: Column) -> Column:
        low = F.lower(label)
        has = lambda *words: reduce(lambda a, b: a & b, [F.contains(said, F.lit(w)) for w in words])
        bare = has("per common", "net income") | F.btrim(said).isin(RAW_DROPS) | has("shares used in computing per common share") | label.rlike(FOOTNOTE_ROW) | low.isin(*EMPTY_DROPS, "activities", "activity", "")
        always = has("preferred stock", "common stock", "shares outstanding") | has("per common share:") | has("shares used in computing per common share amounts") | low.isin(ALWAYS_DROPS)
        return (empty & bare) | always

    return let(label, lambda x: let(F.lower(F.coalesce(raw, F.lit(""))), lambda said: judged(x, said)))


def kept_reasons(label: Column, reasons: Column) -> Column:
    """Suspicions that count: none for shares outstanding, none about its words for a security, an applied alias alone is none."""
    low = F.lower(label)
    held = F.array_except(reasons, F.array(F.lit("alias_applied")))
    return F.when(low == "shares outstanding", F.array().cast("array<string>")).when(low.isin("common stock", "preferred stock", "treasury stock"), F.array_except(held, F.array(*map(F.lit, HELD_REASONS)))).otherwise(held)
