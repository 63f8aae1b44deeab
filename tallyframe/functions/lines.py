"""Lines and tokens of statement pages, and the names of their columns: Column -> Column."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import describe as D
from tallyframe.functions.periods import FULL_DATE
from tallyframe.functions.text import let

# What marks lines that are not part of a table.
SKIP_PARTS = ["table of contents", "https://", "http://", "see accompanying"]
SKIP_STARTS = ["page ", "year ended"]
SKIP_ISSUERS = ["electronic arts"]
CURRENCY = ["$", "US$", "U.S.$"]
DASHES = ["-", "–", "—", "−"]
# Titles by statement.
TITLE_LINES = {"income": r"(?i)CONSOLIDATED\s+STATEMENTS?\s+OF\s+(OPERATIONS|INCOME|EARNINGS)", "balance": r"(?i)CONSOLIDATED\s+BALANCE\s+SHEETS?", "cash": r"(?i)CONSOLIDATED\s+STATEMENTS?\s+OF\s+CASH\s+FLOWS?"}
UNSTATED_AUDIT = "Audited/Unaudited: See filing"
TITLES = {"income": "CONSOLIDATED STATEMENTS OF OPERATIONS", "balance": "CONSOLIDATED BALANCE SHEETS", "cash": "CONSOLIDATED STATEMENTS OF CASH FLOWS"}


def skipped_line(text: Column, issuers: list[str] = SKIP_ISSUERS) -> Column:
    """Blank lines, dates, links, page marks, print stamps and running titles."""
    low = F.lower(text)
    part = lambda w: F.contains(low, F.lit(w))
    tests = [F.btrim(low) == "", text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), *[part(w) for w in [*SKIP_PARTS, *issuers]], *[low.startswith(w) for w in SKIP_STARTS]]
    tests += [part(" document") & low.rlike(r"\d{1,2}:\d{2}"), part("ea-") & part(":"), part("consolidated ") & part("statements")]
    return reduce(lambda a, b: a | b, tests)


def one_dash(token: Column) -> Column:
    return F.translate(token, "–—−", "---")


def footnote_token(token: Column) -> Column:
    """Nothing, digits, one letter, or digits and a letter, brackets and dashes aside."""
    bare = F.btrim(one_dash(F.btrim(F.btrim(token), F.lit("()[]{}"))), F.lit("-.,"))
    return (bare == "") | bare.rlike(r"^(?:\d+[A-Za-z]?|[A-Za-z])$")


def numeric_token(token: Column) -> Column:
    """A dash, anything with a digit, or a pair of parentheses."""
    bare = F.btrim(one_dash(F.translate(token, ",$%€£", "")))
    return (bare == "-") | bare.rlike(r"\d") | (F.contains(bare, F.lit("(")) & F.contains(bare, F.lit(")")))


def clean_number(token: Column) -> Column:
    """Digits, separators, signs and parentheses of a number."""
    return F.regexp_replace(one_dash(token), r"[^0-9(),.-]", "")


def near_top_words(tokens: Column, centres: Column, reach: float) -> Column:
    """Tokens (struct with x) within reach of a column; all where no columns are known."""
    return F.filter(tokens, lambda w: F.coalesce(F.array_min(F.transform(centres, lambda c: F.abs(c - w["c"]))) <= reach, F.lit(True)))


def period_labels(text: Column) -> Column:
    """Dates (word, day, year) and four-digit numbers in a line, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z]+\s+\d{1,2},\s+\d{4}|\d{4})"), 1), lambda x: F.btrim(x))


def clean_period(label: Column) -> Column:
    """The date (or year) of a column's name with the last duration that stands before it; names without either stay."""

    def dated(t: Column, pattern: str, counts: str) -> Column:
        def named(found: Column) -> Column:
            prefix = F.substring(t, F.lit(1), F.instr(t, found) - 1)
            kinds = F.regexp_extract_all(prefix, F.lit(rf"(?i)((?:(?:{counts})\s+months?|quarters?|years?)\s+ended)"), 1)
            last = F.regexp_replace(F.try_element_at(kinds, F.lit(-1)), r"\s+", " ")
            return F.when(found != "", F.concat(F.coalesce(F.concat(last, F.lit(" ")), F.lit("")), found))

        return let(F.regexp_extract(t, pattern, 0), named)

    whole = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(label, r"\s+", " ")), r"(?i)\(in .*?\)", ""))
    return let(whole, lambda t: F.coalesce(dated(t, "(?i)" + FULL_DATE, "one|two|three|six|nine|twelve"), dated(t, r"(?:19|20)\d{2}", "three|six|nine|twelve"), t))


# Durations by what a raw name says, first match first.
_DURATIONS = [("six months", "Six Months Ended"), ("nine months", "Nine Months Ended"), ("twelve months", "Twelve Months Ended")]
_SINGLE = [("three months", "Three Months Ended"), *_DURATIONS, ("year ended", "Year Ended"), ("years ended", "Year Ended"), ("quarter ended", "Quarter Ended"), ("quarters ended", "Quarter Ended")]


def column_label(raw: Column, at: Column, columns: Column) -> Column:
    """Name of column ``at`` (from 0) of ``columns``: duration and date; where a raw name holds two durations, the first half of the columns has the shorter one."""

    def kind(low: Column) -> Column:
        has = lambda w: F.contains(low, F.lit(w))
        out = F.when(F.lit(False), low)
        for word, name in _DURATIONS:
            out = out.when(has("three months") & has(word) & (columns >= 4), F.when(at < columns / 2, "Three Months Ended").otherwise(name))
        for word, name in _SINGLE:
            out = out.when(has(word), F.lit(name))
        return out

    def named(clean: Column) -> Column:
        full = F.concat(let(F.lower(raw), kind), F.lit(" "), D.period_end_text(clean, raw))
        return F.coalesce(F.btrim(F.regexp_replace(full, r"\s+", " ")), clean)

    return let(clean_period(raw), named)


def merged_fragments(labels: Column) -> Column:
    """Names of columns where a date and its bare year stand apart put together: ``March 31,`` and ``2025``."""
    year = lambda x: x.rlike(r"^(?:19|20)\d{2}$")
    opens = lambda x: x.endswith(",") | F.lower(x).rlike("ended|months|january|february|march|april|may|june|july|august|september|october|november|december")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a["out"], F.lit(-1))
        joins = year(x) & ~a["full"] & F.coalesce(opens(last), F.lit(False))
        put = F.when(joins, F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), x)))).otherwise(F.concat(a["out"], F.array(x)))
        return F.named_struct(F.lit("out"), put, F.lit("full"), joins)

    return F.aggregate(F.transform(labels, lambda x: F.btrim(x)), start, step, lambda a: a["out"])


def statement_title(statement: Column, text: Column, patterns: dict[str, str] = TITLE_LINES) -> Column:
    """The canonical title of a page's statement by its first line that ``patterns`` has for it, else the usual title."""
    split = F.split(text, "\r\n|\r|\n")
    out = F.lit(None).cast("string")
    for name, usual in TITLES.items():
        found = F.btrim(F.try_element_at(F.filter(split, partial(_matching, patterns[name])), F.lit(1)))
        out = F.when(statement == name, F.when(found.isNull(), usual).otherwise(let(found, partial(_canonical_title, name)))).otherwise(out)
    return out


def _matching(pattern: str, line: Column) -> Column:
    return line.rlike(pattern)


def _canonical_title(statement: str, line: Column) -> Column:
    low = F.lower(line)
    has = lambda *words: reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words])
    if statement == "cash":
        return F.lit(TITLES["cash"])
    title = F.when(has("cash", "flow"), TITLES["cash"])
    if statement == "balance":
        return title.otherwise(TITLES["balance"])
    title = title.when(has("balance"), TITLES["balance"]).when(has("operations"), TITLES["income"])
    return title.when(has("comprehensive", "income"), "CONSOLIDATED STATEMENTS OF COMPREHENSIVE INCOME").when(has("income"), "CONSOLIDATED STATEMENTS OF INCOME").otherwise(line)


def audited(text: Column, unstated: str = "Audited") -> Column:
    return F.when(F.contains(F.lower(text), F.lit("unaudited")), "Unaudited").otherwise(unstated)
