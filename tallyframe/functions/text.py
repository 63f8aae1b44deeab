"""Page-text expressions: Column -> Column, built-in functions only.

Patterns for Spark carry ``(?iU)`` where case and Unicode white space should not matter.
Lexicons and headings are parameters; the values here are defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a statement page.
HEADINGS = {
    "balance": r"(condensed\s+)?(consolidated\s+)?balance\s*[\W_]*\s*sheets?|statements?\s*[\W_]*\s*of\s*[\W_]*\s*financial\s*[\W_]*\s*position",
    "income": r"(condensed\s+)?(consolidated\s+)?statements?\s*[\W_]*\s*of\s*[\W_]*\s*(operations|income|earnings)(?!.*comprehensive)",
    "cash": r"(condensed\s+)?(consolidated\s+)?statements?\s*[\W_]*\s*of\s*[\W_]*\s*cash\s*[\W_]*\s*flows?",
}
ANCHORS = {
    "balance": [
        "total assets", "total liabilities", "cash and cash equivalents", "accounts receivable", "deferred revenue", "stockholders’ equity",
        "stockholders' equity", "total liabilities and stockholders", "total liabilities and shareholders",
    ],
    "income": [
        "revenue", "net revenue", "sales", "cost of revenue", "gross profit", "selling and marketing", "marketing and sales", "research and development",
        "general and administrative", "operating income", "income from operations", "earnings per share", "net income", "net loss",
    ],
    "cash": [
        "net cash provided by operating activities", "net cash used in investing activities", "net cash provided by financing activities",
        "operating activities", "investing activities", "financing activities", "ending cash and cash equivalents",
    ],
}
ANCHOR_MIN = {"balance": 4, "income": 4, "cash": 3}
EXCLUDE = r"\bItem\s+7A\b.*Market\s+Risk\b"
CONTINUED = r"\(continued\)"
CONTENTS = r"Table\s+of\s+Contents"
INDEX_PAGE = r"Index\s+to\s+Consolidated\s+Financial\s+Statements"
OTHER_STATEMENTS = [
    r"statements?\s+of\s+comprehensive\s+income", r"statements?\s+of\s+shareholders'\s+equity",
    r"statements?\s+of\s+stockholders'\s+equity", r"statements?\s+of\s+equity",
]
GROUPED_NUMBER = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: long chains of rules stay as long as they are written."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_case(pattern: str) -> str:
    return "(?iU)" + pattern


def normalise(text: Column) -> Column:
    """Unix line ends, words joined over hyphens at line ends, single blanks, trimmed lines without empty ones."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"-[ \t]*\n\s*", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.btrim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def numeric_density(text: Column) -> Column:
    """Dollar signs and comma-grouped numbers."""
    return F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit(""))) + F.regexp_count(text, F.lit(GROUPED_NUMBER))


def anchor_hits(text: Column, lexicon: list[str]) -> Column:
    """How many entries of the lexicon the text holds, in any case."""
    return let(F.lower(text), lambda low: sum((F.contains(low, F.lit(a)).cast("int") for a in lexicon), F.lit(0)))


def near_top(text: Column, pattern: str, chars: int = 500) -> Column:
    return F.regexp_instr(text, F.lit(pattern)).between(1, chars + 1)


def heading_line(text: Column, pattern: str, lines: int = 6) -> Column:
    """One of the first lines begins with the heading."""
    return F.exists(F.slice(F.split(text, "\n"), 1, lines), lambda x: F.regexp_instr(F.btrim(x), F.lit(pattern)) == 1)


def stop_page(text: Column) -> Column:
    """An index page, or a page of a statement that is not selected; an empty page is neither."""
    hit = text.rlike(any_case(INDEX_PAGE))
    for p in OTHER_STATEMENTS:
        hit = hit | text.rlike(any_case(p))
    return (F.length(F.coalesce(text, F.lit(""))) > 0) & hit


def statement_page(text: Column, heading: str, lexicon: list[str], least: int, density: int = 6) -> Column:
    """All tests of a statement's first page."""
    fit = near_top(text, heading) & heading_line(text, heading) & (anchor_hits(text, lexicon) >= least) & (numeric_density(text) >= density)
    return (F.length(text) > 0) & ~text.rlike(any_case(EXCLUDE)) & ~text.rlike(any_case(INDEX_PAGE)) & fit


def trailing_page_number(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"(\d{1,3})\s*$", 1), F.lit("")).cast("int")
