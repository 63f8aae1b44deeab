"""The label fixpoint against a sequential version in plain Python, one row and one statement at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import normalise as M
from tallyframe.functions import rewrites as W
from tallyframe.operators import relabel

SCHEMA = "doc_id int, statement string, order_index int, level int, label string, raw string, values array<double>, page int"
STOCK = re.compile(W.SECURITY, re.I)


def canonical(label, raw):
    low, said = label.lower(), raw.lower()

    def holds(test):
        if test.startswith("raw:"):
            return test[4:] in said
        return {"^": low.startswith(test[1:]), "=": low == test[1:], "!": test[1:] not in low}.get(test[0], test in low)

    return next((out for tests, out in W.CANONICAL if all(map(holds, tests))), label)


def normal(statement, label, raw, empty):
    """Trimmed and canonical label with its reasons."""
    why = []

    def turn(new, name):
        nonlocal x
        if name and new != x:
            why.append(name)
        x = new

    x = label.strip()
    if not x and raw.strip():
        turn(raw.strip(), "fallback_to_raw")
    turn(re.sub(r"(?i)\b(and|or|of|in|the)\s+(and|or|of|in|the)\b", r"\1", x), "collapsed_connectors")
    turn(re.sub(r"(?i)[;,]?\s*respectively\)?$", "", x).strip(), "dropped_respectively")
    if STOCK.search(raw):
        turn(re.sub(r"(?i)[;,]?\s*(and\s+)?(?:\d[\d,()]*\s+)?shares?.*$", "", x).strip(), "trimmed_share_suffix")
    if "(" in x and ")" not in x and x.split("(")[0].strip():
        turn(x.split("(")[0].strip(), None)
    turn(re.sub(r"\([^)]*$", "", x).strip(), None)
    turn(x.rstrip(";,"), "stripped_trailing_punctuation")
    while (cut := re.sub(r"(?i)(?:[,;]\s*|\s+)(?:and|or|of|in|the)$", "", x).strip()) != x:
        turn(cut, "trimmed_dangling_connector")
    low, said = x.lower(), raw.lower()
    if not x:
        why.append("missing_label")
    else:
        tests = {
            "footnote_fragment": any(w in low for w in M.DETAIL_WORDS), "contains_digits": re.search(r"\d", x), "dangling_punctuation": x[-1] in ":,;",
            "dangling_parenthesis": "(" in x and ")" not in x, "non_text_label": not re.search("[A-Za-z]", x), "standalone_fragment": low in M.NO_LINE,
            "likely_footnote_row": empty and re.search(r"[\d$,()]+$", raw),
            "share_details_without_security": statement == "balance" and re.search("shares?|issued|outstanding|authorized", said) and not STOCK.search(x),
        }
        why += [name for name, hit in tests.items() if hit]
    x = canonical(x, raw)
    if not x:
        why.append("empty_after_normalization")
    return " ".join(x.split()), list(dict.fromkeys(why))


def one_pass(statement, rows, aliases):
    """One walk over the rows; True where something went."""
    gone, stack = set(), {}
    for i, r in enumerate(rows):
        said, empty = r["raw"].lower(), all(v is None for v in r["values"])
        if empty and (("per common" in said and "net income" in said) or said.strip() in W.RAW_DROPS or "shares used in computing per common share" in said):
            gone.add(i)
            continue
        if all(w in said for w in ("preferred stock", "common stock", "shares outstanding")) or "per common share:" in said or "shares used in computing per common share amounts" in said:
            gone.add(i)
            continue
        x, why = normal(statement, r["label"], r["raw"], empty)
        y = re.sub(" +", " ", x.strip().replace("\t", " "))
        y = y[:-1].strip() if y.endswith(":") and y.count(":") == 1 else y
        y = aliases.get((statement, y.lower()), y)
        if y and y != x:
            why = [*why, "alias_applied"]
        name = (y or x or r["raw"]).strip()
        if "per common share" in said and "net income" in said and "per share" not in name.lower():
            name = M.PER_SHARE_LINE
        if not name:
            if empty:
                gone.add(i)
                continue
            name = r["label"] or r["raw"] or f"Line {i + 1}"
        most = max((abs(v) for v in r["values"] if v is not None), default=None)
        kind = "Earnings per share" if most is not None and most <= 10 else "Shares used"
        low = name.lower()
        if low in ("basic", "diluted"):
            name = f"{kind} - {low.capitalize()}"
        elif "shares used" in low and "per common share" in low and not low.startswith("shares used -"):
            name = next((f"Shares used - {w.capitalize()}" for w in ("diluted", "basic") if w in low), name)
        low, level = name.lower(), r["level"]
        r["label"] = name
        if empty and low in ("activities", "activity"):
            gone.add(i)
            continue
        if low == "restricted cash":
            name = "Restricted cash (current)" if level and "current" in stack.get(level - 1, "").lower() else "Restricted cash (non-current)" if level == 0 else name
        name = {"long-term debt, related party": "Long-term debt (related party)", "share": M.PER_SHARE_LINE}.get(low, name)
        r["label"] = name
        if low == "shares outstanding":
            why = []
        if name.lower() in M.SECURITIES:
            why = [w for w in why if w not in W.HELD_REASONS]
        r["reasons"] = [w for w in why if w != "alias_applied"]
        stack = {k: v for k, v in stack.items() if k < level} | {level: name}
    for i, r in enumerate(rows):
        patterns = M.FRAGMENTS.get(r["label"].strip().lower())
        if patterns and any(v is not None for v in r["values"]):
            above = [q for q in rows[:i] if q["level"] < r["level"] and any(p in q["label"].lower() for p in patterns)]
            if above and all(v is None for v in above[-1]["values"]):
                above[-1]["values"] = r["values"]
                gone.add(i)
    names = [r["label"].lower() for r in rows]
    empty = [all(v is None for v in r["values"]) for r in rows]
    for found in (gone, {i for i, n in enumerate(names) if empty[i] and names.count(n) > 1}, {i for i, n in enumerate(names) if n in W.ALWAYS_DROPS}, {i for i, n in enumerate(names) if empty[i] and n in W.EMPTY_DROPS}):
        if found:
            rows[:] = [r for i, r in enumerate(rows) if i not in found]
            return True
    for r, n in zip(rows, names):
        if names.count(n) > 1:
            r["reasons"] = [*r["reasons"], "duplicate_after_normalization"]
    return False


def brute(rows, aliases):
    out = []
    for key in dict.fromkeys(r[:2] for r in rows):
        mine = [dict(order=r[2], level=r[3] or 0, label=r[4] or "", raw=r[5] or "", values=list(r[6] or [])) for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])]
        mine = [r for r in mine if not (all(v is None for v in r["values"]) and re.search(W.FOOTNOTE_ROW[4:], r["label"], re.I))]
        while one_pass(key[1], mine, aliases):
            pass
        out += [(*key, r["order"], r["level"], r["label"], tuple(r["values"]), tuple(r["reasons"])) for r in mine]
    return sorted(out)


LABELS = [
    "Restricted cash", "Current assets:", "Total current assets", "Affiliate", "Unconsolidated affiliate", "Income before income taxes and equity in earnings of unconsolidated affiliate",
    "Income before equity in earnings of unconsolidated", "Basic", "Diluted", "Amounts", "Shares used", "Net income attributable to Amkor", "Net sales", "net  sales", "Activities", "Activity:",
    "Common stock, 12 shares issued and", "Preferred stock; shares", "Inventories, respectively)", "Cost of of sales", "Other (loss", "Long-term debt, related party", "Share", "Shares outstanding",
    "Shares used in computing per common share amounts Basic", "Line 3 and", "", None, "12", "Total other expense, net", "(", "issued", "Adjustments to reconcile net income to net cash provided by operating x",
]
RAWS = [None, "", "Amounts", "Net income per common share 4.10", "Common stock, 12 shares issued", "Basic 1,200", "Affiliate", "net income per common share:", "preferred stock common stock shares outstanding", "Notes (2)"]
ALIASES = [("income", "Net sales", "Revenue"), ("balance", "net sales:", "Sales"), ("income", "Inventories", "Share"), ("cash", "Restricted cash", "Cash")]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_statements(spark, seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(120):
        for i in range(rng.randrange(1, 14)):
            label = rng.choice(LABELS)
            values = rng.choice([[None, None], [None, None], [4.0, None], [250.0, 3.0], [], None, [-11.0, 2.0]])
            rows.append((doc, ["income", "balance", "cash"][doc % 3], 3 * i, rng.choice([0, 0, 1, 1, 2, None]), label, rng.choice([label, label, *RAWS]), values, i))
    known = {(s, " ".join(k.split()).rstrip(":").lower()): v for s, k, v in ALIASES}
    got = relabel.settled(spark.createDataFrame(rows, SCHEMA).repartition(3), ["doc_id", "statement"], aliases=spark.createDataFrame(ALIASES, "statement string, key string, value string"))
    mine = sorted((r.doc_id, r.statement, r.order_index, r.level, r.label, tuple(r["values"]), tuple(r.reasons)) for r in got.collect())
    want = brute(rows, known)
    assert len(want) > 300 and {r[2] for r in want} and mine == want


def test_known_answers(spark):
    rows = [
        (1, "income", 1, 0, "Income before equity in earnings of unconsolidated", "x", [None, None], 7), (1, "income", 2, 1, "Affiliate", "Affiliate 5 6", [5.0, 6.0], 7),
        (1, "income", 3, 1, "Amounts", "Amounts", [None, None], 7), (1, "income", 4, 0, "Net sales", "Net sales 1 2", [1.0, 2.0], 8), (1, "income", 5, 0, "net sales", "net sales", [None, None], 8),
        (2, "balance", 1, 0, "Restricted cash", "", [1.0], 1), (2, "balance", 2, 1, "Restricted cash", "", [2.0], 1), (2, "balance", 3, 2, "Restricted cash", "", [3.0], 1), (2, "balance", 4, 2, "Restricted cash", "", [4.0], 1),
    ]
    got = {(r.doc_id, r.order_index): (r.label, r["values"], r.reasons, r.page) for r in relabel.settled(spark.createDataFrame(rows, SCHEMA), ["doc_id", "statement"]).collect()}
    assert got == {
        (1, 1): ("Income before equity in earnings of unconsolidated affiliate", [5.0, 6.0], [], 7), (1, 4): ("Net sales", [1.0, 2.0], [], 8),
        (2, 1): ("Restricted cash (non-current)", [1.0], [], 1), (2, 2): ("Restricted cash (current)", [2.0], ["duplicate_after_normalization"], 1),
        (2, 3): ("Restricted cash (current)", [3.0], ["duplicate_after_normalization"], 1), (2, 4): ("Restricted cash (current)", [4.0], ["duplicate_after_normalization"], 1),
    }


def test_empty_and_hot_statement(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert relabel.settled(none, ["doc_id"]).count() == 0
    long_ = spark.range(3000).selectExpr("1 doc_id", "'cash' statement", "cast(id as int) order_index", "cast(id % 3 as int) level", "if(id % 5 = 0, 'Amounts', concat('line ', id)) label", "'' raw", "array(if(id % 2 = 0, 1.0d, null)) values")
    got = relabel.settled(long_, ["doc_id"])
    assert got.filter(F.col("label") == "Amounts").count() == 0 and got.count() == 2400


def test_labels_that_no_trim_changes_skip_them_all(spark):
    """``TOUCHED`` holds for every label that any trim changes, so the rest may leave them out."""
    import itertools

    from pyspark.sql import functions as F

    from tallyframe.functions import normalise as M

    parts = ["", "Net", "of the", "IN  of", "brandy", "and", ", or", ";the", "respectively", "; Respectively)", "10 shares", "Share", "(a", "(b)", "x;", "y,", "the\n", "common stock", "\tin"]
    rows = spark.createDataFrame([(" ".join(p),) for p in itertools.product(parts, repeat=2)] + [("".join(p),) for p in itertools.product(parts, repeat=2)], "t string").withColumn("t", F.btrim("t"))
    changed = [change(F.col("t"), F.lit("Common stock, shares")) != F.col("t") for _, change in M._trims()]
    found = rows.select(F.col("t").rlike(M.TOUCHED).alias("touched"), F.array_contains(F.array(*changed), True).alias("changed")).collect()
    assert not [r for r in found if r.changed and not r.touched]
    assert sum(r.changed for r in found) > 100 and sum(not r.touched for r in found) > 10
