"""Filter interaction audit: what each of five filters removes in every order of applying them.

Which filters a document fails is a mask of five bits. Everything the audit reports follows from how
many documents of a part have each mask (32 at most), so documents are counted by mask first and the 120
orders work on those counts.

Four filters look at one text. The fifth asks for an identical text with a smaller id anywhere in the
table, which partition refinement answers: documents are split by their length in code points, classes of
one document go; the classes that are left are split by the hash of the first block of bytes, then of the
second, and so on (each block four times as long as the one before, the last one open), and
after each split classes of one go. What survives has a peer that agrees in every block. Its texts
are then compared in full with the text of the least id in its class; texts that differ, if hashes ever
collide, form a class of their own and are compared again.

Large classes are dealt to shares of SHARE_ROWS rows, each with its own copy of the one text to
compare with, so no task holds a class.
"""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, extended, stored

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10
SYMBOLS = re.compile(r"[#$%&*|]")
_UPPER = bytes(range(65, 91))
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of the blocks that split classes one after the other; the last block is the rest of the text.
BLOCKS = [64 << 2 * i for i in range(7)]
#: Rows of a class that one task compares with a copy of its least id's text.
SHARE_ROWS = 1024
#: Classes (of 24 bytes) that are broadcast; more are joined by a shuffle.
FEW_CLASSES = 1 << 20


def failures(text: str) -> int:
    """Bits of the filters on one text that it fails: few words, few distinct words, many capitals, a symbol."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, _UPPER))
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words), 100 * upper > MAX_UPPER * len(text), bool(SYMBOLS.search(text)))
    return sum(1 << i for i, f in enumerate(failed) if f)


def with_masks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``mask`` of the filters on one text in place of ``_text``."""
    return extended(rows, {"mask": "int"}, lambda columns: {"mask": [failures(t) for t in columns[0]]}, ["_text"], drop=["_text"])


def block_hashes(text: Column) -> list[Column]:
    """The hash of each block of the bytes of ``text``; blocks behind its end are alike."""
    raw, at, out = text.cast("binary"), 1, []
    for size in BLOCKS:
        out.append(F.xxhash64(F.substring(raw, F.lit(at), F.lit(size))))
        at += size
    return [*out, F.xxhash64(F.substring(raw, F.lit(at), F.lit((1 << 31) - 1 - at)))]


def signature(length: Column, hashes: list[Column], rounds: int) -> Column:
    """The class after so many rounds: length, then the hashes of that many blocks."""
    return F.xxhash64(length, *hashes[:rounds])


def _few(classes: DataFrame) -> DataFrame:
    """Sent to all tasks where the count shows that they are few."""
    return F.broadcast(classes) if classes.count() <= FEW_CLASSES else classes


def refined(rows: DataFrame) -> DataFrame:
    """sig, n, rep (least id) of the classes of two rows or more that agree in length and all blocks.

    ``rows``: _id, _length and an array of block hashes, _blocks. Each round counts the classes of the rows that
    survived the rounds before and keeps the rows of classes of two or more; classes are counted
    before they are shuffled, and the rows of a large class may be split over tasks when they meet its count.
    """
    hashes = [F.col("_blocks")[i] for i in range(len(BLOCKS) + 1)]
    left = rows
    for k in range(len(hashes) + 1):
        split = left.withColumn("_class", signature(F.col("_length"), hashes, k))
        several = stored(split.groupBy(F.col("_class").alias("sig")).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("rep")).filter("n > 1"), "classes")
        if k == len(hashes):
            return several
        kept = stored(split.join(_few(several.select("sig")), F.col("_class") == F.col("sig"), "left_semi").drop("_class"), "refined")
        if k:
            discard(left)
        left = kept


def duplicates(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """All columns of those ``rows`` (_id, _text, ...) whose text is that of a smaller id."""
    length, hashes = F.length("_text"), block_hashes(F.col("_text"))
    members = stored(rows.withColumn("_sig", signature(length, hashes, len(hashes))).join(_few(classes), F.col("_sig") == F.col("sig")).drop("sig"), "members")
    found = None
    while True:
        shares = F.ceil(F.col("n") / SHARE_ROWS)
        first = members.filter("_id = rep").groupBy(F.col("_sig").alias("f_sig")).agg(F.min("_text").alias("f_text"), F.first("n").alias("n"))
        copies = first.withColumn("f_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("n")
        met = members.withColumn("_share", F.pmod(F.xxhash64("_id", "_sig"), shares)).join(copies, (F.col("_sig") == F.col("f_sig")) & (F.col("_share") == F.col("f_share")))
        same = met.filter("_text = f_text AND _id > rep").select(*rows.columns)
        found = same if found is None else found.unionByName(same)
        other = met.filter("_text <> f_text").drop("_share", "f_sig", "f_share", "f_text", "n", "rep")
        again = stored(other.groupBy(F.col("_sig").alias("a_sig")).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("rep")), "again")
        if not again.count():
            return found
        members = stored(other.join(again, F.col("_sig") == F.col("a_sig")).drop("a_sig"), "members")


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, with those labelled good and toxic among them."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole.alias("_text"))
    narrow = with_masks(rows.withColumn("_length", F.length("_text")).withColumn("_blocks", F.array(*block_hashes(F.col("_text")))))
    narrow = stored(narrow, "masks")
    classes = refined(narrow.filter("_id IS NOT NULL").select("_id", "_length", "_blocks"))
    again = stored(with_masks(duplicates(rows.filter("_id IS NOT NULL"), classes)), "duplicates")
    # a duplicate leaves the count of its mask without the fifth bit and joins that with it
    signed = narrow.select("_id", "part", "mask", F.lit(1).cast("long").alias("n")).unionAll(
        again.select("_id", "part", F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).cast("long").alias("n")), F.struct(F.col("mask").bitwiseOR(DUPLICATE).alias("mask"), F.lit(1).cast("long").alias("n")))).alias("x")).select("_id", "part", "x.mask", "x.n")
    )
    each = signed.groupBy("_id", "part", "mask").agg(F.sum("n").alias("n"))
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("x"))
    named = each.join(told, F.col("_id") == F.col("l_id"), "left")
    counted = named.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("q")), F.lit(0)).alias("good"), F.coalesce(F.sum(F.col("n") * F.col("x")), F.lit(0)).alias("toxic"))
    return counted.filter("n > 0")


def _steps() -> Column:
    """The five steps of all orders: filter_order, step, the filter's bit and the bits before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append(f"struct('{''.join(order)}' AS filter_order, {step} AS step, {bit} AS bit, {before} AS before)")
            before |= bit
    return F.expr(f"array({', '.join(out)})")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for every part, order of the five filters and step in it. Null texts are empty, null parts the empty
    string, a null key equals no other and never fails as a duplicate, equal keys are not smaller than each other, and
    repeated rows count as documents of their own. A document is good or toxic if any label row of its key
    says so; keys without labels are neither. Other columns are ignored; an empty table gives no rows.
    """
    counts = stored(mask_counts(docs, labels, key, text, part), "mask_counts")
    steps = counts.withColumn("_s", F.explode(_steps())).select("part", "mask", "n", "good", "toxic", "_s.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda where, what="n": F.coalesce(F.sum(F.when(where, F.col(what))), F.lit(0)).cast("long")
    # in how many of all orders this filter comes first among those a document fails
    first = F.when(fails, F.col("n") * F.lit(120) / F.bit_count("mask")).cast("long")
    return steps.groupBy("part", "filter_order", F.col("step").cast("int").alias("step"), "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"), F.coalesce(F.sum(first), F.lit(0)).cast("long").alias("shapley"),
    ).drop("bit")


def oracle() -> str:
    """DuckDB SQL for ``audit`` of documents with labels."""
    fails = "(mask & bit) <> 0"
    earlier = "(mask & before) <> 0"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    m AS (SELECT doc_id, part, CAST(len(ws) < {MIN_WORDS} AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws) AS INTEGER)
      + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_UPPER} * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
      + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS INTEGER) AS mask FROM d),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
    c AS (SELECT part, mask, count(*) AS n, sum(coalesce(q, 0)) AS good, sum(coalesce(x, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(list_slice(bits, 1, step - 1)) AS b FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN NOT {fails} AND NOT {earlier} THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN {fails} AND NOT {earlier} THEN n ELSE 0 END) AS BIGINT) AS removed,
      CAST(sum(CASE WHEN {fails} AND {earlier} THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
      CAST(sum(CASE WHEN {fails} AND NOT {earlier} THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN {fails} AND NOT {earlier} THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM c, (SELECT *, coalesce(CAST(b AS INTEGER), 0) AS before FROM s) GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
