"""Quality rules: counts within a document, and line frequency across the documents of a host.

Lines are normalised (lower case, single spaces) and hashed. A line is boilerplate of its host
where more documents hold it than both ``min_docs`` and ``max_share`` of the host's documents: a
line in 6 of 10 documents of a small host, in more than a tenth of a typical one, in more than a
tenth of one that has a third of all rows. Exact copies of a text count as one document unless
``copies`` is set, so a text copied many times does not turn its own lines into boilerplate.
Boilerplate lines are removed; a document that this depletes is rejected.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import extended, stored

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: What parts words (fixed: ASCII white space).
BLANKS = " \t\n\r\x0b\x0c"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words
MIN_DOCS = 5
MAX_SHARE = 0.1
MAX_REMOVED = 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first one included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    inside = np.zeros(n + 2, bool)
    inside[:-2] = hit
    inside[1:-1] |= hit
    inside[2:] |= hit
    return int(inside.sum())


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and words of every line that has a word, in order."""
    hashes, counts = [], []
    for line in text.lower().encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if words:
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            counts.append(len(words))
    return hashes, counts


def describe(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes and their words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    # code points are the bytes that do not continue one
    chars = sum(map(len, words)) if len(raw) == len(text) else sum(len(w.decode("utf-8", "surrogatepass")) for w in words)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words), *line_hashes(text))


def described(chosen: DataFrame) -> DataFrame:
    """``chosen`` without _text; with a row number, the counts, and the hashes and words of its lines."""

    def run(columns: list[list]) -> dict[str, list]:
        rows = [describe(t) for t in columns[0]]
        out = {name: [r[i] for r in rows] for i, name in enumerate(COUNTS)}
        return out | {"_lines": [np.array(r[5], np.uint64).view(np.int64) for r in rows], "_counts": [r[6] for r in rows]}

    new = {c: "long" for c in COUNTS} | {"_lines": "array<long>", "_counts": "array<int>"}
    return extended(chosen, new, run, ["_text"], drop=["_text"]).withColumn("_row", F.monotonically_increasing_id())


def boilerplate(rows: DataFrame, min_docs: int, max_share: float, copies: bool) -> DataFrame:
    """_host, _line of lines in too many documents of their host."""
    each = rows.select("_host", "_content", "_lines")
    each = each if copies else each.dropDuplicates(["_host", "_content"])
    totals = each.groupBy(F.col("_host").alias("t_host")).agg(F.count(F.lit(1)).alias("docs"))
    lines = each.select("_host", F.explode(F.array_distinct("_lines")).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("holders"))
    often = lines.filter(F.col("holders") > min_docs).join(totals, F.col("_host") == F.col("t_host"))
    return often.filter(F.col("holders") > F.col("docs") * max_share).select("_host", "_line")


def quality(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED,
    min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED, copies: bool = False, keep: bool = False,
) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_line_words per document.

    ``n_line_words``: words in boilerplate lines. A document is kept if it has ``min_words``
    words, no more than ``max_repeated`` per cent of them in repeated 3-word windows, and if
    without its boilerplate lines it still has ``min_words`` words and more than ``1 - max_removed`` of all.
    With ``keep`` the columns of ``docs`` come first and ``text`` loses its boilerplate lines.

    Null texts have no words and fail, null hosts are one host, repeated rows are documents of
    their own in the result, null keys are kept, columns named like a result are replaced, others
    may have any name, and an empty table gives no rows.
    """
    results = [*COUNTS, "base_failed", "kept", "n_line_words"]
    columns = [c for c in docs.columns if keep and c not in results]
    own = [f"_c{i}" for i in range(len(columns))]
    whole = F.coalesce(F.col(text), F.lit(""))
    chosen = docs.select(
        *[F.col(f"`{c}`").alias(o) for c, o in zip(columns, own, strict=True)], F.col(key).cast("long").alias("_key"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), whole.alias("_text"), F.xxhash64(whole).alias("_content"),
    )
    rows = stored(described(chosen), "quality")
    lines = stored(boilerplate(rows, min_docs, max_share, copies), "boilerplate")
    each = rows.select("_row", "_host", F.explode(F.arrays_zip("_lines", "_counts")).alias("_x")).select("_row", "_host", F.col("_x._lines").alias("_line"), F.col("_x._counts").alias("_n"))
    hit = each.join(lines, ["_host", "_line"]).groupBy("_row").agg(F.sum("_n").alias("n_line_words"), F.collect_set("_line").alias("_hit"))
    named = rows.drop("_lines", "_counts", "_content", "_host").join(hit, "_row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    judged = named.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= min_words) & (F.col("n_line_words") < F.col("n_words") * max_removed))
    if not keep:
        return judged.select(F.col("_key").alias(key), *results)
    at = own[columns.index(text)]

    def strip(columns: list[list]) -> dict[str, list]:
        out = []
        for t, bad in zip(*columns, strict=True):
            if t is not None and bad:
                bad = set(bad)
                t = "\n".join(x for x in t.split("\n") if not (h := line_hashes(x)[0]) or int(np.uint64(h[0]).view(np.int64)) not in bad)
            out.append(t)
        return {at: out}

    final = extended(judged.select(*own, *results, "_hit"), {at: "string"}, strip, [at, "_hit"], drop=["_hit"])
    return final.select(*[F.col(o).alias(c) for o, c in zip(own, columns, strict=True)], *results)


def oracle() -> str:
    """DuckDB SQL for ``quality`` over documents with the default limits."""
    word = r"[^\x20\x09-\x0D]+"
    line = f"array_to_string(regexp_extract_all(lower(line), '{word}'), ' ')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
    w AS (SELECT r, doc_id, t, host, regexp_extract_all(t, '{word}') AS ws, string_split(t, chr(10)) AS ls FROM d),
    grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
    repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
    lines AS (SELECT r, t, host, line, {line} AS l, len(regexp_extract_all(line, '{word}')) AS n FROM (SELECT r, t, host, unnest(ls) AS line FROM w)),
    worded AS (SELECT * FROM lines WHERE n > 0),
    dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY r),
    hosts AS (SELECT host, count(DISTINCT t) AS docs FROM w GROUP BY host),
    bad AS (SELECT host, l FROM (SELECT host, l, count(DISTINCT t) AS holders FROM worded GROUP BY host, l) JOIN hosts USING (host) WHERE holders > {MIN_DOCS} AND holders > docs * {MAX_SHARE}),
    hit AS (SELECT r, sum(n) AS n FROM worded JOIN bad USING (host, l) GROUP BY r),
    c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_line_words
      FROM w LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN hit USING (r)),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND n_words - n_line_words >= {MIN_WORDS} AND n_line_words < n_words * {MAX_REMOVED} AS kept, n_line_words FROM f"""
