"""Language identification of mixed documents by expectation-maximisation.

Training counts hashed byte trigrams of each language. A document is a mixture of languages:
EM over its trigram counts estimates their proportions. Sets of languages grow from the best one alone,
each time by the language that raises the likelihood most; the set with the best penalised likelihood is
chosen, and its largest language is the prediction. How large a set can be is not limited: the
likelihood of all languages together, with what is left to gain by the slope there, bounds that of every
set, and sets stop growing when that bound, less the penalty of the next size, is no better than the best found.

The model holds the counts of the trigrams that each language has, so it grows with labels and what was seen
of them; its buckets are the same for any number of labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import extended, frames

BUCKETS = 1 << 15
#: Counts that a task holds before it hands them on.
HELD = 1 << 22
ROUNDS = 15
#: A language more must gain so many times half the logarithm of the trigrams; neighbouring trigrams share two bytes.
PENALTY = 6.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_NOT_TEXT = re.compile(rb"[\x00-\x20\d!-/:-@\[-`{-~]+")


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every byte trigram of the lower-cased text, runs of what are not letters made one space."""
    raw = np.frombuffer(b" " + _NOT_TEXT.sub(b" ", text.lower().encode("utf-8", "surrogatepass")) + b" ", np.uint8).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77) ^ raw[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return h >> np.uint32(33 - buckets.bit_length())


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


class Table:
    """Smoothed probabilities of buckets by language, kept as the counts that are not zero: those of a bucket stand together."""

    def __init__(self, bucket: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int, buckets: int) -> None:
        order = np.argsort(bucket, kind="stable")
        self.starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.lang, self.n = lang[order].astype(np.int32), n[order].astype(np.float64)
        self.sums = np.bincount(lang, n, languages) + 0.5 * buckets

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Probabilities of the buckets ``at`` (rows) in every language (columns)."""
        out = np.tile(0.5 / self.sums, (len(at), 1))
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        held = np.arange(ends[-1] if len(at) else 0) + np.repeat(first - ends + sizes, sizes)
        lang = self.lang[held]
        out[np.repeat(np.arange(len(at)), sizes), lang] += self.n[held] / self.sums[lang]
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], Table]:
    """Languages in ascending order, and the probability of every bucket in each.

    Every labelled row counts. A task holds an array of counts for each language it meets and hands them on
    when they become many; Spark adds them up, and the driver gathers what is not zero: 12 bytes
    for each trigram bucket that a label has.
    """
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def given() -> Iterator[pd.DataFrame]:
            for name, c in sums.items():
                at = np.flatnonzero(c)
                yield pd.DataFrame({"l": name, "bucket": at, "n": c[at]})
            sums.clear()

        for pdf in batches:
            for t, name in zip(pdf["t"].tolist(), pdf["l"].tolist(), strict=True):
                got = np.bincount(grams(t), minlength=BUCKETS)
                if name in sums:
                    sums[name] += got
                else:
                    sums[name] = got
                    if len(sums) * BUCKETS > HELD:
                        yield from given()
        yield from given()

    summed = frames(labelled, count, "l string, bucket long, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.toArrow()
    kinds = rows.column("l").combine_chunks().dictionary_encode() if rows.num_rows else None
    seen = kinds.dictionary.to_pylist() if rows.num_rows else []
    names = sorted(seen)
    place = np.argsort(np.argsort(np.array(seen, object), kind="stable"), kind="stable").astype(np.int64)
    at = place[kinds.indices.to_numpy()] if rows.num_rows else np.zeros(0, np.int64)
    return names, Table(rows.column("bucket").to_numpy(), at, rows.column("n").to_numpy(), len(names), BUCKETS)


def mixture(counts: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of one document: trigram counts, and their probabilities by language."""
    n, k = counts.sum(), probs.shape[1]
    pi = np.full(k, 1.0 / k)
    for _ in range(ROUNDS if k > 1 else 0):
        new = pi * ((counts / (probs @ pi)) @ probs) / n
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    return pi, float(counts @ np.log(probs @ pi))


def ceiling(counts: np.ndarray, probs: np.ndarray, pi: np.ndarray, likelihood: float) -> float:
    """What no proportions of these languages can exceed: the likelihood is concave, so its slope at ``pi`` bounds it."""
    slopes = (counts / (probs @ pi)) @ probs
    return likelihood + float(slopes.max() - counts.sum())


def chosen_set(counts: np.ndarray, probs: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray, float]:
    """Languages (columns), their proportions and the penalised likelihood of the best set on the way from the best language to all."""
    alone = counts @ np.log(probs)
    now = [int(np.argmax(alone))]
    best = (now, np.ones(1), float(alone[now[0]]))
    if probs.shape[1] == 1:
        return best
    most = ceiling(counts, probs, *mixture(counts, probs))
    for size in range(2, probs.shape[1] + 1):
        cost = penalty * (size - 1)
        if most - cost <= best[2]:
            break
        tried = [(*mixture(counts, probs[:, [*now, k]]), k) for k in range(probs.shape[1]) if k not in now]
        pi, likelihood, k = max(tried, key=lambda x: (x[1], -x[2]))
        now = [*now, k]
        if likelihood - cost > best[2]:
            best = (now, pi, likelihood - cost)
    return best


def identify(text: str | None, names: list[str], table: Table | np.ndarray) -> tuple[str, float, str, bool]:
    """Prediction, its proportion, all chosen languages with proportions, and whether the text is like any of them.

    Of equal proportions the language that comes first by name is the prediction.
    """
    if not names or text is None or _LETTER.search(text) is None:
        return UNKNOWN, 0.0, "", False
    c = np.bincount(grams(text, len(table)), minlength=len(table))
    at = np.flatnonzero(c)
    counts, probs = c[at].astype(float), table[at]
    n = counts.sum()
    best_set, best_pi, best = chosen_set(counts, probs, PENALTY * 0.5 * np.log(max(n, 2.0)))
    rank = sorted(zip(best_pi.tolist(), best_set), key=lambda x: (-x[0], x[1]))
    score, lang = min(1.0, rank[0][0]), names[rank[0][1]]
    like = best / n > -np.log(len(table))  # better than all trigrams being as likely
    return lang, score, ",".join(f"{names[i]}:{p:.3f}" for p, i in rank), bool(like)


def predict(docs: DataFrame, model: tuple[list[str], Table], text: str = "text") -> DataFrame:
    """All columns, and lang_pred, score, languages and like (whether the text resembles what was learned).

    A null text, or one without a letter, is ``und`` with score 0. Columns of those names are replaced,
    all others (``text`` too) pass untouched.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = {"lang_pred": "string", "score": "double", "languages": "string", "like": "boolean"}

    def run(columns: list[list]) -> dict[str, list]:
        names, table = shared.value
        got = [identify(t, names, table) for t in columns[0]]
        return {name: [g[i] for g in got] for i, name in enumerate(new)}

    return extended(docs, new, run, [text])


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: learned where the key's crc32 mod 4 is not 2, predicted everywhere.

    A null key counts as an empty text there. Rows of equal keys are predicted each, other columns are ignored, without any
    label every prediction is ``und``, and an empty table gives no rows.
    """
    held = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "languages")
