"""Removal of repeated passages by distributed prefix doubling.

A passage is repeated where ``size`` bytes that start at a position also start elsewhere. Prefix
doubling ranks positions by ever longer prefixes, a longer rank being the pair of the ranks of
its halves, and drops positions whose prefix is unique:

1. Phrases. Cut points are where a hash of the next 16 bytes is small, so they follow the
   content; a phrase runs from one cut to the end of the next one's 16 bytes. Its rank is its
   hash. Unique ones are dropped: no window of ``size`` bytes over a unique phrase is repeated.
2. Rounds. Spark sorts the rank pairs of the positions of phrases and 1, 2, 4, ... phrases on,
   numbers different pairs densely in that order, and drops positions whose pair is unique. The
   new ranks go into the next round at twice the offset, until past the threshold: for each phrase
   the least run that holds every window starting in it is a pair of overlapping ranks of its
   level. If that pair is repeated, so are all those windows.
3. Windows. Positions that the rounds did not decide are ranked by the pair of ranks of their
   two halves of ``size / 2`` bytes, in one more sort.

Texts with equal content are one text with several copies. Sorts take the place as the last
key, so a rank that holds a third of all rows lies over as many tasks as it needs.

``deduplicate_words`` does the same with words in place of bytes: of every window of words the
gram with the least hash is ranked first, and only windows whose gram is repeated are ranked whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, extended, frames, stored

SIZE = 400
#: Bytes that decide a cut; a window has about so many cuts.
GRAM, PER_WINDOW = 16, 10
#: Words of the grams that stand for windows of words.
WORD_GRAM = 8
#: A character of a script without spaces between words is a word of its own.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")
#: Positions whose strings are hashed at once.
PIECE = 1 << 16
#: Bits of a length below its salt.
SALT = 40
#: Ids of the texts with repeats that are sent to all tasks, 16 bytes each; more are met by a shuffle of all texts.
KEYS = 1 << 21

_BYTE = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_WIDE = np.random.default_rng(8).integers(0, 1 << 64, 256, dtype=np.uint64)


def cuts(raw: bytes, size: int) -> np.ndarray:
    """Positions whose GRAM bytes have a small hash: they depend on those bytes alone."""
    if len(raw) < GRAM:
        return np.zeros(0, np.int64)
    h, m, step = _BYTE[np.frombuffer(raw, np.uint8)], np.uint32(0x9E3779B1), 1
    with np.errstate(over="ignore"):
        while step < GRAM:  # the hash of 2, 4, ... bytes is that of its halves
            h = h[:-step] * m + h[step:]
            m, step = m * m, 2 * step
        h ^= h >> np.uint32(15)
        return np.flatnonzero(h * np.uint32(0x85EBCA6B) < np.uint32((1 << 32) // max(2, size // PER_WINDOW)))


def _doubled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of strings from those of their first and last parts."""
    with np.errstate(over="ignore"):
        x = a ^ (a >> np.uint64(29))
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x


def hashes(raw: bytes, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the first and the last ``size / 2`` bytes (rounded up) of the strings of ``size`` bytes at ascending places.

    Those of 2, 4, ... bytes come from their halves, for all places of a piece together.
    """
    half, (one, two) = (size + 1) // 2, np.empty((2, len(at)), np.uint64)
    every, low = np.frombuffer(raw, np.uint8), 0
    while low < len(at):
        start = int(at[low])
        high = int(np.searchsorted(at, start + PIECE))
        h, width = _WIDE[every[start : int(at[high - 1]) + size]], 1
        while 2 * width <= half:
            h, width = _doubled(h[:-width], h[width:]), 2 * width
        own = at[low:high] - start
        for out, x in ((one, own), (two, own + size - half)):
            out[low:high] = _doubled(h[x], h[x + half - width])
        low = high
    return one.view(np.int64), two.view(np.int64)


def _signed(values) -> np.ndarray:
    return np.fromiter(values, np.uint64, len(values)).view(np.int64)


def _keyed(docs: DataFrame, key: str, text: str, columns: list[str] = ()) -> DataFrame:
    """k, raw (the text as bytes), its 96-bit content id d (64 bits) and c (the other 32), and ``columns``."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        *[F.col(f"`{c}`") for c in columns],
        F.col(key).cast("long").alias("k"),
        raw.alias("raw"),
        F.xxhash64(raw).alias("d"),
        F.coalesce(F.conv(F.substring(F.md5(raw), 1, 8), 16, 10).cast("long"), F.lit(0).cast("long")).alias("c"),
    )


def _place(c: int, at: np.ndarray) -> np.ndarray:
    """The other 32 bits of the content id above a position."""
    return (np.uint64(c) << np.uint64(32) | at.astype(np.uint64)).view(np.int64)


def _spread(pdf: pd.DataFrame, ranks: list[str], first: int = 2) -> pd.DataFrame:
    """Rows of a rank that a frame holds more than twice are dealt by place from the third on: bits 40 and up of ``n``.

    The ``first`` two, at different places, go where the rank is judged and make it repeated there.
    """
    nth = pdf.groupby(ranks, sort=False).cumcount().to_numpy()
    with np.errstate(over="ignore"):
        place = (pdf["d"].to_numpy().view(np.uint64) ^ pdf["e"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    far = (place >> np.uint64(44)).astype(np.int64) + 1
    return pdf.assign(n=pdf["n"].to_numpy() | np.where(nth < first, 0, far) << SALT)


def phrases(keyed: DataFrame, size: int) -> DataFrame:
    """h (rank), d, e (content id and position), n (bytes to the next cut) of every phrase of every different text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for pdf in batches:
            hs, ds, es, ns = [], [], [], []
            for raw, d, c in zip(pdf["raw"], pdf["d"].tolist(), pdf["c"].tolist(), strict=True):
                if (d, c) in seen:
                    continue
                seen.add((d, c))
                at = cuts(raw, size)
                if len(at) < 2:
                    continue
                hs += [xxhash.xxh64_intdigest(raw[i : j + GRAM]) for i, j in zip(at.tolist(), at[1:].tolist())]
                ds.append(np.full(len(at) - 1, d, np.int64))
                es.append(_place(c, at[:-1]))
                ns.append(np.diff(at))
            if hs:
                yield _spread(pd.DataFrame({"h": _signed(hs), "d": np.concatenate(ds), "e": np.concatenate(es), "n": np.concatenate(ns)}), ["h"])

    return frames(keyed.select("raw", "d", "c"), run, "h long, d long, e long, n long")


def repeated(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """Rows whose rank stands at more than one place (d, e): sort by rank and place, stream, drop the unique.

    A rank that holds many of the rows is split by place where ``n`` has a salt (see ``_spread``);
    salted rows are known to be repeated. A place may then come twice, salted and not.
    """
    names, salted = rows.columns, "n" in rows.columns
    given = ranks
    ranks = [*ranks, "_salt"] if salted else ranks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not salted:
            yield from judged(batches)
            return
        for out in judged(pdf.assign(_salt=pdf["n"].to_numpy() >> SALT) for pdf in batches):
            yield out.assign(n=out["n"].to_numpy() & (1 << SALT) - 1).drop(columns=["_salt"])

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pick(pdf: pd.DataFrame, last: tuple | None, more: bool) -> pd.DataFrame:
            """Repeated rows of a stretch; ``last``: the place before it of its first rank; more: the first rank is known to be repeated."""
            rank = pdf[ranks].to_numpy()
            new = np.ones(len(pdf), bool)
            new[1:] = (rank[1:] != rank[:-1]).any(axis=1)
            place = pdf[["d", "e"]].to_numpy()
            other = np.zeros(len(pdf), bool)  # another place of the same rank than the row before
            other[1:] = (place[1:] != place[:-1]).any(axis=1) & ~new[1:]
            group = np.cumsum(new) - 1
            several = np.zeros(group[-1] + 1, bool)
            several[group[other]] = True
            if salted:
                several[group[rank[:, -1] > 0]] = True
            if last is not None and (more or tuple(place[0]) != last):
                several[0] = True
            # equal rows (copies of one text) once
            same = np.zeros(len(pdf), bool)
            same[1:] = ~new[1:] & ~other[1:]
            if last is not None and tuple(place[0]) == last:
                same[0] = True
            return pdf[several[group] & ~same]

        held: pd.DataFrame | None = None  # the first row of the last rank, not yet known to be repeated
        rank_now: tuple | None = None
        place_now: tuple | None = None
        known = False
        for pdf in batches:
            first = tuple(pdf[ranks].iloc[0])
            goes_on = rank_now == first
            out = pick(pdf, place_now if goes_on else None, known if goes_on else False)
            if held is not None and goes_on and len(out) and tuple(out[ranks].iloc[0]) == first:
                yield held
                held = None
            if len(out):
                yield out
            end = tuple(pdf[ranks].iloc[-1])
            tail = (pdf[ranks] == pdf[ranks].iloc[-1]).all(axis=1)
            started_here = not (goes_on and end == first)
            if started_here:
                known = len(out) > 0 and tuple(out[ranks].iloc[-1]) == end
                held = None if known else pdf[tail].iloc[:1]
            elif len(out) and tuple(out[ranks].iloc[0]) == first:
                known, held = True, None
            rank_now, place_now = end, tuple(pdf[["d", "e"]].iloc[-1])

    order = [*given, F.shiftright("n", SALT)] if salted else given
    together = rows.repartition(*order).sortWithinPartitions(*order, "d", "e")
    return frames(together, run, rows.schema).select(*names)


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` (places d, e) whose ``keys`` stand at several places, without ``keys``, with ``r``: their dense rank in Spark's sort.

    Sorting goes by keys and place, so equal keys may lie in several partitions. Each partition
    numbers its groups; one row from each tells the driver its number of groups and outermost keys,
    from which follow the ranks before it and whether its outermost groups go on in a neighbour.
    """
    rest = [f for f in rows.schema.fields if f.name not in keys]
    ends = [f"{x}{i}" for x in ("low", "high") for i in range(len(keys))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = waiting = None
        part, group, last_rows = TaskContext.get().partitionId(), -1, 0
        none = dict.fromkeys(["groups", *ends])
        for pdf in batches:
            key = pdf[keys].to_numpy()
            new = np.ones(len(pdf), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            new[0] = tuple(key[0]) != last
            number = group + np.cumsum(new)
            at = number - number[0]
            rows_of = np.bincount(at)
            rows_of[0] += 0 if new[0] else last_rows
            many = rows_of[at] > 1
            out = pdf.drop(columns=keys).assign(p=part, g=number, many=many, **none)
            if waiting is not None:  # the one row so far of the last group
                yield waiting.assign(many=not new[0])
            alone = (at == at[-1]) & (rows_of[-1] == 1)
            waiting = out[alone] if alone.any() else None
            keep = (many | (number == 0)) & ~alone
            if keep.any():
                yield out[keep]
            first = tuple(key[0]) if first is None else first
            group, last, last_rows = int(number[-1]), tuple(key[-1]), int(rows_of[-1])
        if waiting is not None:
            yield waiting
        if last is not None:
            yield pd.DataFrame([dict.fromkeys(f.name for f in rest) | {"p": part, "g": None, "many": None, "groups": group + 1} | dict(zip(ends, [*first, *last], strict=True))], dtype=object)

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rest], "p int, g long, many boolean, groups long", *[f"{c} long" for c in ends]])
    numbered = stored(frames(rows.repartitionByRange(*keys, "d", "e").sortWithinPartitions(*keys, "d", "e"), run, schema), name)
    marks, total, before = [], 0, None
    for r in numbered.filter("groups is not null").orderBy("p").collect():
        low, high = (tuple(r[f"{x}{i}"] for i in range(len(keys))) for x in ("low", "high"))
        joined = low == before
        if joined:
            marks[-1][-1] = True
        marks.append([r["p"], total - joined, joined, r["groups"] - 1, False])
        total, before = total - joined + r["groups"], high
    at = F.broadcast(numbered.sparkSession.createDataFrame(marks, "o_p int, o_off long, o_first boolean, o_g long, o_last boolean"))
    several = F.col("many") | ((F.col("g") == 0) & F.col("o_first")) | ((F.col("g") == F.col("o_g")) & F.col("o_last"))
    out = numbered.filter("groups is null").join(at, F.col("p") == F.col("o_p")).filter(several).select(*[f.name for f in rest], (F.col("o_off") + F.col("g")).alias("r"))
    out.stored_at = numbered.stored_at
    return out


def _by_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows that ascend by text, cut between texts only."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        tail = (pdf["d"] == pdf["d"].iloc[-1]).to_numpy()
        if tail.all():
            held.append(pdf)
            continue
        cut = int(np.flatnonzero(~tail)[-1]) + 1
        yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def started(seen: DataFrame, size: int) -> DataFrame:
    """d, e, n of every repeated phrase once; its rank r; b, bytes to the end of what r ranks; ``level`` and ``o``.

    The least run from the phrase that holds all windows starting in it is the pair of ranks of
    2 ** level phrases at the phrase and ``o`` bytes on; level -1: the next phrases are not all repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_text(batches):
            pdf = pdf[~pdf.duplicated(["d", "e"])]
            d, e, n = (pdf[c].to_numpy() for c in "den")
            total = len(e)
            follow = np.zeros(total, bool)
            follow[1:] = (e[:-1] + n[:-1] == e[1:]) & (d[:-1] == d[1:])
            chain = np.cumsum(~follow)
            end = np.append(np.flatnonzero(~follow)[1:], total)[chain - 1]  # one past the chain's last phrase
            # the least m with bytes(e .. e_m) + GRAM >= n - 1 + size
            stop = np.cumsum(n)
            before = stop - n
            m = np.searchsorted(stop, before + n - 1 + size - GRAM, "left") - np.arange(total) + 1
            ok = np.arange(total) + m <= end
            level = np.where(ok, np.frexp(m.astype(float))[1] - 1, -1)
            second = np.arange(total) + np.where(ok, m - (1 << np.maximum(level, 0)), 0)
            yield pd.DataFrame({"d": d, "e": e, "n": n, "r": pdf["h"].to_numpy(), "b": n, "level": level.astype(np.int32), "o": before[second] - before})

    by_text = seen.repartition("d").sortWithinPartitions("d", "e")
    return frames(by_text, run, "d long, e long, n long, r long, b long, level int, o long")


def paired(rows: DataFrame, level: int) -> DataFrame:
    """Rank pairs (r1, r2 and the offset between them) of the rows of a level: for the next level (final false), and for the phrases that end at this one (final true)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_text(batches):
            d, e, r, b, o = (pdf[c].to_numpy() for c in ("d", "e", "r", "b", "o"))
            change = np.ones(len(pdf), bool)
            change[1:] = (d[1:] != d[:-1]) | (e[1:] >> 32 != e[:-1] >> 32)
            place = (np.cumsum(change) << 32) | (e & 0xFFFFFFFF)
            for final, step in ((False, b), (True, o)):
                # phrases that end at an earlier level are done, and later ones go on
                at = np.flatnonzero(pdf["level"].to_numpy() == level) if final else np.arange(len(pdf))
                other = np.minimum(np.searchsorted(place, place[at] + step[at]), len(place) - 1)
                hit = place[other] == place[at] + step[at]
                i, j = at[hit], other[hit]
                if len(i):
                    yield pd.DataFrame({"r1": r[i], "r2": r[j], "step": step[i], "final": final, "d": d[i], "e": e[i], "n": pdf["n"].to_numpy()[i], "b": b[i] + b[j], "level": pdf["level"].to_numpy()[i], "o": o[i]})

    by_text = rows.repartition("d").sortWithinPartitions("d", "e")
    return frames(by_text, run, "r1 long, r2 long, step long, final boolean, d long, e long, n long, b long, level int, o long")


def settled_phrases(seen: DataFrame, size: int) -> DataFrame:
    """level and r (the name of a run), d, e, n of the phrases whose run is repeated, by rounds of prefix doubling."""
    rows, level, ended, tables = stored(started(seen, size), "ranks-0"), 0, [], []
    tables.append(rows)
    while (rows.agg(F.max("level")).first()[0] or 0) >= max(level, 1):
        pairs = stored(paired(rows, level), f"pairs-{level}")
        judged = ranked(pairs, ["r1", "r2", "step"], f"ranks-{level + 1}")
        discard(pairs)
        tables.append(judged)
        ended.append(judged.filter("final").select(F.lit(level).alias("level"), "r", "d", "e", "n"))
        rows, level = judged.filter(~F.col("final")).drop("final"), level + 1
    none = rows.limit(0).select(F.lit(0).alias("level"), "r", "d", "e", "n")
    out = stored(reduce(DataFrame.union, ended, none), "runs")
    discard(*tables)
    return out


def partners(seen: DataFrame, settled: DataFrame, size: int) -> DataFrame:
    """d, e of settled phrases whose windows others may need to be compared with: one place of each name.

    A window that is ranked by itself, in a text, may be repeated in a settled phrase of another.
    Its first whole phrase then follows a phrase that is not settled; so names whose next phrase
    does so nowhere have no such window. Phrases too long to say are all kept.
    """
    after = settled.select("d", (F.col("e") + F.col("n")).alias("e"))
    open_ = seen.join(after, ["d", "e"], "left_anti").select(F.col("h").alias("hn")).distinct()
    one = settled.groupBy("level", "r").agg(F.min(F.struct("d", "e", "n")).alias("one")).select("one.*")
    follow = seen.dropDuplicates(["d", "e"]).select(F.col("d").alias("x_d"), F.col("e").alias("x_e"), F.col("h").alias("hn"), F.col("n").alias("nn"))
    one = one.join(follow, (F.col("d") == F.col("x_d")) & (F.col("e") + F.col("n") == F.col("x_e")))
    long = F.col("n") + F.col("nn") + GRAM > size
    return one.filter(long).select("d", "e").union(one.filter(~long).join(open_, "hn", "left_semi").select("d", "e"))


def windows(texts: DataFrame, size: int) -> DataFrame:
    """r1, r2, d, e, n of every window that is neither over a unique phrase nor known to be repeated.

    ``texts``: raw, d, c, ``seen`` (starts of its repeated phrases) and ``settled`` (starts of
    phrases all of whose windows are repeated; without those that others are compared with).
    The third and later of equal windows in one text are repeated; neighbours among them are one
    row of ``n`` windows, so a long run of one character is few rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh, known, held = [], [], 0  # (r1, r2, d, e, n) by text
        for pdf in batches:
            for raw, d, c, seen, settled in zip(pdf["raw"], pdf["d"].tolist(), pdf["c"].tolist(), pdf["seen"], pdf["settled"], strict=True):
                last = len(raw) - size
                at = cuts(raw, size)
                out = np.zeros(last + 2, np.int32)

                def drop(low: np.ndarray, high: np.ndarray, out=out, last=last) -> None:
                    low, high = np.maximum(low, 0), np.minimum(high, last)
                    keep = low <= high
                    np.add.at(out, low[keep], 1)
                    np.add.at(out, high[keep] + 1, -1)

                start, end = at[:-1], at[1:]
                known_at = np.zeros(len(raw), np.int8)  # a repeated phrase starts there: 1, a settled one: 2
                known_at[seen] |= 1
                known_at[settled] |= 2
                alone = known_at[start] & 1 == 0
                drop(end[alone] + GRAM - size, start[alone])
                done = known_at[start] & 2 > 0
                drop(start[done], end[done] - 1)
                left = np.flatnonzero(np.cumsum(out[:-1]) == 0)
                if not len(left):
                    continue
                r1, r2 = hashes(raw, left, size)
                place = _place(c, left)
                third = _third(r1, r2)
                if third is not None:
                    more = left[third]
                    begin = np.flatnonzero(np.append(True, np.diff(more) != 1))
                    known.append((r1[third][begin], r2[third][begin], np.full(len(begin), d), place[third][begin], np.diff(np.append(begin, len(more)))))
                    r1, r2, place = r1[~third], r2[~third], place[~third]
                fresh.append((r1, r2, np.full(len(r1), d), place, np.ones(len(r1), np.int64)))
                held += len(r1)
                if held > 200_000:
                    yield from given(fresh, known)
                    fresh, known, held = [], [], 0
        yield from given(fresh, known)

    def given(fresh: list, known: list) -> Iterator[pd.DataFrame]:
        for rows, first in ((fresh, 2), (known, 0)):
            if rows:
                yield _spread(pd.DataFrame(dict(zip(["r1", "r2", "d", "e", "n"], map(np.concatenate, zip(*rows, strict=True)), strict=True))), ["r1", "r2"], first)

    return frames(texts, run, "r1 long, r2 long, d long, e long, n long")


def _third(r1: np.ndarray, r2: np.ndarray) -> np.ndarray | None:
    """True for the third and later row of a pair of ranks; None if there is none."""
    if len(np.unique(r1)) == len(r1):
        return None
    order = np.lexsort((r2, r1))
    a, b = r1[order], r2[order]
    start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    out = np.zeros(len(a), bool)
    out[order] = nth >= 2
    return out if out.any() else None


def _c(e: Column) -> Column:
    return F.shiftrightunsigned(e, 32)


def _at(e: Column) -> Column:
    return e.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int")


def spans(keyed: DataFrame, size: int) -> DataFrame:
    """By content (d, c): copies, and the repeated windows as ``starts`` and ``ends`` of runs of window positions.

    Starts of windows that were ranked one by one, and for settled phrases the first and last
    window; one row per different text that has any, or has copies.
    """
    long = keyed.filter(F.length("raw") >= size)
    seen = stored(repeated(phrases(long, size), ["h"]), "phrases")
    settled = settled_phrases(seen, size)
    done = settled.select("d", "e").join(partners(seen, settled, size), ["d", "e"], "left_anti")
    marks = seen.select("d", "e", F.lit(False).alias("settled")).union(done.select("d", "e", F.lit(True)))
    places = marks.groupBy("d", _c(F.col("e")).alias("c")).agg(
        F.collect_list(F.when(~F.col("settled"), _at(F.col("e")))).alias("seen"), F.collect_list(F.when(F.col("settled"), _at(F.col("e")))).alias("settled")
    )
    # one row of each text does the work of its copies; texts without a cut or a repeated phrase may still hold a repeat
    name = F.coalesce("k", F.lit(-(1 << 63)))
    copies = long.groupBy("d", "c").agg(F.min(name).alias("one"), F.count(F.lit(1)).alias("copies"))
    empty = F.array().cast("array<int>")
    flags = stored(copies.join(places, ["d", "c"], "left").select("d", "c", "one", "copies", F.coalesce("seen", empty).alias("seen"), F.coalesce("settled", empty).alias("settled")), "flags")
    chosen = keyed.join(flags, ["d", "c"]).filter(name <= F.col("one")).select("raw", "d", "c", "seen", "settled")
    ranked = repeated(windows(chosen, size), ["r1", "r2"])
    single = ranked.select("d", _c(F.col("e")).alias("c"), _at(F.col("e")).alias("first"), (_at(F.col("e")) + F.col("n").cast("int") - 1).alias("last"))
    whole = settled.select("d", _c(F.col("e")).alias("c"), _at(F.col("e")).alias("first"), (_at(F.col("e")) + F.col("n").cast("int") - 1).alias("last"))
    lists = single.union(whole).groupBy("d", "c").agg(F.collect_list(F.struct("first", "last")).alias("at"))
    several = flags.filter("copies > 1").select("d", "c", "copies")
    return lists.join(several, ["d", "c"], "full").select("d", "c", F.coalesce("copies", F.lit(1)).alias("copies"), F.col("at.first").alias("starts"), F.col("at.last").alias("ends"))


def _removed(n: int, copies, starts, ends, size: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs of a text."""
    if n < size or (starts is None and not copies > 1):
        return []
    if copies > 1:
        return [(0, n)]
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(np.asarray(ends, np.int64) + size, n), -1)
    inside = np.concatenate(([False], np.cumsum(mark[:-1]) > 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def deduplicate(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256; with ``keep`` also ``kept`` (the remaining bytes) and all columns.

    Bytes under a ``size``-byte string that also starts anywhere else, in the same text or
    another, are removed; null texts count as empty and texts under ``size`` bytes stay whole.
    A repeated row is another text, so all copies lose what they share. Null keys are kept,
    columns of clashing names are replaced by the results, an empty table gives no rows.
    ``kept`` may end inside a UTF-8 character where a passage does.
    """
    if size < 4 * GRAM:
        raise ValueError(f"passages have {4 * GRAM} bytes at least")
    results = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"kept": "binary"} if keep else {})
    rest = [f.name for f in docs.schema.fields if keep and f.name not in {*results, key}]
    own = [f"_{i}" for i in range(len(rest))]

    def run(columns: list[list]) -> dict[str, list]:
        rows = []
        for raw, copies, starts, ends in zip(*columns, strict=True):
            cut = _removed(len(raw), copies or 0, starts, ends, size)
            kept, at = [], 0
            for i, j in cut:
                kept.append(raw[at:i])
                at = j
            kept.append(raw[at:])
            left = b"".join(kept)
            rows.append((len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left))
        return {name: [r[i] for r in rows] for i, name in enumerate(results)}

    # the same rows, dealt by content, serve the search for windows and this join: one shuffle of the texts
    every = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(rest, own, strict=True)], F.col(key).alias("_key"), F.col(text).alias("_text"))
    keyed = _keyed(every, "_key", "_text", own)
    joined = keyed.join(spans(keyed, size), ["d", "c"], "left").drop("d", "c")
    inputs = ["raw", "copies", "starts", "ends"]
    out = extended(joined, results, run, inputs, drop=inputs)
    return out.select(F.col("k").alias(key), *[F.col(o).alias(c) for c, o in zip(rest, own, strict=True)], *results)


def _word_ranks(text: str, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of every window of ``words`` words: its gram's place, and two ranks that name it; and all grams' ranks."""
    found = WORD.findall(text)
    if len(found) < words:
        return None
    level = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in found), np.uint64, len(found))
    width, gram, n = 1, level, len(found) - words + 1
    with np.errstate(over="ignore"):
        while 2 * width <= words:  # the rank of 2, 4, ... words is that of its halves
            x = (level[:-width] ^ (level[:-width] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + level[width:]
            level, width = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9), 2 * width
            if width == WORD_GRAM:
                gram = level
    span = words - (WORD_GRAM if words >= WORD_GRAM else 1) + 1
    least = np.arange(n) + np.lib.stride_tricks.sliding_window_view(gram, span).argmin(axis=1)
    return least, np.stack([level[:n], level[words - width :][:n]]), gram


def _few(held: DataFrame) -> DataFrame | None:
    """The ids of a table by content, for all tasks: texts without any need not move. None if they are too many."""
    return F.broadcast(held.select("d", "c")) if held.count() <= KEYS else None


def word_windows(keyed: DataFrame, words: int) -> DataFrame:
    """d, c, ``copies`` and ``at`` (first words of the windows that stand elsewhere too) of the texts that have any."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hs, ds, es = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t, d, c in zip(pdf["t"], pdf["d"].tolist(), pdf["c"].tolist(), strict=True):
                if (ranks := _word_ranks(t, words)) is not None:
                    at = np.unique(ranks[0])
                    hs.append(ranks[2][at].view(np.int64))
                    ds.append(np.full(len(at), d, np.int64))
                    es.append(_place(c, at))
            yield _spread(pd.DataFrame({"h": np.concatenate(hs), "d": np.concatenate(ds), "e": np.concatenate(es), "n": np.int64(1)}), ["h"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, held = [], 0
            for t, d, c, seen in zip(pdf["t"], pdf["d"].tolist(), pdf["c"].tolist(), pdf["seen"], strict=True):
                least, (r1, r2), _ = _word_ranks(t, words)
                at = np.flatnonzero(np.isin(least, seen))
                parts.append(pd.DataFrame({"r1": r1[at].view(np.int64), "r2": r2[at].view(np.int64), "d": np.int64(d), "e": _place(c, at), "n": np.int64(1)}))
                held += len(at)
                if held > 200_000:
                    yield _spread(pd.concat(parts, ignore_index=True), ["r1", "r2"])
                    parts, held = [], 0
            if parts:
                yield _spread(pd.concat(parts, ignore_index=True), ["r1", "r2"])

    texts = keyed.select("t", "d", "c")
    first = stored(repeated(frames(texts, grams, "h long, d long, e long, n long"), ["h"]), "grams")
    seen = stored(first.groupBy("d", _c(F.col("e")).alias("c")).agg(F.collect_set(_at(F.col("e"))).alias("seen")), "seen")
    few = _few(seen)
    near = texts if few is None else texts.join(few, ["d", "c"], "left_semi")
    named = frames(near.join(seen, ["d", "c"]), whole, "r1 long, r2 long, d long, e long, n long")
    lists = repeated(named, ["r1", "r2"]).groupBy("d", _c(F.col("e")).alias("c")).agg(F.collect_set(_at(F.col("e"))).alias("at"))
    several = keyed.groupBy("d", "c").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return stored(lists.join(several, ["d", "c"], "full").select("d", "c", F.coalesce("copies", F.lit(1)).alias("copies"), "at"), "windows")


def without(text: str, copies: int, at, words: int) -> str:
    """The text without the words of its repeated windows and what stands between them; ``at``: first words of windows."""
    places = [m.span() for m in WORD.finditer(text)]
    last = len(places) - words
    if last < 0 or (copies < 2 and at is None):
        return text
    starts = range(last + 1) if copies > 1 else sorted(at)
    kept, done = [], 0
    for i in starts:
        low, high = places[i][0], places[i + words - 1][1]
        if low > done:
            kept.append(text[done:low])
        done = max(done, high)
    return "".join([*kept, text[done:]])


def deduplicate_words(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all columns, ``text`` without passages of at least ``words`` words that also stand anywhere else.

    Words are what white space parts and, where no spaces part words, characters; passages are
    equal if their words are, whatever white space is between. Repeats may be in the same text or another, also
    overlapping; a repeated row is another text, so all copies lose what they share. Shorter repeats
    stay, null texts stay null, null keys are kept and an empty table gives no rows.
    """
    keyed = _keyed(docs, key, text).select("d", "c", F.col("raw").cast("string").alias("t"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    every = _keyed(docs.toDF(*names), names[docs.columns.index(key)], names[at], names).drop("k", "raw")
    repeats = word_windows(keyed, words)
    few = _few(repeats)
    joined = every.join(repeats, ["d", "c"], "left") if few is None else every.join(few, ["d", "c"], "left_semi").join(repeats, ["d", "c"])

    def run(columns: list[list]) -> dict[str, list]:
        return {names[at]: [t if t is None else without(t, n or 0, x, words) for t, n, x in zip(*columns, strict=True)]}

    out = extended(joined.drop("d", "c"), {names[at]: "string"}, run, [names[at], "copies", "at"], drop=["copies", "at"]).select(*names)
    if few is not None:
        out = out.union(every.join(few, ["d", "c"], "left_anti").select(*names))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def oracle(size: int = SIZE) -> str:
    """DuckDB SQL for ``deduplicate`` over documents: every window of every text, in hexadecimal digits of its bytes."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT r, i, hash(substr(h, 2 * i + 1, {2 * size})) AS k FROM (SELECT r, h, unnest(range(0, CAST(length(h) // 2 - {size} + 1 AS BIGINT))) AS i FROM d WHERE length(h) >= {2 * size})),
    found AS (SELECT w.r, w.i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
    marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {size} THEN 0 ELSE 1 END AS opens FROM found),
    numbered AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
    runs AS (SELECT r, run, min(i) AS low, max(i) + {size} AS high FROM numbered GROUP BY r, run),
    gaps AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM runs),
    cut AS (SELECT r, sum(high - low) AS removed, count(*) AS spans, max(high) AS last, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept FROM gaps JOIN d USING (r) GROUP BY r)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
      sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)"""
