"""Mixture-controlled packing of documents into fixed token windows.

Every source is a queue of tokens. A deficit round-robin over the queues gives each window its
target share of every source; what a window cannot give in whole tokens is carried to the next.
The round-robin has a closed form: after ``x`` tokens in all, queue ``j`` has given
``floor(x * P_j / T) - floor(x * P_(j-1) / T)`` tokens, where ``P`` are running sums of the
queues' targets and ``T`` is their total.  The difference between that and ``x * t_j / T`` is the
deficit, always under one token.  So each document's windows follow from its place in its queue
alone, on any machine, with no pass over windows: nothing but queue totals is shared.

Where target shares differ from the supply, a queue runs dry early; the others then share its
windows in their own proportions (a new phase of the same form).
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import frames, stored
from tallyframe.llm.encoders import library_encoder

WINDOW = 2048
#: Rows (source and input partition) of queue positions that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass
class Schedule:
    """Who gives which tokens: phases of (first token in all, tokens, running sums over queues, what each queue gave before)."""

    supply: list[int]
    phases: list[tuple[int, int, list[int], list[int]]]

    @classmethod
    def of(cls, supply: list[int], shares: list[float] | None = None) -> Schedule:
        """``shares``: target proportions by queue; None: those of the supply. Queues without a target wait for the end."""
        phases, given, start = [], [0] * len(supply), 0
        while any(s > g for s, g in zip(supply, given, strict=True)):
            left = [s - g for s, g in zip(supply, given, strict=True)]
            want = left if shares is None else [w if n else 0.0 for w, n in zip(shares, left, strict=True)]
            if not any(want):
                want = left
            # the queue that runs dry first ends the phase
            rounds = min(n / w for n, w in zip(left, want, strict=True) if w > 0)
            take = [min(n, round(rounds * w)) for n, w in zip(left, want, strict=True)]
            if not any(take):
                take = left
            sums = np.cumsum(np.array(take, dtype=object)).tolist()
            phases.append((start, sums[-1], sums, given))
            start, given = start + sums[-1], [g + t for g, t in zip(given, take, strict=True)]
        return cls(supply, phases)

    @property
    def total(self) -> int:
        return sum(self.supply)

    def given(self, upto: int, x: int) -> int:
        """Tokens that queues 0..upto have given together after ``x`` tokens in all."""
        if upto < 0 or not self.phases:
            return 0
        if len(self.phases) == 1:  # as it is without targets
            return x * self.phases[0][2][upto] // self.phases[0][1]
        start, n, sums, before = self.phases[max(0, bisect.bisect_right(self.phases, x, key=lambda p: p[0]) - 1)]
        return sum(before[: upto + 1]) + (x - start) * sums[upto] // n

    def served(self, queue: int, x: int) -> int:
        return self.given(queue, x) - self.given(queue - 1, x)

    def window_of(self, queue: int, position: int, window: int) -> int:
        """The window that holds the token at ``position`` of ``queue``: the last whose first token comes no later."""
        low, high = 0, -(-self.total // window) - 1
        # close first guess: positions are near proportional within a phase
        for start, n, sums, before in self.phases:
            own = sums[queue] - (sums[queue - 1] if queue else 0)
            if before[queue] <= position < before[queue] + own:
                guess = (start + (position - before[queue]) * n // own) // window
                low, high = max(0, guess - 2), min(high, guess + 2)
                break
        while low > 0 and self.served(queue, low * window) > position:
            low = max(0, low - 64)
        while high < -(-self.total // window) - 1 and self.served(queue, min(self.total, (high + 1) * window)) <= position:
            high += 64
        high = min(high, -(-self.total // window) - 1)
        while low < high:
            mid = (low + high + 1) // 2
            if self.served(queue, mid * window) <= position:
                low = mid
            else:
                high = mid - 1
        return low


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, source, n, ids (unsigned 32-bit) and the place in the source's queue within the input partition."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end, part = library_encoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        at: dict[str | None, int] = defaultdict(int)
        for pdf in batches:
            ids = [encoder.encode_one(t) + end for t in pdf["text"].tolist()]
            n = [len(x) // 4 for x in ids]
            local = []
            sources = pdf["source"].tolist()
            for s, k in zip(sources, n, strict=True):
                local.append(at[s])
                at[s] += k
            # ids below 65,536 are kept in two bytes
            small = [a.astype("<u2").tobytes() if not len(a) or int(a.max()) < 1 << 16 else x for x, a in ((x, np.frombuffer(x, "<u4")) for x in ids)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "source": sources, "part": part, "local": local, "n": n, "ids": small})

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    return frames(chosen, encode, "doc_id long, source string, part int, local long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, shares: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``shares``: target proportions by source, else those of the corpus.  Null texts count as
    empty (their end id is packed), null sources form one queue, rows with equal ids are
    packed each, other columns are ignored and an empty table gives no rows.  Sources due less
    than one token a window share one queue, so there are ``window`` queues at most.  All
    sequences are full but the last, which is cut at its last token; so padding is under one window.

    Texts are never shuffled: documents stand in a queue by input partition and place in it,
    which the written table of ids fixes.
    """
    spark = docs.sparkSession
    table = stored(encoded(docs, tokenizer, end_id), "packing-ids")
    parts = table.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    by_source = parts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    # due a token a window or more: at most ``window`` sources
    named = by_source.filter(F.col("source").isin(list(shares))) if shares else by_source.filter(F.col("tokens") * F.lit(window) >= F.lit(total))
    heads = [(r["source"], r["tokens"]) for r in named.orderBy(F.desc("tokens"), "source").collect()]
    tail = total - sum(n for _, n in heads)
    while heads and 0 < tail * window < total:
        tail += heads.pop()[1]
    supply = [n for _, n in heads] + ([tail] if tail else [])
    wanted = [shares.get(s, 0.0) for s, _ in heads] + ([0.0] if tail else []) if shares else None
    schedule = Schedule.of(supply, wanted)
    queues = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(heads)], "q_source string, queue int")
    before = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        parts.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("q_source")), "left")
        .withColumn("queue", F.coalesce("queue", F.lit(len(heads))))
        .select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), "queue", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    )
    if parts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = table.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part"))).select(
        "doc_id", "source", "queue", (F.col("base") + F.col("local")).alias("position"), "n", "ids"
    )

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = schedule.total
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in columns}
            add = [x.append for x in out.values()]
            for doc, source, q, a, n, ids in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["source"].tolist(), pdf["queue"].tolist(), pdf["position"].tolist(), pdf["n"].tolist(), pdf["ids"].tolist(), strict=True):
                if len(ids) != 4 * n:
                    ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                k, done = schedule.window_of(q, a, window), 0
                # what the queues before this one, and this one, have given when a window begins
                below = schedule.given(q - 1, k * window)
                first = schedule.given(q, k * window) - below
                while done < n:
                    y = min(last, (k + 1) * window)
                    below_end = schedule.given(q - 1, y)
                    until = schedule.given(q, y) - below_end
                    take = min(n - done, until - a - done)
                    if take > 0:
                        piece = (doc, done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), n, k, below_end - below + a + done - first, source)
                        for put, value in zip(add, piece):
                            put(value)
                        done += take
                    k, first, below = k + 1, until, below_end
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    return frames(placed, pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
