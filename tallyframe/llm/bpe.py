"""Byte-level BPE by a rank file: encode to ids, keep offsets, decode."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import extended
from tallyframe.llm.encoders import rank_encoder

#: Characters that are scanned as one array.
BATCH_CHARS = 1_000_000


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    held = 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= BATCH_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode(docs: DataFrame, ranks: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """All columns, and ``ids`` (array of int) of each text; ``offsets``: a column for the byte offset of each id.

    A null text counts as empty and an empty text has no ids.  Every row is encoded by itself,
    so repeated rows, null keys and empty tables need no care; a column named like an output is replaced.
    """

    def run(columns: list[list]) -> dict[str, list]:
        encoder = rank_encoder(ranks)
        packed = [x for g in _groups([t or "" for t in columns[0]]) for x in encoder.encode(g)]
        rows = [np.frombuffer(x, "<u4").astype(np.int32) for x in packed]
        out = {ids: rows}
        if offsets:
            out[offsets] = [np.cumsum([0, *(len(encoder.pieces[i]) for i in r.tolist())][:-1], dtype=np.int64)[: len(r)] for r in rows]
        return out

    return extended(docs, {ids: "array<int>"} | ({offsets: "array<bigint>"} if offsets else {}), run, [text])


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and ``out``: the bytes that the ids stand for; null ids give null."""

    def run(columns: list[list]) -> dict[str, list]:
        encoder = rank_encoder(ranks)
        return {out: [None if x is None else encoder.decode(x) for x in columns[0]]}

    return extended(encoded, {out: "binary"}, run, [ids])


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded and decoded in one pass over each batch.

    Null texts count as empty, null and repeated ids are kept row by row, other columns are not read.
    """

    def run(columns: list[list]) -> dict[str, list]:
        encoder = rank_encoder(ranks)
        packed = [x for g in _groups([t or "" for t in columns[0]]) for x in encoder.encode(g)]
        return {
            "n_tokens": [len(x) // 4 for x in packed],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed],
            "decoded_sha256": [hashlib.sha256(encoder.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in packed],
        }

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return extended(chosen, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, run, ["text"], drop=["text"])
