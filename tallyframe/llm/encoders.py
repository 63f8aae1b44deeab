"""Cached byte-level BPE encoders used inside tasks; a worker process keeps its caches from task to task."""

from __future__ import annotations

import base64
import heapq
import os
import sys
from array import array
from functools import cache

import regex

from tallyframe.llm.pretokens import boundaries

#: Entries that a cache holds before it is emptied; bounds a worker's memory, never the result.
CACHE_ENTRIES = 500_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank is merged, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    none = 1 << 60
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        joined = parts[i] + parts[i + 1]
        parts[i : i + 2] = [joined]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pre-tokens, with a heap over a linked list."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(pair := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, pair))
    return [ranks[p] for p in parts if p is not None]


class _Cache(dict):
    """Slice of text -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class RankEncoder:
    """Ids by a rank file: boundaries by scan, slices by cached pair merging; decodes as well."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = {i: p for p, i in self.ranks.items()}
        self.cache = _Cache(lambda s: _packed(merge(s.encode("utf-8"), self.ranks)))

    def encode(self, texts: list[str]) -> list[bytes]:
        got = self.cache
        return [b"".join([got[t[i:j]] for i, j in zip(b, b[1:])]) for t, b in zip(texts, boundaries(texts), strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


#: The library's byte-level split (a fixed pattern).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class _Unsafe(Exception):
    """A piece that begins or ends with white space: the cut beside it may not be the library's."""


class _Pieces(dict):
    """Piece of text, between single spaces -> ids of it with ``lead`` before it."""

    def __init__(self, owner: LibraryEncoder, lead: str) -> None:
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Unsafe
        ids = self.owner.whole(self.lead + piece)
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class LibraryEncoder:
    """Ids by the tokenizers library, which encodes each distinct piece once.

    Texts are cut at single spaces between other characters, where the library's own split
    always cuts too. A piece that is not in the cache is split into pre-tokens, as the
    library does, and each goes through the library's model. Texts with other white space beside a space take a careful cut.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.tokens = _Cache(self._model)
        self.spaced, self.first = _Pieces(self, " "), _Pieces(self, "")

    def _model(self, pretoken: str) -> bytes:
        text = pretoken if pretoken.isascii() else pretoken.encode("utf-8").decode("latin-1")
        return _packed([t.id for t in self.model.tokenize(text.translate(self.letters))])

    def whole(self, piece: str) -> bytes:
        tokens = self.tokens
        if piece[1:].isalpha() and piece[0] == " ":
            return tokens[piece]
        return b"".join([tokens[t] for t in PRETOKEN.findall(piece)])

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]

    def encode_one(self, text: str) -> bytes:
        try:
            pieces = text.split(" ")
            spaced = self.spaced
            head = self.first[pieces[0]]
            del pieces[0]
            return head + b"".join([spaced[p] for p in pieces])
        except _Unsafe:
            return b"".join(map(self.whole, _pieces(text)))


def _pieces(text: str) -> list[str]:
    """``text`` cut before every single space that stands between characters that are not white space."""
    if not text:
        return []
    words = text.split(" ")
    out = [words[0]]
    joins = not words[0] or words[0][-1].isspace()
    for w in words[1:]:
        if joins or not w or w[0].isspace():
            out[-1] += " " + w
        else:
            out.append(" " + w)
        joins = not w or w[-1].isspace()
    return out


@cache
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


@cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)
