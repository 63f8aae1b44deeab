"""Word boundaries of byte-level BPE without regular expressions, for whole batches of text.

The split rule is the common one: contractions (``'s 't 're 've 'm 'll 'd``), letters, numbers
and other characters with an optional leading space, and white space that leaves its last
character to what follows.  It is a finite automaton.  Every character stands for a transition
function between the automaton's states; composition is associative, so all states of a text
come out of a blocked prefix scan over indices into a precomputed composition table.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Symbols: letter, number, other, space, other white space, quote before [stmd], quote before re|ve|ll, end of a text.
L, N, O, SP, WS, Q1, Q2, END = range(8)
#: States after a character: nothing to continue, a space, a letter, number or other run,
#: one or two characters of a contraction still to come.
S_NONE, S_SPACE, S_L, S_N, S_O, S_C1, S_C2 = range(7)
#: White space as the reference tokenizers see it (fixed values of the Unicode White_Space property).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 32


@cache
def classes() -> np.ndarray:
    """Symbol of every code point, quotes as O."""
    out = np.full(0x110000, O, np.uint8)
    kinds = {"L": L, "N": N}
    for c in range(0x110000):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k is not None:
            out[c] = k
    out[WHITE] = WS
    out[32] = SP
    return out


def _step(state: int, symbol: int) -> int:
    if symbol == END:
        return S_NONE
    if state == S_C2:
        return S_C1
    if state == S_C1:
        return S_NONE
    if symbol in (Q1, Q2):
        if state in (S_SPACE, S_O):  # the quote belongs to a run that has begun
            return S_O
        return S_C1 if symbol == Q1 else S_C2
    return {L: S_L, N: S_N, O: S_O, SP: S_SPACE, WS: S_NONE}[symbol]


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each symbol's function, composition table, value table) of all functions that
    the eight symbols generate; the composition table answers "first a, then b"."""
    funcs = [tuple(_step(s, x) for s in range(7)) for x in range(8)]
    found = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(7)), *funcs]))}
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in list(found):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in found:
                    found[h] = len(found)
                    todo.append(h)
    n = len(found)
    assert n <= 256
    compose = np.zeros((n, n), np.uint8)
    for f, i in found.items():
        for g, j in found.items():
            compose[i, j] = found[tuple(g[x] for x in f)]
    values = np.array(list(found), np.uint8)
    return np.array([found[f] for f in funcs], np.uint8), compose.ravel(), values


def _scan(elements: np.ndarray, compose: np.ndarray, size: int) -> np.ndarray:
    """Inclusive prefix composition: blocks in lockstep, then the block totals, recursively."""
    n = len(elements)
    if n <= BLOCK:
        out = elements.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) * size + int(out[i])]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)  # 0 is the identity
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        grid[i] = np.take(compose, grid[i - 1] * np.intp(size) + grid[i])
    before = np.zeros(rows, np.uint8)
    before[1:] = _scan(grid[-1, :-1].copy(), compose, size)
    grid = np.take(compose, before[None, :] * np.intp(size) + grid)
    return grid.T.ravel()[:n]


def boundaries(texts: list[str]) -> list[list[int]]:
    """For each text the code-point offsets at which pre-tokens start, and its length last; [0] for an empty text.

    All texts are scanned as one array; an end symbol between them resets the automaton.
    """
    if not texts:
        return []
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    at = np.flatnonzero(_starts(cp, ends))
    begins = np.concatenate(([0], ends[:-1] + 1))
    out, lo = [], np.searchsorted(at, begins)
    for b, i, j in zip(begins.tolist(), lo.tolist(), np.searchsorted(at, ends, "right").tolist(), strict=True):
        out.append((at[i:j] - b).tolist())
    return out


def _starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, and at the end of each text."""
    n = len(cp)
    sym = classes()[cp]
    sym[ends] = END
    quotes = np.flatnonzero((cp == 39) & (sym != END))
    if len(quotes):  # the last position is an end, so quotes + 1 exists
        a, b = cp[quotes + 1], cp[np.minimum(quotes + 2, n - 1)]
        a = np.where(sym[quotes + 1] == END, 0, a)
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        sym[quotes[one]] = Q1
        sym[quotes[two]] = Q2
    index, compose, values = monoid()
    states = np.take(values[:, S_NONE], _scan(index[sym], compose, len(values)))
    white = (sym == SP) | (sym == WS)
    kind = np.array([S_L, S_N, S_O, 9, 9, S_O, S_O, 9], np.uint8)[sym]
    start = np.ones(n, bool)
    prev = states[:-1]
    # white: goes on after white, unless it is the last before something
    before_more = np.zeros(n, bool)
    before_more[:-1] = white[:-1] & ~white[1:] & (sym[1:] != END)
    # not white: goes on after its own kind, a space, or inside a contraction
    goes_on = (prev == kind[1:]) | (prev == S_SPACE) | (prev >= S_C1)
    start[1:] = ~np.where(white[1:], white[:-1] & ~before_more[1:], goes_on & (sym[1:] != END))
    return start
