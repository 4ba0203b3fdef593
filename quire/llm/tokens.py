"""Words, word hashes and shingles of many texts at once, as flat numpy arrays.

A word is a maximal run of Unicode letters and numbers of the lower-cased text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters that one numpy step takes; a longer text is a step of its own.
STEP = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = sys.maxunicode + 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64: a bijection of 64-bit values that leaves no structure in the low or high bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """Whether a code point is a letter or number."""
    table = np.zeros(_SPACE, np.bool_)
    for c in range(_SPACE):
        if unicodedata.category(chr(c))[0] in "LN":
            table[c] = True
    return table


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def steps(texts: list[str | None], size: int = STEP) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `size` characters, with the index of the first; None counts as empty."""
    at, run, n = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and n + len(t) > size:
            yield at, run
            at, run, n = i, [], 0
        run.append(t)
        n += len(t) + 1
    if run:
        yield at, run


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts joined by line feeds, then start, end and text number of each word."""
    low = [t.lower() for t in texts]
    cs = codes("\n".join(low))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    inside = np.zeros(len(cs) + 2, np.bool_)
    inside[1:-1] = word_table()[cs]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    return cs, start, end, np.searchsorted(ends, start, side="right")


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of every word, in order."""
    cs, start, end, doc = word_spans(texts)
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = STEP * 2
    while size < len(cs) + 1:
        size *= 2
    up, down = powers(size)
    total = np.zeros(len(cs) + 1, np.uint64)
    np.cumsum(mix(cs.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[: len(cs)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), doc


def shingles(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of every run of n words within a text, in order."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = len(words) - n + 1
    h = words[:last].copy()
    for k in range(1, n):
        h = h * np.uint64(0xD1342543DE82EF95) + words[k : last + k]
    whole = doc[:last] == doc[n - 1 :]
    return mix(h[whole]), doc[:last][whole]


def sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text, sorted by text and hash.

    A text of 1 to n-1 words has one shingle, made of all its words; a text without words has none.
    """
    words, doc = word_hashes(texts)
    h, d = shingles(words, doc, n)
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] = extra[has] * np.uint64(0xD1342543DE82EF95) + words[first[has] + k]
        h, d = np.concatenate([h, mix(extra)]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), np.bool_)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]
