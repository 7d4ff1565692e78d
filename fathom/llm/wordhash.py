"""Vectorised word hashes for the operators that work in Python tasks.

Words are lower-case runs of letters and digits. Hashes are 64-bit polynomial
sums over the bytes with a fixed random value per byte, finished by a mixing
step; they depend on the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from fathom.llm.common import ship

NOT_WORD = re.compile(r"[\W_]+")
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Characters of text that are worked on at once (one text more at most).
CHUNK = 1 << 20

_powers: list = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value per byte, and the powers of BASE and of its inverse (mod 2^64) up to n."""
    if not _powers or len(_powers[1]) <= n:
        size = max(n + 1, 2 * CHUNK)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)), np.cumprod(up), np.cumprod(down)]
    return tuple(_powers)


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, times a power of the inverse, are hashes of stretches of bytes."""
    value, up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[:len(data)], out=out[1:])
    return out


def stretch_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end)."""
    return mix((total[end] - total[start]) * powers(len(total))[2][start])


def chunks(texts) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def words_of(text: str) -> list[str]:
    return NOT_WORD.sub(" ", text.lower()).split()


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and the first word of each text (one more at the end)."""
    data = [NOT_WORD.sub(" ", t.lower()).encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    inside = flat != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside))))
    start, end = edge[::2], edge[1::2]
    begin = np.cumsum([0, *(len(d) + 1 for d in data)])
    return stretch_hashes(sums(flat), start, end), np.searchsorted(start, begin)


def gram_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on, over the ends of texts too; n - 1 fewer than words."""
    size = len(flat) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    _, up, _ = powers(n)
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total += flat[j:j + size] * up[j + 1]
    return mix(total)


def shingles(texts, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the word n-grams of each text; of all its words when it has fewer."""
    flat, first = word_hashes(texts)
    grams = gram_hashes(flat, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        else:
            out.append(mix(np.array([np.sum(flat[a:b] * powers(n)[1][1:b - a + 1]) + np.uint64(b - a)], np.uint64)))
    return out


ship(__name__)
