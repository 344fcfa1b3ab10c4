"""Numpy helpers that run inside tasks: hashes of words and of word shingles.

Words are the runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, A-Z lower-cased, which
are the words ``[^\\x20\\x09-\\x0D]+`` of the text. A word's 64-bit hash is a polynomial over a random
byte table, finished by a mixing step; it depends on the word alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[_SPACE] = 0
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; bounds the memory of a task whatever the length of a text.
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segments(a: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about STEP bytes at white space."""
    at = 0
    while at < len(a):
        end = min(at + STEP, len(a))
        while end < len(a):
            spaces = np.flatnonzero(_SPACE[a[end : end + STEP]])
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(end + STEP, len(a))
        yield at, end
        at = end


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts in order, offsets of each text's words)."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    a = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts, hashes = [], []
    for lo, hi in _segments(a):
        s = a[lo:hi]
        word = ~_SPACE[s]
        first = word.copy()
        first[1:] &= ~word[:-1]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        inside = np.flatnonzero(word)
        which = np.cumsum(first)[inside] - 1
        place = inside - at[which]
        powers = np.full(int(place.max()) + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        value = _BYTE[s[inside]] * powers[place]
        heads = np.flatnonzero(first[inside])
        hashes.append(mix(np.add.reduceat(value, heads)))
        starts.append(at + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(parts) + 1, np.int64)
    where = np.concatenate(starts)
    offsets = np.concatenate([[0], np.searchsorted(where, ends)])
    return np.concatenate(hashes), offsets


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of a text's shingles of ``width`` words, repeats kept; a shorter text is one shingle."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, dtype=np.uint64) * _BASE
    for j in range(width):
        total += words[j : j + n] * _ODD[j]
    return mix(total)


def in_pieces(texts: list, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together, one text at least."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
