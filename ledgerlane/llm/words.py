"""Hashing of all words of many texts at once, with numpy inside a task.

A word's hash is a sum of its bytes times random odd weights by position, then mixed: two different words share one
of 2**64 values by chance alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes (as UTF-8) that one numpy step works on, unless a single text is longer.
STEP_BYTES = 1 << 20

SPACES = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: Everything but white space; and letters, digits and all non-ASCII bytes only.
UNSPACED = ~SPACES
LETTERS = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint64) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_weights(n: int, seed: int) -> np.ndarray:
    """The first n of an endless row of random odd numbers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


def steps(texts: list[str | None], limit: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of the texts of about that many characters each, one text at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def word_hashes(texts: list[str | None], keep: np.ndarray = UNSPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, A-Z as a-z, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    blob = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    bounds = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    inside = keep[blob]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    weighed = _LOWER[blob[inside]] * odd_weights(int(lengths.max()), 1)[place]
    return mix(np.add.reduceat(weighed, firsts) + lengths.astype(np.uint64)), counts


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours; the last n - 1 places are left out."""
    weights = odd_weights(n, 2)
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out += hashes[k:k + size] * weights[k]
    return mix(out)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    A text with fewer words has its whole sequence as the only one, a text without words none.
    """
    out: list[np.ndarray] = []
    for part in steps(texts):
        hashes, counts = word_hashes(texts[part])
        every = windows(hashes, n)
        ends = np.cumsum(counts)
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            if count >= n:
                out.append(np.unique(every[end - count:end - n + 1]))
            else:
                out.append(windows(hashes[end - count:end], count) if count else np.empty(0, np.uint64))
    return out
