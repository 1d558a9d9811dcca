"""Word and shingle hashes of many texts at once, as numpy array work.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z are lower-cased. Every word gets a 64-bit
polynomial hash over random byte codes; a shingle's hash combines the hashes of five consecutive words. Two
different shingles of the same pair of documents share a hash with a chance below one in 10**12, so sets of
hashes stand for sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WIDTH = 5
#: Texts are hashed in groups of about this many bytes, so memory stays flat however many there are.
GROUP_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACES = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, GROUP_BYTES * 2), base, dtype=np.uint64)
        grown[0] = 1
        have = _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and ``bounds``: text i has words bounds[i]:bounds[i + 1]."""
    joined = b" ".join(texts) + b" "
    raw = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_CODES[raw] * _power(_BASE, len(raw)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(pow(_BASE, -1, 1 << 64), len(raw))[starts])
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return hashes, np.searchsorted(starts, offsets)


def groups(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about GROUP_BYTES; a longer text is alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: Sequence[bytes | None]) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; below five words the whole sequence is the only one, without words there is none."""
    texts = [t or b"" for t in texts]
    for a, b in groups(texts):
        words, bounds = word_hashes(texts[a:b])
        n = len(words)
        if n >= WIDTH:
            windows = words[: n - WIDTH + 1] * _PLACES[0]
            for k in range(1, WIDTH):
                windows = windows + words[k : n - WIDTH + 1 + k] * _PLACES[k]
            windows = mix(windows)
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            if y - x >= WIDTH:
                yield np.unique(windows[x : y - WIDTH + 1])
            elif y > x:
                yield mix((words[x:y] * _PLACES[: y - x]).sum(dtype=np.uint64, keepdims=True) + np.uint64(y - x))
            else:
                yield np.empty(0, dtype=np.uint64)
