"""Distinct word shingles of texts as 64-bit hashes, worked out for many texts at a time."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(2024)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(1 << 16, _STEP, np.uint64))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, and how many words lie before the end of each text."""
    raw = [t.encode().lower() for t in texts]  # bytes: only ASCII letters change
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    solid = ~_SPACE[data]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # places in ``at`` where words begin
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    hashes = np.add.reduceat(_BYTE[data[at]] * _POWERS[place & 0xFFFF], first)
    return scramble(hashes + size.astype(np.uint64)), np.searchsorted(at[first], ends)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a text of fewer words is one shingle, one without words has none."""
    hashes, ends = word_hashes(texts)
    turn = np.cumprod(np.full(words, _TURN, np.uint64))
    runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        runs += hashes[j : j + len(runs)] * turn[j]
    runs = scramble(runs)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= words:
            out.append(np.unique(runs[start : end - words + 1]))
        elif end > start:
            few = hashes[start:end]
            out.append(scramble((few * turn[: len(few)]).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(len(few))))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out
