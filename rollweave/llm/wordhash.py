"""64-bit hashes of words and of runs of words, whole batches of texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Texts are hashed in slices of about so many bytes, to bound the arrays (some 60 bytes a byte of text).
SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])


_POWERS = Powers()


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of values[start:end] of each pair; equal runs have equal hashes wherever they stand."""
    _POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _POWERS.up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def word_hashes(texts: list[str | None], fold: bool = False) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, the word hashes of each text), slice by slice. fold: A-Z count as a-z."""
    at = 0
    while at < len(texts):
        held, size, end = [], 0, at
        while end < len(texts) and (not held or size < SLICE_BYTES):
            held.append((texts[end] or "").encode())
            size += len(held[-1]) + 1
            end += 1
        raw = np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)
        space = _SPACE[raw]
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            turn = np.concatenate([[0], turn])
        starts, ends = turn[0::2], turn[1::2]  # the last byte is white space, so every word ends
        hashes = run_hashes(BYTE_VALUES[_LOWER[raw] if fold else raw], starts, ends)
        first = np.cumsum([0] + [len(h) + 1 for h in held])
        yield at, np.split(hashes, np.searchsorted(starts, first[1:-1]))
        at = end


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(n)
    return run_hashes(words, starts, starts + width)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text as 63-bit values; a shorter text is one shingle, no words none."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    return np.unique(windows(words, min(width, len(words))) >> np.uint64(1)).astype(np.int64)
