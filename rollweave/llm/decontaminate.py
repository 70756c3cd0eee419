"""Benchmark decontamination by SimHash windows of the items' sizes.

For each item of n words, windows of n words are looked for in the documents; a document of fewer words is
one window, its whole text. A window and an item are
described by their five-word shingles, each weighted by how often it occurs. Windows that could be similar
enough get a 64-bit SimHash (weighted signs of the shingles' hashes, from prefix sums); an index over eight
blocks of eight bits finds every item whose fingerprint lies within the radius, for a pair within 23 bits
agrees up to two bits in one block at least; the exact weighted similarity (sum of least over sum of
greatest weights) decides.

Only windows can be similar enough of which eight ninths of the shingles at least occur in some item (for
0.8; of a whole shorter text, four ninths of its own and the item's shingles together), so no others are
fingerprinted; the test is exact. At a similarity of 0.8 the expected distance is
about 10 bits with a deviation of 3, so a radius of 23 misses next to none.

Items are handled in slices of bounded size, each a pass over the documents. A-Z count as a-z.

Defined results: items or texts without words match nothing; items without an id are items each, reported with a
NULL item_id; an item shorter than a shingle is one shingle;
rows that repeat a doc_id are judged each; of equally similar windows the first is reported; empty tables
give no rows; other columns are ignored (contaminated) or kept (decontaminated).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.llm.common import batch_of, bounded_batches, rows_of, texts
from rollweave.llm.wordhash import windows, word_hashes

WIDTH = 5
RADIUS = 23
BLOCKS = 8
SLICE_ITEMS = 5000
HIT_COLUMNS = "doc_id long, item_id long, start_word long, n_words long, similarity double"
_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_ONES = np.array([b.bit_count() for b in range(256)], dtype=np.uint8)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.where(shingles[:, None] & _BITS, 1, -1).astype(np.int32)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 weighted sums to rows of eight bytes."""
    return np.packbits(sums > 0, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two arrays of shingles, a shingle's weight being its count."""
    values, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(of[s], minlength=len(values)) for s in (slice(0, len(a)), slice(len(a), None)))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Items:
    """The items of one size, with their block index."""

    def __init__(self, ids: list[tuple], shingles: list[np.ndarray]):
        self.ids, self.shingles = ids, shingles
        self.prints = np.concatenate([fingerprint(signs(s).sum(axis=0, keepdims=True)) for s in shingles])
        apart = _ONES[np.arange(256, dtype=np.uint8)[:, None, None] ^ self.prints[None, :, :]]  # value, item, block
        self.near = (apart <= RADIUS // BLOCKS).transpose(2, 0, 1)  # block, value, item

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius: found over the blocks, then measured."""
        likely = np.zeros((len(prints), len(self.ids)), dtype=bool)
        for block in range(BLOCKS):
            likely |= self.near[block][prints[:, block]]
        window, item = np.nonzero(likely)
        close = _ONES[prints[window] ^ self.prints[item]].sum(axis=1) <= RADIUS
        return window[close], item[close]


class Matcher:
    def __init__(self, items: list[tuple[int | None, str | None]], least: float):
        self.least = least
        words = [w for _, part in word_hashes([t for _, t in items], fold=True) for w in part]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w):
                by_size.setdefault(len(w), []).append(i)
        shingles = {i: windows(words[i], min(WIDTH, n)) for n, some in by_size.items() for i in some}
        # Of items that repeat an id the best is reported; each without one counts for itself.
        names = [(name,) if name is not None else (None, i) for i, (name, _) in enumerate(items)]
        self.sizes = {n: Items([names[i] for i in some], [shingles[i] for i in some]) for n, some in sorted(by_size.items())}
        widths = {min(WIDTH, n) for n in by_size}
        self.known = {w: np.unique(np.concatenate([shingles[i] for n, some in by_size.items() if min(WIDTH, n) == w for i in some])) for w in widths}

    def best(self, words: np.ndarray) -> list[tuple[int | None, int, int, float]]:
        """(item, first word, words, similarity) of the best window of each item that the text holds."""
        found: dict[tuple, tuple[int, int, float]] = {}
        for width, known in self.known.items():
            own = windows(words, width)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hits = np.concatenate([[0], np.cumsum(known[at] == own)])
            if not hits[-1]:
                continue
            prefix = None
            for n, items in self.sizes.items():
                if min(WIDTH, n) != width:
                    continue
                # The item's shingles, and a window's: all of a text that is shorter than the item.
                full = n - width + 1
                m = min(full, len(own))
                if m < full * self.least - 1e-9:
                    continue
                starts = np.flatnonzero(hits[m:] - hits[:-m] >= math.ceil((full + m) * self.least / (1 + self.least) - 1e-9))
                if not len(starts):
                    continue
                if prefix is None:
                    prefix = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(signs(own), axis=0, dtype=np.int32)])
                for w, i in zip(*items.within(fingerprint(prefix[starts + m] - prefix[starts])), strict=True):
                    start = int(starts[w])
                    like = similarity(own[start : start + m], items.shingles[i])
                    if like >= self.least and like > found.get(items.ids[i], (0, 0, 0.0))[2]:
                        found[items.ids[i]] = (start, m + width - 1, like)
        return [(item[0], *rest) for item, rest in sorted(found.items(), key=lambda f: (f[0][0] is None, f[0]))]


def _slices(items: DataFrame):
    """Lists of at most SLICE_ITEMS items or so; all of them in turn."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = 1 + rows.count() // SLICE_ITEMS
    part = F.pmod(F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id")), F.lit(parts))
    for k in range(parts):
        yield [(r["item_id"], r["text"]) for r in rows.where(part == k).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """One row for each item that a document holds: its best window and similarity. Clean documents have none."""
    bounded_batches(docs.sparkSession)
    result = None
    for some in _slices(items):

        def scan(batches, some=some):
            matcher = Matcher(some, least)
            for ids, whole in rows_of(batches, "doc_id", "text"):
                out = [(ids[at + k], *hit) for at, part in word_hashes(whole, fold=True) for k, w in enumerate(part) for hit in matcher.best(w)]
                yield batch_of(_HIT, *(list(c) for c in zip(*out, strict=True))) if out else batch_of(_HIT, [], [], [], [], [])

        hits = texts(docs).mapInArrow(scan, HIT_COLUMNS)
        result = hits if result is None else result.union(hits)
    return result


def decontaminated(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for some in _slices(items):

        def clean(batches, some=some):
            matcher = Matcher(some, least)
            for batch in batches:
                whole = batch.column(at).to_pylist()
                good = [not matcher.best(w) for _, part in word_hashes(whole, fold=True) for w in part]
                yield batch.filter(pa.array(good, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
