"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie end to end in one array of symbols. In each round every sequence
takes its own lowest-ranked pair, all of them at once; sequences without a mergeable pair leave the array
with their number of symbols. What is counted equals the library's ids.

Defined results: a NULL or empty text has 0 bytes and 0 tokens; special strings inside a text count as one
token each; rows that repeat a doc_id each get a row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rollweave.llm.common import batch_of, bounded_batches, rows_of, texts
from rollweave.llm.tokens import BYTE_LEVEL, looked_up

NO_RANK = np.iinfo(np.int32).max
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def byte_characters() -> list[str]:
    """The printable character that byte-level BPE files write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class RankMerger:
    """The merges of a byte-level BPE file as arrays."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab = model["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.of_byte = np.array([vocab[c] for c in byte_characters()], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        self.is_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.pattern = regex.compile(BYTE_LEVEL)
        self.cache: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        counts = sizes.copy()
        alive = np.flatnonzero(sizes > 1)
        if not len(alive):
            return counts
        flat = self.of_byte[np.frombuffer(b"".join([words[i] for i in alive]), dtype=np.uint8)]
        sizes = sizes[alive]
        ranks = self._ranks(flat, sizes)
        while len(alive):
            starts = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(ranks, starts)
            more = lowest < NO_RANK
            if not more.all():
                counts[alive[~more]] = sizes[~more]
                stays = np.repeat(more, sizes)
                flat, ranks, alive, sizes, lowest = flat[stays], ranks[stays], alive[more], sizes[more], lowest[more]
                if not len(alive):
                    break
            of = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero(ranks == lowest[of])
            hit = self._apart(hit)
            flat[hit] = self.merged[ranks[hit]]
            kept = np.ones(len(flat), dtype=bool)
            kept[hit + 1] = False
            sizes = sizes - np.bincount(of[hit], minlength=len(sizes))
            new_at = np.cumsum(kept) - 1
            flat, ranks, hit = flat[kept], ranks[kept], new_at[hit]
            last = np.zeros(len(flat), dtype=bool)
            last[np.cumsum(sizes) - 1] = True
            changed = np.union1d(hit, hit[hit > 0] - 1)
            ranks[changed] = NO_RANK
            changed = changed[~last[changed]]
            ranks[changed] = self.rank(flat[changed], flat[changed + 1])
        return counts

    def _ranks(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ranks = np.full(len(flat), NO_RANK, dtype=np.int32)
        ranks[:-1] = self.rank(flat[:-1], flat[1:])
        ranks[np.cumsum(sizes) - 1] = NO_RANK
        return ranks

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of hits side by side (a pair of equal symbols) every second, from the left."""
        first = np.ones(len(hit), dtype=bool)
        first[1:] = np.diff(hit) > 1
        run = np.flatnonzero(first)
        return hit[(np.arange(len(hit)) - run[np.cumsum(first) - 1]) % 2 == 0]

    def count(self, texts: list[str | None]) -> list[int]:
        cut, extra = [], []
        for text in texts:
            parts = self.is_special.split(text or "")
            extra.append(len(parts) - 1)
            cut.append([p for part in parts for p in self.pattern.findall(part)])
        found = looked_up(cut, self.cache, lambda pieces: self.symbols([p.encode() for p in pieces]).tolist())
        return [n + sum(f) for f, n in zip(found, extra, strict=True)]


_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One merger for each worker process, kept between its tasks."""
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(path)
    return _MERGERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""

    def count(batches):
        for ids, some in rows_of(batches, "doc_id", "text"):
            counts = merger(tokenizer).count(some)
            yield batch_of(_COUNTS, ids, [len(t.encode()) if t else 0 for t in some], counts, [n > limit for n in counts])

    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
