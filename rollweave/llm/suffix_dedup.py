"""Repeated byte strings by prefix-free parsing.

A hash of eight bytes that rolls over a text starts a new phrase wherever it falls under 1/``PHRASE`` of its range;
equal strings are thus cut alike. Of highly repetitive text the dictionary of distinct phrases and the parse
(the sequence of phrases) are small:

1. Dictionary: which phrases occur once only. No repeat reaches across a whole such phrase.
2. Parse: the suffixes of the parse that begin with a repeated phrase, as far as a repeat can matter and up to the
   next phrase that occurs once, go to the bucket of their first phrase. There they are sorted phrase by phrase
   (classes of equal beginnings are refined until each suffix is alone), which puts them in corpus order; how many
   suffixes begin alike is known at each depth, and the greatest depth with company is the longest common prefix
   with a neighbour.
3. Both together: a string that begins inside a phrase is a suffix of a dictionary phrase, then whole phrases, then
   the beginning of one. The parse settles all strings whose whole phrases tell; those that begin or end inside the
   phrases at the edge of a repeat are named by a 64-bit hash of all their bytes, and names are counted. A string
   that the parse has settled is named too where more places share its inner phrases than all its phrases: another
   place may need it as its companion.

Questions and answers travel as packed arrays (see exchange.py); equal suffixes and names are merged within each
group of documents first, so that a hot passage is one entry of each.

Defined results: a NULL or empty text has no bytes; texts shorter than ``width`` stay whole; rows that repeat a
doc_id are texts of their own, so equal ones repeat each other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollweave.llm.exchange import ASKED, answers, asked, bits_of, bucketed, bytes_of, dealt, in_order
from rollweave.llm.wordhash import BYTE_VALUES, run_hashes

PHRASE = 48
WINDOW = 8
_TURNS = np.uint64(0x9E3779B97F4A7C15)
# Bytes hashed at a time: bounds the arrays.
PIECE = 1 << 18
DEEPEST = np.iinfo(np.uint16).max


def boundaries(raw: np.ndarray) -> np.ndarray:
    """Where phrases begin, 0 first, and the length last."""
    found = [np.zeros(1, dtype=np.int64)]
    for at in range(0, max(len(raw) - WINDOW + 1, 0), PIECE):
        v = raw[at : at + PIECE + WINDOW - 1].astype(np.uint64)
        v = v[:-1] | v[1:] << np.uint64(8)
        v = v[:-2] | v[2:] << np.uint64(16)
        v = v[:-4] | v[4:] << np.uint64(32)
        found.append(np.flatnonzero((v * _TURNS) >> np.uint64(48) < np.uint64((1 << 16) // PHRASE)) + at)
    return np.append(np.unique(np.concatenate(found)), len(raw))


def spans_hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of raw[start:end] of each pair, starts ascending; worked out piece by piece."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(starts, base + PIECE)))
        part = BYTE_VALUES[raw[base : int(ends[at:stop].max())]]
        out[at:stop] = run_hashes(part, starts[at:stop] - base, ends[at:stop] - base)
        at = stop
    return out


def _asked_once(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """(distinct values by bucket, place of each value there, a first place of each, whether it occurs twice, stretches)."""
    distinct, first, of, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    bucket = (distinct % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[of], first[order], counts[order] > 1, bucketed(bucket[order], buckets)


class _Group:
    """A group's texts, parsed, and what it asks, in a fixed order."""

    def __init__(self, rows: pa.Table, width: int, buckets: int):
        self.rows, self.width, self.buckets = in_order(rows), width, buckets
        self.gid = rows.column("gid")[0].as_py()
        self.raw = [np.frombuffer((t or "").encode(), dtype=np.uint8) for t in self.rows.column("text").to_pylist()]
        self.cuts = [boundaries(r) for r in self.raw]
        names = [spans_hashed(r, c[:-1], c[1:]) for r, c in zip(self.raw, self.cuts, strict=True)]
        self.firsts = np.cumsum([0] + [len(n) for n in names])
        self.names = np.concatenate(names)
        # A phrase's beginning and end on one line on which texts lie apart.
        size = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.base = np.cumsum(size) - size
        self.begin = np.concatenate([c[:-1] + b for c, b in zip(self.cuts, self.base, strict=True)])
        self.end = np.concatenate([c[1:] + b for c, b in zip(self.cuts, self.base, strict=True)])
        self.stop = np.repeat(self.firsts[1:], np.diff(self.firsts))  # the phrase after the text's last
        self.phrases = _asked_once(self.names, buckets)

    def dictionary(self) -> pa.Table:
        values, _, _, twice, stretches = self.phrases
        return asked(self.gid, [(b, values[s].astype("<u8").tobytes(), np.packbits(twice[s]).tobytes()) for b, s in stretches])

    def suffixes(self, replies: pa.Table) -> None:
        """The parse's suffixes worth asking about: (first phrase, phrase after the last)."""
        values, place, _, _, stretches = self.phrases
        repeated = bits_of(replies, 1, stretches, len(values))[place]
        single = np.append(np.flatnonzero(~repeated), len(repeated))
        alone = single[np.searchsorted(single, np.arange(len(repeated)))]  # the next phrase that occurs once
        enough = np.searchsorted(self.begin, self.end + self.width)  # the first phrase that begins so far on
        self.head = np.flatnonzero(repeated)
        self.tail = np.minimum(np.minimum(alone, enough), self.stop)[self.head]
        self.tail = np.minimum(self.tail, self.head + DEEPEST)
        runs = run_hashes(self.names, self.head, self.tail)
        distinct, first, self.run_of, counts = np.unique(runs, return_index=True, return_inverse=True, return_counts=True)
        bucket = (self.names[self.head[first]] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.run_rank = np.empty(len(order), dtype=np.int64)
        self.run_rank[order] = np.arange(len(order))
        self.lead, self.run_counts = first[order], counts[order]
        self.run_stretches = bucketed(bucket[order], self.buckets)

    def parse(self) -> pa.Table:
        rows = []
        for b, s in self.run_stretches:
            head, tail = self.head[self.lead[s]], self.tail[self.lead[s]]
            size = tail - head
            at = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rows.append((b, self.names[at].astype("<u8").tobytes(), size.astype("<u2").tobytes() + self.run_counts[s].astype("<u4").tobytes()))
        return asked(self.gid, rows)

    def _shared(self, replies: pa.Table) -> None:
        """Of each phrase, how deep the suffix there is shared, and where its numbers of companions stand."""
        parts = bytes_of(replies, 2)
        depths, flat = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for b, s in self.run_stretches:
            n = s.stop - s.start
            depths.append(np.frombuffer(parts[b], dtype="<u2", count=n).astype(np.int64))
            flat.append(np.frombuffer(parts[b], dtype="<u4", offset=2 * n).astype(np.int64))
        depth = np.concatenate(depths)
        mine = self.run_rank[self.run_of]
        self.depth, self.profile = (np.zeros(len(self.names) + 1, dtype=np.int64) for _ in "ab")
        self.depth[self.head], self.profile[self.head] = depth[mine], (np.cumsum(depth) - depth)[mine]
        self.alike = np.append(np.concatenate(flat), 0)

    def _companions(self, phrase: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """How many places share so many phrases from the given one on; without any, as many as there can be."""
        known = (deep > 0) & (deep <= self.depth[phrase])
        alike = np.where(known, self.alike[np.where(known, self.profile[phrase] + deep - 1, -1)], 1)
        return np.where(deep > 0, alike, np.iinfo(np.int64).max)

    def edges(self, replies: pa.Table) -> None:
        """Marks the strings that the parse settles, and names those that it leaves open or that others need."""
        self._shared(replies)
        self.sure, self.named_at, names = [], [], []
        for k, (raw, cut) in enumerate(zip(self.raw, self.cuts, strict=True)):
            n = max(len(raw) - self.width + 1, 0)
            at = np.arange(n)
            phrase = np.searchsorted(cut[:-1], at, side="right") - 1
            of = phrase + self.firsts[k]
            sure = cut[phrase + self.depth[of]] >= at + self.width  # whole phrases match another place so far
            inner = np.searchsorted(cut[:-1], at + (self.width - WINDOW), side="right") - 2 - phrase  # whole phrases inside
            can = ~sure & ((inner <= 0) | (self.depth[of + 1] >= inner))
            cover = np.searchsorted(cut, at + self.width) - phrase
            can[sure] = (self._companions(of + 1, inner) > self._companions(of, cover))[sure]
            self.sure.append(sure)
            self.named_at.append(np.flatnonzero(can))
            names.append(spans_hashed(raw, self.named_at[-1], self.named_at[-1] + self.width))
        self.strings = _asked_once(np.concatenate([np.zeros(0, dtype=np.uint64), *names]), self.buckets)

    def named(self) -> pa.Table:
        values, _, _, twice, stretches = self.strings
        return asked(self.gid, [(b, values[s].astype("<u8").tobytes(), np.packbits(twice[s]).tobytes()) for b, s in stretches])

    def covered(self, replies: pa.Table) -> list[np.ndarray]:
        """Of each text, which of its bytes go."""
        values, place, _, _, stretches = self.strings
        repeated = bits_of(replies, 3, stretches, len(values))[place]
        out, first = [], 0
        for raw, sure, at in zip(self.raw, self.sure, self.named_at, strict=True):
            starts = sure.copy()
            starts[at[repeated[first : first + len(at)]]] = True
            first += len(at)
            edge = np.zeros(len(raw) + 1, dtype=np.int64)
            edge[: len(starts)] += starts
            edge[self.width : self.width + len(starts)] -= starts
            out.append(np.cumsum(edge[:-1]) > 0)
        return out


def _counted_twice(data: list[bytes], info: list[bytes]) -> list[np.ndarray]:
    """Which names occur twice or more in all."""
    parts = [np.frombuffer(d, dtype="<u8") for d in data]
    twice = np.concatenate([np.unpackbits(np.frombuffer(i, dtype=np.uint8), count=len(p)) for i, p in zip(info, parts, strict=True)])
    _, of, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    found = counts > 1
    found[of[twice > 0]] = True
    return np.split(found[of], np.cumsum([len(p) for p in parts])[:-1])


def _depths(data: list[bytes], info: list[bytes]) -> list[np.ndarray]:
    """Of each suffix, how many of its leading phrases another suffix shares (two bytes), then how many share each (four)."""
    phrases = np.frombuffer(b"".join(data), dtype="<u8")
    rows = [len(i) // 6 for i in info]
    size = np.concatenate([np.frombuffer(i, dtype="<u2", count=n) for i, n in zip(info, rows, strict=True)]).astype(np.int64)
    weight = np.concatenate([np.frombuffer(i, dtype="<u4", offset=2 * n) for i, n in zip(info, rows, strict=True)])
    first = np.cumsum(size) - size
    depth = np.zeros(len(size), dtype=np.int64)
    active, rank, d = np.flatnonzero(size > 0), np.zeros(int((size > 0).sum()), dtype=np.int64), 0
    levels = []
    while len(active):
        key = phrases[first[active] + d]
        order = np.lexsort((key, rank))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (rank[order][1:] != rank[order][:-1])
        classes = np.cumsum(new) - 1
        alike = np.bincount(classes, weights=weight[active[order]])[classes].astype(np.int64)
        active, rank, alike = active[order][alike > 1], classes[alike > 1], alike[alike > 1]
        d += 1
        depth[active] = d
        levels.append((active, alike))
        longer = size[active] > d
        active, rank = active[longer], rank[longer]
    at = np.cumsum(depth) - depth
    flat = np.zeros(int(depth.sum()), dtype="<u4")
    for d, (of, alike) in enumerate(levels):
        flat[at[of] + d] = alike
    out, row = [], 0
    for n in rows:
        own = slice(row, row + n)
        begin, end = (int(at[row]), int(at[row + n - 1] + depth[row + n - 1])) if n else (0, 0)
        out.append(np.frombuffer(depth[own].astype("<u2").tobytes() + flat[begin:end].tobytes(), dtype=np.uint8))
        row += n
    return out


def remove_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every text."""
    rows, buckets = dealt(docs)

    def dictionary(group: pa.Table) -> pa.Table:
        return _Group(group, width, buckets).dictionary()

    def parse(group: pa.Table, replies: pa.Table) -> pa.Table:
        mine = _Group(group, width, buckets)
        mine.suffixes(replies)
        return mine.parse()

    def edges(group: pa.Table, replies: pa.Table) -> pa.Table:
        mine = _Group(group, width, buckets)
        mine.suffixes(replies)
        mine.edges(replies)
        return mine.named()

    def finish(group: pa.Table, replies: pa.Table) -> pa.Table:
        mine = _Group(group, width, buckets)
        mine.suffixes(replies)
        mine.edges(replies)
        gone = mine.covered(replies)
        spans = [int(x[0]) + int((np.diff(x.astype(np.int8)) == 1).sum()) if len(x) else 0 for x in gone]
        kept = [r[~x].tobytes() for r, x in zip(mine.raw, gone, strict=True)]
        numbers = ([len(x) for x in gone], [int(x.sum()) for x in gone], spans)
        return pa.table({"doc_id": mine.rows.column("doc_id"), **{c: pa.array(v, pa.int64()) for c, v in zip(("n_bytes", "n_removed", "n_spans"), numbers, strict=True)}, "kept": pa.array(kept, pa.binary())})

    def ask(function, replies: DataFrame) -> DataFrame:
        return rows.groupBy("gid").cogroup(replies.groupBy("gid")).applyInArrow(function, ASKED)

    once = answers(rows.groupBy("gid").applyInArrow(dictionary, ASKED), 1, _counted_twice)
    order = once.union(answers(ask(parse, once), 2, _depths))
    replies = order.union(answers(ask(edges, order), 3, _counted_twice))
    return rows.groupBy("gid").cogroup(replies.groupBy("gid")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
