"""Substring dedup by fixed-block anchors.

The reference index holds the non-overlapping blocks of ``width / 2`` words of every document. Every rolling
window of that many words probes it. A run of ``width`` words that stands in two places holds a
whole reference block of each, so both places get a hit inside the run; windows of ``width`` words without
a hit cannot repeat. Hits are extended: the windows around them are compared whole, the earliest place of
each keeps its words, and all later windows join to maximal repeats, whose words go.

Index and probes are packed arrays of 32-bit hashes in hash buckets (see exchange.py); a false hit only costs
the later comparison, which uses 64 bits.

Defined results: a NULL or empty text has no words and keeps the empty text; texts shorter than ``width``
keep all words; rows that repeat a doc_id count as one document, in the order of their texts; an empty table
gives no rows; NULL doc_ids count as the last document. ``deduplicated`` leaves texts without repeats as they are,
NULLs included, and keeps the white space inside what stays of the others; rows that lose every word stay, empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.llm.common import WORD
from rollweave.llm.exchange import ASKED, answers, asked, bits_of, bucketed, dealt, in_order
from rollweave.llm.wordhash import windows, word_hashes

_WORDS = re.compile(WORD)
_LAST = np.iinfo(np.int64).max


class _Group:
    """What a group of documents asks, in a fixed order."""

    def __init__(self, rows: pa.Table, width: int, buckets: int):
        self.rows, self.width, self.buckets = in_order(rows), width, buckets
        self.gid = rows.column("gid")[0].as_py()
        self.texts = self.rows.column("text").to_pylist()
        self.words = [w for _, part in word_hashes(self.texts) for w in part]
        block = width // 2
        probes = [windows(w, block) for w in self.words]
        values = np.concatenate(probes)
        aligned = np.concatenate([np.arange(len(p)) % block == 0 for p in probes]) if len(values) else np.zeros(0, dtype=bool)
        keys = (values >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | values & np.uint64(0xFFFFFFFF)
        self.keys, self.of, counts = np.unique(keys, return_inverse=True, return_counts=True)
        self.flags = (counts > 1).astype(np.uint8)
        self.flags[self.of[aligned]] |= 2
        self.sizes = [len(p) for p in probes]
        self.first = bucketed((self.keys >> np.uint64(32)).astype(np.int64), buckets)

    def probe(self) -> pa.Table:
        return asked(self.gid, [(b, self.keys[s].astype("<u4").tobytes(), self.flags[s].tobytes()) for b, s in self.first])

    def candidates(self, replies: pa.Table) -> None:
        """The windows around hits: their values, places, and the distinct values in order of bucket and place."""
        hit = bits_of(replies, 1, self.first, len(self.keys))[self.of]
        ids = [_LAST if i is None else i for i in self.rows.column("doc_id").to_pylist()]
        values, docs, starts, self.spans = [], [], [], []
        at, before, last = 0, 0, None
        reach = self.width - self.width // 2 + 1
        for doc, words, n in zip(ids, self.words, self.sizes, strict=True):
            before = before if doc == last else 0
            last, some = doc, hit[at : at + n]
            at += n
            found = np.zeros(0, dtype=np.int64)
            if len(words) >= self.width and some.any():
                sums = np.concatenate([[0], np.cumsum(some)])
                found = np.flatnonzero(sums[reach:] > sums[:-reach])
                values.append(windows(words, self.width)[found])
                docs.append(np.full(len(found), doc))
                starts.append(found + before)
            self.spans.append(found)
            before += len(words)
        self.values = np.concatenate([np.zeros(0, dtype=np.uint64), *values])
        docs, starts = np.concatenate([np.zeros(0, dtype=np.int64), *docs]), np.concatenate([np.zeros(0, dtype=np.int64), *starts])
        _, first, self.back = np.unique(self.values, return_index=True, return_inverse=True)
        bucket = (self.values[first] % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((first, bucket))
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.lead = first[order]
        self.second = bucketed(bucket[order], self.buckets)
        self.docs, self.starts = docs, starts

    def compare(self) -> pa.Table:
        info = np.zeros(len(self.lead), dtype=[("doc", "<i8"), ("at", "<i8")])
        info["doc"], info["at"] = self.docs[self.lead], self.starts[self.lead]
        values = self.values[self.lead]
        return asked(self.gid, [(b, values[s].astype("<u8").tobytes(), info["doc"][s].tobytes() + info["at"][s].tobytes()) for b, s in self.second])

    def removed(self, replies: pa.Table) -> list[np.ndarray]:
        """Of each row, which of its words go."""
        owner = bits_of(replies, 2, self.second, len(self.lead))[self.rank[self.back]]
        later = ~owner
        later[np.setdiff1d(np.arange(len(self.values)), self.lead)] = True
        out, at = [], 0
        for words, found in zip(self.words, self.spans, strict=True):
            starts = found[later[at : at + len(found)]]
            at += len(found)
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + self.width, -1)
            out.append(np.cumsum(edge[:-1]) > 0)
        return out


def _hits(data: list[bytes], info: list[bytes]) -> list[np.ndarray]:
    """A value is hit if a reference block has it, and it stands in a second place."""
    parts = [np.frombuffer(d, dtype="<u4") for d in data]
    flags = np.frombuffer(b"".join(info), dtype=np.uint8)
    _, of, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[of[(flags & 1) > 0]] = True
    indexed = np.zeros(len(counts), dtype=bool)
    indexed[of[(flags & 2) > 0]] = True
    return np.split((twice & indexed)[of], np.cumsum([len(p) for p in parts])[:-1])


def _owners(data: list[bytes], info: list[bytes]) -> list[np.ndarray]:
    """Whether a group's first place of a value is the first of all."""
    sizes = [len(d) // 8 for d in data]
    values = np.frombuffer(b"".join(data), dtype="<u8")
    doc = np.frombuffer(b"".join(i[: 8 * n] for i, n in zip(info, sizes, strict=True)), dtype="<i8")
    at = np.frombuffer(b"".join(i[8 * n :] for i, n in zip(info, sizes, strict=True)), dtype="<i8")
    order = np.lexsort((at, doc, values))
    first = np.ones(len(order), dtype=bool)
    first[1:] = values[order][1:] != values[order][:-1]
    owner = np.zeros(len(order), dtype=bool)
    owner[order[first]] = True
    return np.split(owner, np.cumsum(sizes)[:-1])


def _shortened(text: str | None, gone: np.ndarray) -> str | None:
    """The text without the words that go; what stood between two kept words stays."""
    if not gone.any():
        return text
    spans = [m.span() for m in _WORDS.finditer(text)]
    kept = np.concatenate([[False], ~gone, [False]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(kept))
    return " ".join([text[spans[a][0] : spans[b - 1][1]] for a, b in zip(turns[0::2], turns[1::2], strict=True)])


def remove_repeats(docs: DataFrame, width: int = 20, keep: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: the kept words, one blank between.

    With keep, kept_text is the text in its own white space and ``rest`` has the other columns.
    """
    rows, buckets = dealt(docs, keep)
    rest = f", rest {rows.schema['rest'].dataType.simpleString()}" if keep else ""

    def probe(group: pa.Table) -> pa.Table:
        return _Group(group, width, buckets).probe()

    def compare(group: pa.Table, replies: pa.Table) -> pa.Table:
        mine = _Group(group, width, buckets)
        mine.candidates(replies)
        return mine.compare()

    def finish(group: pa.Table, replies: pa.Table) -> pa.Table:
        mine = _Group(group, width, buckets)
        mine.candidates(replies)
        gone = mine.removed(replies)
        kept = [_shortened(t, out) for t, out in zip(mine.texts, gone, strict=True)] if keep else []
        for text, out in zip(mine.texts, gone, strict=True) if not keep else ():
            words = _WORDS.findall(text or "")
            kept.append(" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x] if out.any() else words))
        columns = {"doc_id": mine.rows.column("doc_id"), "n_words": pa.array([len(x) for x in gone], pa.int64()),
                   "n_removed": pa.array([int(x.sum()) for x in gone], pa.int64()), "kept_text": pa.array(kept, pa.string())}
        return pa.table(columns | ({"rest": mine.rows.column("rest")} if keep else {}))

    hits = answers(rows.groupBy("gid").applyInArrow(probe, ASKED), 1, _hits)
    owners = answers(rows.groupBy("gid").cogroup(hits.groupBy("gid")).applyInArrow(compare, ASKED), 2, _owners)
    both = hits.union(owners)
    return rows.groupBy("gid").cogroup(both.groupBy("gid")).applyInArrow(
        finish, f"doc_id long, n_words long, n_removed long, kept_text string{rest}")


def deduplicated(docs: DataFrame, width: int = 20) -> DataFrame:
    """The documents, with all their columns, without repeated passages; n_chars, where there is one, follows the text."""
    found = remove_repeats(docs, width, keep=True)
    length = F.length("kept_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None

    def column(name: str):
        if name == "text":
            return F.col("kept_text").alias(name)
        own = F.col("rest").getField(name)
        return (F.when(F.col("n_removed") > 0, length).otherwise(own) if name == "n_chars" else own).alias(name)

    return found.select(*(column(c) for c in docs.columns))
