"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily, longest piece first; then its shortest piece gives way to two unpacked pieces
that together fill the widened gap more tightly. Only the number of pieces of each length matters for
this, so the plan is made from a histogram with at most ``limit`` entries: bins filled alike are one
pattern with a multiplicity. The pieces themselves never leave Spark: each is numbered among the pieces of
its length (in salted buckets, so that a hot length is many groups) and looks its place up in the plan.

Defined results: a NULL or empty text has the end id alone; a document with more than ``limit`` ids is cut
from its end into full pieces, so that only its first piece is shorter; rows that repeat a doc_id are packed
as documents of their own; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollweave.llm.common import batch_of, bounded_batches, rows_of, saved, texts
from rollweave.llm.tokens import encoder

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Pieces that one numbering group holds at most on average.
GROUP_ROWS = 250_000


def pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece of each document, with the crc32 of its ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encode = encoder(tokenizer, "byte").encode
        for ids, some in rows_of(batches, "doc_id", "text"):
            out = ([], [], [], [], [])
            for doc, coded in zip(ids, encode(some), strict=True):
                coded += end
                total = len(coded) // 4
                first = total % limit or limit
                starts = [0, *range(first, total, limit)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], total], strict=True)):
                    for column, value in zip(out, (doc, piece, a, b - a, zlib.crc32(coded[4 * a : 4 * b])), strict=True):
                        column.append(value)
            yield batch_of(_PIECES, *out)

    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(cut, PIECE_COLUMNS)


def plan_bins(counts: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """(multiplicity, lengths from the front) of the bins that best-two-fit makes of counts[length] pieces."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while left.any():
        took: list[int] = []
        gap = limit
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            took.append(int(fits[-1]))
            left[fits[-1]] -= 1
            gap -= took[-1]
        if gap and len(took) > 1 or gap and took[0] < limit:
            pair = _tighter_pair(left, gap + took[-1], took[-1])
            if pair:
                left[took.pop()] += 1
                for length in pair:
                    left[length] -= 1
                took += pair
        lengths, uses = np.unique(took, return_counts=True)
        more = int((left[lengths] // uses).min())
        left[lengths] -= more * uses
        bins.append((1 + more, took))
    return bins


def _tighter_pair(left: np.ndarray, room: int, than: int) -> list[int] | None:
    """The two unpacked lengths with the largest sum up to room, if it is over ``than``; of equals, the one with the longest piece."""
    there = np.flatnonzero(left[:room])
    if not len(there):
        return None
    other = np.searchsorted(there, room - there, side="right") - 1  # the longest partner that still fits
    same = (other >= 0) & (there[other] == there) & (left[there] < 2)
    other = np.where(same, other - 1, other)
    total = np.where(other >= 0, there + there[other], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return [int(there[best]), int(there[other[best]])] if total[best] > than else None


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut = saved(pieces(docs, tokenizer, limit, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    sequence = 0
    for times, lengths in plan_bins(counts, limit):
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    lookup = {length: np.array(s, dtype=np.int64).T for length, s in slots.items()}

    salts = 64 + sum(counts.values()) // GROUP_ROWS
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    numbered = salted.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank")).alias("_at"))

    def place(batches):
        for batch in batches:
            length, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, offset = np.zeros_like(at), np.zeros_like(at)
            for one in np.unique(length):
                rows = np.flatnonzero(length == one)
                firsts, sequences, offsets = lookup[int(one)]
                slot = np.searchsorted(firsts, at[rows], side="right") - 1
                seq[rows] = sequences[slot] + at[rows] - firsts[slot]
                offset[rows] = offsets[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], schema=_PLACED)

    return numbered.mapInArrow(place, PIECE_COLUMNS + ", sequence_id long, offset long")
