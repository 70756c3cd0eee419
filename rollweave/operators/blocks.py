"""Profiles of one blocking key compared with each other inside a task, so that pairs are never rows of a table.

Spark deals blocks, cut into cells of ``side`` profiles by ``side``, over buckets. A bucket takes its pairs in chunks: levels come from
numbered values, a text pair's similarity is worked out once, and only what a pair adds (a count, an edge, a tie) leaves the task.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pairs held at a time, entries of a table of text pairs, profiles a bucket is made for.
CHUNK, TABLE, BUCKET_ROWS = 1_000_000, 20_000_000, 4_000


def array_keys(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}


def deal(old: DataFrame, new: DataFrame, keys: Sequence[str], side: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their key values (``_k0``, ..), cell and ``_bucket``; a missing key agrees with nothing."""
    met = [f"_k{k}" for k in range(len(keys))]

    def keyed(df: DataFrame) -> DataFrame:
        held = array_keys(df)
        for name, key in zip(met, keys):
            df = df.withColumn(name, F.explode(F.array_distinct(F.col(key))) if key in held else F.col(key))
        return df.where(reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in met]))

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*met).agg(F.ceil(F.count("*") / side).cast("int").alias(name))

    left, right = keyed(old), keyed(new)
    # Blocks that only one side has meet nothing.
    cells = parts(left, "_olds").join(parts(right, "_news"), met)

    def placed(df: DataFrame, mine: str, others: str, at: Sequence[str]) -> DataFrame:
        out = df.join(cells, met).withColumn(at[0], F.pmod(F.xxhash64("profile"), F.col(mine)).cast("int"))
        out = out.withColumn(at[1], F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_olds", "_news")
        return out.withColumn("_bucket", F.pmod(F.xxhash64(*met, "_old", "_new"), F.lit(buckets)).cast("int"))

    return placed(left, "_olds", "_news", ("_old", "_new")), placed(right, "_news", "_olds", ("_new", "_old"))


class Bucket:
    """The rows of both sides that fell into one bucket, with numbered values."""

    def __init__(self, old: pa.Table, new: pa.Table):
        self.sides = (old, new)
        self.rows = old.num_rows, new.num_rows

    def column(self, name: str) -> pa.Array:
        """The values of the old rows, then of the new ones."""
        both = [s.column(name) for s in self.sides]
        kind = both[0].type
        if both[1].type != kind and pa.types.is_integer(kind):
            kind = pa.int64()
        return pa.chunked_array([c for b in both for c in b.cast(kind).chunks], type=kind).combine_chunks()

    def codes(self, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Numbers of the values, -1 where missing."""
        told = self.column(name).dictionary_encode()
        numbers = told.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return numbers[: self.rows[0]], numbers[self.rows[0]:], told.dictionary

    def numbers(self, name: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Values and whether they are there."""
        out = []
        for s in self.sides:
            c = s.column(name).combine_chunks()
            out.append((c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)))
        return out

    def elements(self, name: str, met: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Ranks of the values of a key, one row a profile, one that is no array as an array of one; filled up with -1 (old) and
        -2 (new). With ``met`` also the rank of the old rows' blocking value, which is one of them."""
        flat, lengths = [], []
        for s in self.sides:
            c = s.column(name).combine_chunks()
            if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
                lengths.append(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                flat.append(c.flatten())
            else:
                lengths.append(np.ones(len(c), dtype=np.int64))
                flat.append(c)
        kind = flat[0].type
        wanted = [self.sides[0].column(met).combine_chunks().cast(kind)] if met else []
        told = pa.concat_arrays([f.cast(kind) for f in flat] + wanted).dictionary_encode()
        rank = np.empty(len(told.dictionary) + 1, dtype=np.int64)
        rank[pc.array_sort_indices(told.dictionary).to_numpy()] = np.arange(len(told.dictionary))
        rank[-1] = -1
        ranks = rank[told.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)]
        out, at = [], 0
        for fill, values, n in zip((-1, -2), flat, lengths):
            held = np.full((len(n), int(n.max(initial=1))), fill, dtype=np.int64)
            held[np.arange(held.shape[1]) < n[:, None]] = ranks[at: at + len(values)]
            held[held == -1] = fill
            out.append(held)
            at += len(values)
        return out[0], out[1], ranks[at:] if met else None

    def pairs(self, met: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of all pairs of a cell, a chunk at a time."""
        cell = np.zeros(sum(self.rows), dtype=np.int64)
        for name in [*met, "_old", "_new"]:
            told = self.column(name).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            cell = np.unique(cell * (told.max(initial=0) + 1) + told, return_inverse=True)[1]
        mine, theirs = cell[: self.rows[0]], cell[self.rows[0]:]
        order, others = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
        start = np.searchsorted(theirs[others], mine[order], "left")
        count = np.searchsorted(theirs[others], mine[order], "right") - start
        ends, first = np.cumsum(count), 0
        while first < len(order):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, "right")))
            n = count[first:last]
            if n.sum():
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(order[first:last], n), others[np.repeat(start[first:last], n) + within]
            first = last


def common(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest value that both rows of a pair hold; a number above all where there is none."""
    least = np.full(len(i), np.iinfo(np.int64).max)
    for x in range(a.shape[1]):
        mine = a[i, x]
        shared = reduce(np.logical_or, [mine == b[j, y] for y in range(b.shape[1])])
        least = np.where(shared, np.minimum(least, mine), least)
    return least


NONE = np.iinfo(np.int64).max


class Texts:
    """Levels of text pairs by the share of common grams (joined by line feeds in ``<field>_grams``), each worked out once."""

    def __init__(self, bucket: Bucket, field: str, cuts: Sequence[float]):
        self.old, self.new, _ = bucket.codes(field)
        self.cuts = cuts
        codes = np.concatenate([self.old, self.new])
        self.distinct = int(codes.max(initial=-1)) + 1
        grams = bucket.column(f"{field}_grams")
        # One row of a text gives its grams.
        rows = np.zeros(self.distinct, dtype=np.int64)
        rows[codes[codes >= 0]] = np.flatnonzero(codes >= 0)
        sets = [[g for g in (t or "").split("\n") if g] for t in grams.take(pa.array(rows)).to_pylist()] if self.distinct else []
        names = {g: k for k, g in enumerate(dict.fromkeys(g for s in sets for g in s))}
        self.bits = np.zeros((self.distinct, len(names) // 64 + 1), dtype=np.uint64)
        for at, s in enumerate(sets):
            for g in s:
                self.bits[at, names[g] >> 6] |= np.uint64(1) << np.uint64(names[g] & 63)
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.table = np.full(self.distinct**2, -1, dtype=np.int8) if 0 < self.distinct**2 <= TABLE else None

    def _levels(self, pairs: np.ndarray) -> np.ndarray:
        out = np.empty(len(pairs), dtype=np.int8)
        step = max(1, 4_000_000 // self.bits.shape[1])
        for at in range(0, len(pairs), step):
            a, b = np.divmod(pairs[at: at + step], self.distinct)
            both = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64)
            union = self.size[a] + self.size[b] - both
            # 4-byte scores against 8-byte cuts, as in SQL.
            score = np.where(union > 0, both / np.maximum(union, 1), 0.0).astype(np.float32).astype(np.float64)
            out[at: at + step] = sum((score >= cut).astype(np.int8) for cut in self.cuts)
        return out

    def level(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.old[i], self.new[j]
        there = (a >= 0) & (b >= 0)
        out = np.full(len(i), -1, dtype=np.int8)
        pairs = (a * self.distinct + b)[there]
        if self.table is None:
            told, back = np.unique(pairs, return_inverse=True)
            out[there] = self._levels(told)[back]
        else:
            asked = np.zeros(len(self.table), dtype=bool) if len(pairs) * 8 > len(self.table) else None
            if asked is None:
                todo = np.unique(pairs[self.table[pairs] < 0])
            else:
                asked[pairs] = True
                todo = np.flatnonzero(asked & (self.table < 0))
            self.table[todo] = self._levels(todo)
            out[there] = self.table[pairs]
        return out


def equal(bucket: Bucket, field: str) -> Callable:
    a, b, _ = bucket.codes(field)

    def level(i, j):
        return np.where((a[i] < 0) | (b[j] < 0), -1, a[i] == b[j]).astype(np.int8)

    return level


def moving(bucket: Bucket, field: str, years: int, slack: float) -> Callable:
    (a, has_a), (b, has_b) = bucket.numbers(field)

    def level(i, j):
        return np.where(has_a[i] & has_b[j], np.abs(b[j].astype(a.dtype) - a[i] - years) <= slack, -1).astype(np.int8)

    return level


def compared(bucket: Bucket, number: int, passes: Sequence[Sequence[str]], ordered: bool, levels: Sequence[Callable]) -> Iterator:
    """Row numbers of the pairs of one pass that no earlier pass has, each once, with the levels of the fields."""
    keys = passes[number]
    lists = {k for k in keys if all(pa.types.is_nested(s.column(k).type) for s in bucket.sides)}
    shared = {k: bucket.elements(k, f"_k{at}") for at, k in enumerate(keys) if k in lists}
    before = {k: bucket.elements(k) for p in passes[:number] for k in p}
    if ordered:
        kinds = bucket.elements("profile")
    for i, j in bucket.pairs([f"_k{k}" for k in range(len(keys))]):
        kept = np.ones(len(i), dtype=bool)
        if ordered:
            kept &= kinds[0][i, 0] < kinds[1][j, 0]
        for earlier in passes[:number]:  # found there already
            kept &= ~reduce(np.logical_and, [common(before[k][0], before[k][1], i, j) < NONE for k in earlier])
        for a, b, met in shared.values():  # may meet on several values: taken at the smallest
            kept &= common(a, b, i, j) == met[i]
        i, j = i[kept], j[kept]
        if len(i):
            yield i, j, [level(i, j) for level in levels]


def meet(old: DataFrame, new: DataFrame, passes: Sequence[Sequence[str]], ordered: bool, prepare: Callable, work: Callable, schema: str,
         side: int) -> DataFrame:
    """``work(bucket, pairs)``, with pairs as ``compared`` tells them and levels by ``prepare(bucket)``, gives the rows (a pyarrow table) of each bucket of each pass."""
    buckets = max(32, (old.count() + new.count()) // BUCKET_ROWS)
    new = new.select(*[F.col(c).alias(c) for c in new.columns])  # may be the same table

    def one(number: int, keys: Sequence[str]) -> DataFrame:
        left, right = deal(old, new, keys, side, buckets)

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            bucket = Bucket(a, b)
            if not a.num_rows or not b.num_rows:
                return work(bucket, iter(()))
            return work(bucket, compared(bucket, number, passes, ordered, prepare(bucket)))

        return left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInArrow(run, schema)

    return reduce(DataFrame.unionByName, [one(k, keys) for k, keys in enumerate(passes)])
