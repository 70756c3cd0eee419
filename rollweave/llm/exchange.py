"""Questions about hash values, asked by groups of documents and answered for all documents at once.

Documents are dealt out to groups of about ``GROUP_DOCS`` (fewer, if they are long) by a hash of doc_id, once: later steps reuse that
shuffle. A group asks about its distinct hash values, packed as arrays, one row for each bucket of
values, so that a value that a third of all documents hold is a single entry of each group. A bucket
answers each row with one bit a value, or with bytes of its own making. Groups recompute their values in the same order when the answers come.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_DOCS = 1000
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
ASKED = "gid long, bucket int, data binary, info binary"
_ASKED = pa.schema([("gid", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("info", pa.binary())])
BITS = "gid long, turn int, bucket int, bits binary"
_BITS = pa.schema([("gid", pa.int64()), ("turn", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(docs: DataFrame, keep: bool = False) -> tuple[DataFrame, int]:
    """gid, doc_id, text (and the other columns as a struct, if kept), dealt out by gid; and the number of buckets, by which a
    bucket's questions come from about ``BUCKET_BYTES`` of text, however large the table is."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes")).first()
    groups = max(16, size.n // GROUP_DOCS, size.bytes // GROUP_BYTES)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if keep:
        columns.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"))
    rows = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(groups)).alias("gid"), *columns)
    return rows.repartition(partitions(docs), "gid"), max(partitions(docs), size.bytes // BUCKET_BYTES)


def in_order(group: pa.Table) -> pa.Table:
    """The group's rows by doc_id and text, NULLs last: the same order each time."""
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def bucketed(bucket: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """The stretch of each bucket that occurs in the sorted array."""
    edges = np.searchsorted(bucket, np.arange(n + 1))
    return [(b, slice(edges[b], edges[b + 1])) for b in range(n) if edges[b] < edges[b + 1]]


def asked(gid: int, rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.table([pa.array([gid] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], _ASKED.field(i + 1).type) for i in range(3))], schema=_ASKED)


def answers(questions: DataFrame, turn: int, answer: Callable[[list[bytes], list[bytes]], list[np.ndarray]]) -> DataFrame:
    """gid, turn, bucket, bits: answer() gets the data and info of a bucket's rows and gives each row's bits."""

    def reply(rows: pa.Table) -> pa.Table:
        gids, data, info = (rows.column(c).to_pylist() for c in ("gid", "data", "info"))
        order = sorted(range(len(gids)), key=gids.__getitem__)
        got = answer([data[i] for i in order], [info[i] for i in order])
        bucket = rows.column("bucket")[0].as_py()
        return pa.table([pa.array([gids[i] for i in order], pa.int64()), pa.array([turn] * len(gids), pa.int32()), pa.array([bucket] * len(gids), pa.int32()), pa.array([(np.packbits(g) if g.dtype == bool else g).tobytes() for g in got], pa.binary())], schema=_BITS)

    return questions.groupBy("bucket").applyInArrow(reply, BITS)


def bytes_of(replies: pa.Table, turn: int) -> dict[int, bytes]:
    """The answer of each bucket in one turn."""
    turns, buckets, bits = (replies.column(c).to_pylist() for c in ("turn", "bucket", "bits"))
    return {b: x for t, b, x in zip(turns, buckets, bits, strict=True) if t == turn}


def bits_of(replies: pa.Table, turn: int, stretches: list[tuple[int, slice]], n: int) -> np.ndarray:
    """The bits of one turn, in the order of the values asked about."""
    by_bucket = bytes_of(replies, turn)
    out = np.zeros(n, dtype=bool)
    for b, s in stretches:
        out[s] = np.unpackbits(np.frombuffer(by_bucket[b], dtype=np.uint8), count=s.stop - s.start).astype(bool)
    return out
