"""Token ids as Huffman-coded blocks, and the way back.

Documents are dealt out by ranges of doc_id and tokenised once, in ascending order, to blocks of whole documents.
Ids are counted over all blocks; a canonical prefix code limited to ``max_bits`` (package-merge) is made of the
counts, whose size the vocabulary bounds, and each block is coded. A coded block stands alone: its code words end to end, and the bit
offset of every ``CHECKPOINT``-th id, from which a reader decodes all stretches in step, one table look-up
an id. Blocks are the rows of Parquet files in the shared folder (so that any store Spark writes to will
do), beside them the table of code lengths; nothing else is needed to read them.

Defined results: a NULL or empty text has the end id alone; rows that repeat a doc_id are documents of
their own, in no set order; a NULL doc_id sorts first; an empty table gives empty files; other columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm.common import batch_of, bounded_batches, rows_of, shared_folder, texts
from rollweave.llm.tokens import encoder

CHECKPOINT = 128
BLOCK_IDS = 1 << 17
BLOCK_COLUMNS = "part int, first_id long, n_ids long, doc_ids array<long>, doc_sizes array<int>, offsets binary, payload binary"
_BLOCK = pa.schema([("part", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int32())), ("offsets", pa.binary()), ("payload", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def code_lengths(counts: np.ndarray, max_bits: int = 16) -> np.ndarray:
    """Length of each id's code word, 0 for ids that don't occur: the shortest code with no word over max_bits."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    ids = np.flatnonzero(counts)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    if len(ids) > 1 << max_bits:
        raise ValueError(f"{len(ids)} ids don't fit words of {max_bits} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    weights = counts[ids].astype(np.int64)
    levels = [np.ones(len(ids), dtype=bool)]  # of each level, which of its sorted items are ids and not packages
    items = weights
    for _ in range(max_bits - 1):
        even = len(items) // 2 * 2
        packages = items[0:even:2] + items[1:even:2]
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        items = both[order]
    take = 2 * len(ids) - 2
    for is_id in reversed(levels):
        singles = int(is_id[:take].sum())
        lengths[ids[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical words: by length, then by id."""
    words = np.zeros(len(lengths), dtype=np.uint32)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    long = int(lengths.max(initial=1))
    spans = np.uint64(1) << (np.uint64(long) - lengths[ids].astype(np.uint64))
    left = np.cumsum(spans) - spans  # the word, filled up with zeros to `long` bits
    words[ids] = (left // spans).astype(np.uint32)
    return words


def encode_block(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[bytes, bytes]:
    """(bit offsets of every CHECKPOINT-th id, payload)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    bits = int(end[-1]) if len(ids) else 0
    cell, inside = at >> 5, at & 31
    value = words[ids].astype(np.uint64) << (64 - inside - size).astype(np.uint64)  # in the 64 bits that begin with the cell
    n = (bits >> 5) + 2
    # Sums of disjoint bits below 2**32 are exact in float64.
    cells = np.bincount(cell, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n)
    cells[1:] += np.bincount(cell, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[:-1]
    payload = cells.astype(np.uint64).astype(">u4").tobytes()[: (bits + 7) // 8]
    return at[::CHECKPOINT].astype("<u8").tobytes(), payload


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.bits = int(lengths.max(initial=1))
        ids = np.flatnonzero(lengths)
        ids = ids[np.argsort(lengths[ids], kind="stable")]
        spans = 1 << (self.bits - lengths[ids].astype(np.int64))
        fill = (1 << self.bits) - int(spans.sum())
        self.id_of = np.concatenate([np.repeat(ids, spans), np.zeros(fill, dtype=np.int64)]).astype(np.uint32)
        self.size_of = np.concatenate([np.repeat(lengths[ids], spans), np.ones(fill, dtype=np.uint8)]).astype(np.int64)

    def decode(self, n: int, offsets: bytes, payload: bytes) -> np.ndarray:
        at = np.frombuffer(offsets, dtype="<u8").astype(np.int64)
        raw = np.frombuffer(payload + bytes(4), dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
        out = np.empty((CHECKPOINT, len(at)), dtype=np.uint32)
        shift = 32 - self.bits
        mask = (1 << self.bits) - 1
        last = n - CHECKPOINT * (len(at) - 1)  # ids of the last stretch
        for step in range(min(CHECKPOINT, n)):
            if step == last:
                at = at[:-1]
            code = (window[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[step, : len(at)] = self.id_of[code]
            at = at + self.size_of[code]
        return out.T.ravel()[:n] if len(offsets) else np.empty(0, dtype=np.uint32)


def packed(ids: bytes) -> bytes:
    """Little-endian unsigned 32-bit ids in 16 bits each, where all of them fit."""
    wide = np.frombuffer(ids, dtype="<u4")
    return wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else ids


def unpacked(payload: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a plain block, whose width is that of the payload."""
    return np.frombuffer(payload, dtype="<u2" if len(payload) == 2 * n else "<u4")


def id_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Blocks with plain ids as payload and no offsets, in ascending order of doc_id."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def gather(batches):
        part, first, held, sizes, owners = TaskContext.get().partitionId(), 0, [], [], []
        encode = encoder(tokenizer, "word").encode

        def block():
            return batch_of(_BLOCK, [part], [first], [sum(sizes)], [owners], [sizes], [b""], [packed(b"".join(held))])

        n = 0
        for ids, some in rows_of(batches, "doc_id", "text"):
            for doc, coded in zip(ids, encode(some), strict=True):
                owners.append(doc)
                held.append(coded + end)
                sizes.append(len(held[-1]) // 4)
                n += sizes[-1]
                if n >= BLOCK_IDS:
                    yield block()
                    first, n, held, sizes, owners = first + n, 0, [], [], []
        if owners:
            yield block()

    bounded_batches(docs.sparkSession)
    return texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(gather, BLOCK_COLUMNS)


def id_counts(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs. The vocabulary bounds what comes back."""

    def count(batches):
        total = np.zeros(1, dtype=np.int64)
        for sizes, payloads in rows_of(batches, "n_ids", "payload"):
            for n, payload in zip(sizes, payloads, strict=True):
                more = np.bincount(unpacked(payload, n), minlength=len(total))
                more[: len(total)] += total
                total = more
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["id", "n"])

    found = blocks.select("n_ids", "payload").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([0, *(r["id"] for r in found)]) + 1, dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, max_bits: int = 16) -> None:
    """Writes ``path``/codes and ``path``/blocks, and on the way ``path``/ids."""
    spark = docs.sparkSession
    id_blocks(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(f"{path}/ids")
    plain = spark.read.schema(BLOCK_COLUMNS).parquet(f"{path}/ids")
    lengths = code_lengths(id_counts(plain), max_bits)
    words = code_words(lengths)
    code_rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(code_rows, "id int, length int").coalesce(1).write.parquet(f"{path}/codes")

    def code(batches):
        for batch in batches:
            coded = [encode_block(unpacked(p, n), lengths, words) for p, n in zip(batch.column(6).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([c[k] for c in coded], pa.binary()) for k in (0, 1))], names=_BLOCK.names)

    plain.mapInArrow(code, BLOCK_COLUMNS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    codes = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.zeros(max([0, *(r["id"] for r in codes)]) + 1, dtype=np.uint8)
    for r in codes:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.schema(BLOCK_COLUMNS).parquet(f"{path}/blocks")
    # One row for each task that wrote: what all parts before a part hold.
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, start_of = 0, {}
    for part, n in totals:
        start_of[part], before = before, before + n

    def decode(batches):
        decoder = Decoder(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decoder.decode(row["n_ids"], row["offsets"], row["payload"]).astype("<u4").tobytes()
                sizes = np.array(row["doc_sizes"], dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                crcs = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                yield batch_of(_READ, row["doc_ids"], starts + (start_of[row["part"]] + row["first_id"]), sizes, crcs)

    bounded_batches(spark)
    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the documents' ids to a new folder of the shared one and reads them back."""
    path = f"{shared_folder(docs.sparkSession)}/llm-tokens-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer, end_id)
    return read_files(docs.sparkSession, path)
