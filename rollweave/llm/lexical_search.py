"""Ranked lexical search by inner products of impact vectors, with norm buckets.

A document is the vector of its terms' impacts, an item the vector of its terms' weights times their repeats; a score is their
inner product. Only terms of the items matter, so vectors hold those alone. They are written in order of length (range
partitions, sorted inside). The longest ones are ranked first and give every item a score that its tenth hit has at least. The rest
is read from the length on at which the Cauchy-Schwarz bound reaches any item's score; each task walks its vectors in buckets of
falling length and drops items whose bound with the bucket's longest vector is too low, then, inside, pairs whose focus
coordinates (an item's heaviest terms) and the length of what is left cannot reach it. Pairs that survive are scored in 64-bit integers.
A task gives at most ``top`` rows an item; those are merged by (score, doc_id).

All documents are ranked for all items: bounds only leave out pairs that provably rank lower. Items come in slices of at most
``SLICE_TERMS`` terms (one for most benchmarks), each with a pass over the documents; what is sent to tasks is bounded by the slice.

Defined results: a missing text has no terms; documents without a term count nowhere; rows that repeat a doc_id are documents of their
own and may both be ranked; the texts of rows that repeat an item_id make one item, equal texts once; an item without a known term
has no rows; a NULL item_id is an item, a NULL doc_id ranks last among equal scores; empty tables give no rows; further columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.llm.common import bounded_batches, rows_of, saved, texts

SLICE_TERMS = 50_000      # terms, with repeats, of the items of one pass: at most ITEM_BLOCK * SLICE_TERMS weights, 100 MB, in a task
ITEM_BLOCK = 256          # items compared at a time
BUCKET = 512              # vectors of a bucket
FOCUS = 6                 # focus coordinates of an item
FIRST_SHARE = 16          # a sixteenth of the vectors, the longest, is ranked first
SLACK = 1 - 1e-9          # of bounds worked out in doubles

# Term letters stay (A-Z lower-cased, other bytes of UTF-8 as they are), all else becomes a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_LETTERS).split() if text else []


COUNTED = "doc_id long, n long, ids binary, tfs binary"
_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("tfs", pa.binary())])


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and the ids and frequencies of the vocabulary's terms, of every document with a term."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for ids, said in rows_of(batches, "doc_id", "text"):
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(ids, said, strict=True):
                words = terms(text)
                if not words:
                    continue
                here = sorted((number[w], k) for w, k in Counter(words).items() if w in number)
                pairs = np.array(here, dtype=np.int32).reshape(-1, 2)
                for column, value in zip(out, (doc_id, len(words), pairs[:, 0].tobytes(), pairs[:, 1].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _COUNTED, strict=True)], schema=_COUNTED)

    return texts(docs).mapInArrow(count, COUNTED)


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term: one vector for each task, added up."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for (ids,) in rows_of(batches, "ids"):
            df += np.bincount(np.frombuffer(b"".join(ids), dtype=np.int32), minlength=size)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], ["term", "df"])

    df = np.zeros(size, dtype=np.int64)
    for row in found.select("ids").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row.term] = row.df
    return df


VECTORS = "doc_id long, norm double, ids binary, impacts binary"
_VECTORS = pa.schema([("doc_id", pa.int64()), ("norm", pa.float64()), ("ids", pa.binary()), ("impacts", pa.binary())])


def vectors(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The impact vector of each document with a term of the items, and its length."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, n, ids, tfs in rows_of(batches, "doc_id", "n", "ids", "tfs"):
            norms, impacts = [], []
            for length, tf in zip(n, tfs, strict=True):
                m = 25 + (75 * length * n_docs) // n_terms  # Python integers: no overflow
                tf = np.frombuffer(tf, dtype=np.int32).astype(np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                norms.append(math.sqrt(float(np.square(impact.astype(float)).sum())))
                impacts.append(impact.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((doc_ids, norms, ids, impacts), _VECTORS, strict=True)], schema=_VECTORS)

    return found.where(F.length("ids") > 0).mapInArrow(weigh, VECTORS)


class Items:
    """A block of items: the weights of their own terms, lengths, focus coordinates and the postings of these."""

    def __init__(self, counts: list[dict[int, int]], weights: np.ndarray):
        own = np.unique(np.array([t for count in counts for t in count], dtype=np.int64))
        self.place = np.full(len(weights), -1)
        self.place[own] = np.arange(len(own))
        self.weights = np.zeros((len(counts), len(own)), dtype=np.int64)
        for i, count in enumerate(counts):
            for term, k in count.items():
                self.weights[i, self.place[term]] = k * weights[term]
        exact = self.weights.astype(float)
        self.norm = np.sqrt(np.square(exact).sum(axis=1))
        focus = np.argsort(-self.weights, axis=1, kind="stable")[:, :FOCUS]
        heavy = np.take_along_axis(exact, focus, axis=1)
        self.rest = np.sqrt(np.maximum(np.square(self.norm) - np.square(heavy).sum(axis=1), 0)) * (1 + 1e-9)
        rows = np.repeat(np.arange(len(counts)), focus.shape[1])
        term, order = focus.ravel(), np.argsort(focus.ravel(), kind="stable")
        order = order[heavy.ravel()[order] > 0]
        self.post_item, self.post_weight = rows[order], heavy.ravel()[order]
        self.post_from = np.searchsorted(term[order], np.arange(len(own) + 1))

    def entries(self, at: np.ndarray, ids: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of a bucket's vectors whose terms are the block's own."""
        place = self.place[ids]
        mine = place >= 0
        return np.concatenate([[0], np.cumsum(mine)])[at], place[mine], impacts[mine]


def survivors(items: Items, active: np.ndarray, least: np.ndarray, norms: np.ndarray, at: np.ndarray, ids: np.ndarray, impacts: np.ndarray):
    """document, item: the pairs of a bucket whose bound reaches the item's least score."""
    size = (len(norms), len(items.norm))
    row = np.repeat(np.arange(len(norms)), np.diff(at))
    hits = items.post_from[ids + 1] - items.post_from[ids]
    entry = np.repeat(np.arange(len(ids)), hits)
    post = np.arange(len(entry)) - np.repeat(np.cumsum(hits) - hits, hits) + items.post_from[ids[entry]]
    cell = row[entry] * size[1] + items.post_item[post]
    value = impacts[entry].astype(float)
    known = np.bincount(cell, items.post_weight[post] * value, size[0] * size[1]).reshape(size)
    used = np.bincount(cell, value * value, size[0] * size[1]).reshape(size)
    left = np.sqrt(np.maximum(np.square(norms)[:, None] - used, 0) + 1e-12 * np.square(norms)[:, None])
    return np.nonzero((known + left * items.rest >= least * SLACK) & active)


def exact_scores(items: Items, doc: np.ndarray, item: np.ndarray, at: np.ndarray, ids: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """The integer scores of pairs, some at a time."""
    out = np.zeros(len(doc), dtype=np.int64)
    size = np.diff(at)[doc]
    some = np.flatnonzero(size)
    for part in np.array_split(some, 1 + int(size.sum()) // 2_000_000):
        if len(part):
            n = size[part]
            begin = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(begin - at[doc[part]], n)
            out[part] = np.add.reduceat(items.weights[np.repeat(item[part], n), ids[place]] * impacts[place], begin)
    return out


class Best:
    """The best hits of an item so far, and the score that a further hit must reach."""

    def __init__(self, top: int, least: int):
        self.top, self.least, self.hits = top, least, []

    def add(self, scores: np.ndarray, doc_ids: list) -> None:
        self.hits += [(-s, d is None, d) for s, d in zip(scores.tolist(), doc_ids, strict=True) if s >= self.least]
        self.hits.sort(key=lambda h: (h[0], h[1], h[2] or 0))
        del self.hits[self.top :]
        if len(self.hits) == self.top:
            self.least = max(self.least, -self.hits[-1][0])


HITS = "item int, doc_id long, score long"
_HITS = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def ranked(long_first: DataFrame, counts: list[dict[int, int]], weights: np.ndarray, least: list[int], top: int) -> DataFrame:
    """item, doc_id, score: each task's best hits of every item, from vectors in falling length."""
    shared = long_first.sparkSession.sparkContext.broadcast((counts, weights, least))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, least = shared.value
        blocks = [Items(counts[k : k + ITEM_BLOCK], weights) for k in range(0, len(counts), ITEM_BLOCK)]
        best = [Best(top, least_) for least_ in least]

        def bucket(doc_ids: list, norms: np.ndarray, at: np.ndarray, ids: np.ndarray, impacts: np.ndarray) -> None:
            for b, items in enumerate(blocks):
                mine = best[b * ITEM_BLOCK : (b + 1) * ITEM_BLOCK]
                need = np.array([x.least for x in mine], dtype=float)
                active = items.norm * norms.max() >= need * SLACK
                if not active.any():
                    continue
                own = items.entries(at, ids, impacts)
                doc, item = survivors(items, active, need, norms, *own)
                score = exact_scores(items, doc, item, *own)
                order = np.argsort(item, kind="stable")
                for one, found in zip(*np.unique(item[order], return_index=True), strict=True):
                    these = order[found : found + np.count_nonzero(item == one)]
                    mine[one].add(score[these], [doc_ids[d] for d in doc[these]])

        for doc_ids, norms, ids, impacts in rows_of(batches, "doc_id", "norm", "ids", "impacts"):
            for k in range(0, len(doc_ids), BUCKET):
                cut = slice(k, k + BUCKET)
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids[cut]])]).astype(np.int64)
                bucket(doc_ids[cut], np.array(norms[cut]), at, np.frombuffer(b"".join(ids[cut]), dtype=np.int32).astype(np.int64),
                       np.frombuffer(b"".join(impacts[cut]), dtype=np.int64))
        rows = [(i, d, -s) for i, x in enumerate(best) for s, _, d in x.hits]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

    return long_first.mapInArrow(rank, HITS)


def _ordered(hits: DataFrame, top: int) -> DataFrame:
    """The best of the tasks' hits, numbered from 1."""
    by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)


def _slices(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """The items' term counts, in slices; the driver holds one slice at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    out, held, last = [], 0, object()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        words = terms(row.text)
        if row.item_id != last:
            if held >= SLICE_TERMS:
                yield out
                out, held = [], 0
            out.append((row.item_id, Counter()))
            last = row.item_id
        out[-1][1].update(words)
        held += len(words)
    if out:
        yield out


def _search(docs: DataFrame, items: list[tuple[int | None, Counter]], top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, count in items for t in count}))}
    found = saved(counted(docs, vocabulary), "term-counts")
    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = frequencies(found, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    counts = [{vocabulary[t]: k for t, k in count.items()} for _, count in items]

    order = [F.col("norm").desc(), F.col("doc_id")]
    longest = saved(vectors(found, total.n, total.terms).repartitionByRange(*order).sortWithinPartitions(*order), "impact-vectors")
    cut = longest.approxQuantile("norm", [1 - 1 / FIRST_SHARE], 0.01)
    if not cut:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def by_length(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions(F.col("norm").desc())

    first = saved(_ordered(ranked(by_length(longest.where(F.col("norm") >= cut[0])), counts, weights, [1] * len(items), top), top), "first-hits")
    tenth = {r.item: r.score for r in first.where(F.col("rank") == top).select("item", "score").toLocalIterator()}  # a row an item of the slice
    least = [max(1, tenth.get(i, 1)) for i in range(len(items))]
    lengths = [math.sqrt(sum((k * int(weights[t])) ** 2 for t, k in c.items())) for c in counts]
    reach = min((s / n for s, n in zip(least, lengths, strict=True) if n), default=math.inf) * SLACK
    others = by_length(longest.where((F.col("norm") < cut[0]) & (F.col("norm") >= reach)))
    hits = _ordered(first.drop("rank").unionByName(ranked(others, counts, weights, least, top)), top)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    return hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents of highest score, equal scores by ascending doc_id."""
    found = [_search(docs, s, top) for s in _slices(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def oracle(top: int = 10) -> str:
    """DuckDB SQL for search() over the tables documents and benchmark: every pair with a common term is scored."""
    split = (r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
w AS (SELECT rid, {split} FROM d),
tf AS (SELECT rid, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT rid, count(*) AS n FROM w GROUP BY rid),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, {split} FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
weight AS (SELECT item_id, q.term, k * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * coalesce(df, 0) + 1))) AS BIGINT) AS w
 FROM q LEFT JOIN df ON q.term = df.term, total),
m AS (SELECT rid, CAST(25 + (75 * n * docs) // terms AS BIGINT) AS m FROM n, total),
scored AS (SELECT item_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
 FROM weight JOIN tf USING (term) JOIN m USING (rid) GROUP BY ALL),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
 FROM scored JOIN d USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM placed WHERE rank <= {top}"""
