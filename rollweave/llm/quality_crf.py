"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad; its own signals, those of the lines before and after it, and the label of
the line before decide. The field is fitted on a bounded sample of labelled documents (``SAMPLE`` documents
of at most ``SAMPLE_LINES`` lines, chosen by a hash of doc_id), whose lines take the document's label, by
gradient ascent on the conditional likelihood with forward-backward expectations. A document's score is
the mean of its lines' marginal probabilities of being good, weighted by the lines' lengths.

Defined results: a NULL or empty text is one empty line; if no row is labelled, or all alike, every score is
the share of label 1 (0.5 without rows); rows that repeat a doc_id are scored each, their labels joined by
the greatest; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.llm.common import WORD, batch_of, bounded_batches, only_ids, rows_of, saved, texts
from rollweave.llm.wordhash import windows, word_hashes

SAMPLE = 3000
SAMPLE_LINES = 400
STEPS = 150
RATE = 0.1
PENALTY = 1e-4
PREDICTED_FROM = 0.3
_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIGITS = re.compile(r"[0-9]")
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
# Own signals of a line, in the order of its row of numbers; those from the mark on also count for its neighbours.
SIGNALS = ("length", "words", "word_length", "empty", "digits", "distinct", "marks", "symbols", "capitals", "repeats", "copy")
NEAR = SIGNALS.index("marks")
WIDTH = len(SIGNALS) + 2 * (len(SIGNALS) - NEAR) + 3


def line_signals(text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH signals, line lengths). words: the hashes of the text's words."""
    lines = text.split("\n")
    own = np.zeros((len(lines), len(SIGNALS)))
    repeated = np.zeros(len(words) + 1)
    if len(words) > 2:
        _, of, counts = np.unique(windows(words, 3), return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[of] > 1)
        for k in range(3):
            repeated[at + k] = 1
    repeats = np.concatenate([[0], np.cumsum(repeated)])
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    first = 0
    for k, line in enumerate(lines):
        tokens = _WORDS.findall(line)
        n, m = len(tokens), max(len(line), 1)
        own[k] = (
            math.log1p(len(line)) / 5, math.log1p(n) / 4, (len(line) - n) / max(n, 1) / 8, not n, len(_DIGITS.findall(line)) / m,
            len(set(tokens)) / max(n, 1), (line.count("!") + line.count("?")) / max(n, 1), len(_SYMBOLS.findall(line)) / max(n, 1),
            sum(map(str.isupper, tokens)) / max(n, 1), (repeats[first + n] - repeats[first]) / max(n, 1), n > 0 and seen[line] > 1)
        first += n
    near = own[:, NEAR:]
    none = np.zeros((1, near.shape[1]))
    ends = np.zeros((len(lines), 3))
    ends[:, 0], ends[0, 1], ends[-1, 2] = 1, 1, 1
    return np.hstack([own, np.vstack([none, near[:-1]]), np.vstack([near[1:], none]), ends]), np.array([len(x) for x in lines], dtype=np.float64)


def padded(sequences: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, lines x documents x signals, number of lines) of sequences of about one length at a time."""
    sizes = np.array([len(s) for s in sequences])
    classes = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    out = []
    for c in np.unique(classes):
        of = np.flatnonzero(classes == c)
        x = np.zeros((sizes[of].max(), len(of), WIDTH))
        for k, i in enumerate(of):
            x[: sizes[i], k] = sequences[i]
        out.append((of, x, sizes[of]))
    return out


def marginals(energy: np.ndarray, size: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over lines x documents: (log partition, P(good) of each line, expected label pairs).

    energy: of the label good against bad. links: 2 x 2, what the pair (label before, label) adds. Lines beyond a
    document's size are void.
    """
    lines, docs = energy.shape
    local = np.stack([np.zeros_like(energy), energy], axis=2)
    alpha, beta = np.empty((lines, docs, 2)), np.zeros((lines, docs, 2))
    alpha[0] = local[0]
    for t in range(1, lines):
        step = np.logaddexp(alpha[t - 1, :, :1] + links[0], alpha[t - 1, :, 1:] + links[1]) + local[t]
        alpha[t] = np.where((t < size)[:, None], step, alpha[t - 1])
    total = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
    pairs = np.zeros((2, 2))
    for t in range(lines - 2, -1, -1):
        after = local[t + 1] + beta[t + 1]
        inside = t + 1 < size
        step = np.logaddexp(after[:, None, 0] + links[:, 0], after[:, None, 1] + links[:, 1])
        beta[t] = np.where(inside[:, None], step, 0)
        joint = np.exp(alpha[t][:, :, None] + links + after[:, None, :] - total[:, None, None])
        pairs += joint[inside].sum(axis=0)
    return total, np.exp(alpha[:, :, 1] + beta[:, :, 1] - total), pairs


def fit_field(sequences: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the signals, links) by Adam over all sequences, each document weighing the same."""
    batches = padded(sequences)
    params = np.zeros(WIDTH + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        grad = -PENALTY * params * len(labels)
        links = params[WIDTH:].reshape(2, 2)
        for of, x, size in batches:
            there = np.arange(len(x))[:, None] < size
            _, good, pairs = marginals(x @ params[:WIDTH], size, links)
            y = labels[of]
            grad[:WIDTH] += np.einsum("td,tdf->f", (y[None, :] - good) * there / size, x)
            grad[WIDTH:] -= pairs.ravel() / size.mean()
            for label in (0, 1):
                grad[WIDTH + 3 * label] += (size[y == label] - 1).sum() / size.mean()
        grad /= len(labels)
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        params = params + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return params[:WIDTH], params[WIDTH:].reshape(2, 2)


class Field:
    def __init__(self, weights: np.ndarray | None, links: np.ndarray | None, prior: float):
        self.weights, self.links, self.prior = weights, links, prior

    def scores(self, some: list[str | None]) -> list[float]:
        if self.weights is None:
            return [self.prior] * len(some)
        signals = [line_signals(some[at + k] or "", w) for at, part in word_hashes(some) for k, w in enumerate(part)]
        out = np.zeros(len(some))
        for of, x, size in padded([s for s, _ in signals]):
            _, good, _ = marginals(x @ self.weights, size, self.links)
            for k, i in enumerate(of):
                out[i] = np.average(good[: size[k], k], weights=signals[i][1] + 1)
        return np.clip(out, 0, 1).tolist()


def _held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """The field learned from a bounded sample of the labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        ~_held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = saved(known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "labelled")
    rows = only_ids(texts(docs), chosen.select("doc_id")).where(f"text IS NOT NULL AND size(split(text, '\n')) <= {SAMPLE_LINES}")
    schema = pa.schema([("doc_id", pa.int64()), ("lines", pa.binary())])

    def measure(batches):
        for ids, some in rows_of(batches, "doc_id", "text"):
            found = [line_signals(some[at + k], w)[0] for at, part in word_hashes(some) for k, w in enumerate(part)]
            yield batch_of(schema, ids, [f.astype("<f8").tobytes() for f in found])

    bounded_batches(docs.sparkSession)
    sample = rows.mapInArrow(measure, "doc_id long, lines binary").join(chosen, "doc_id").collect()
    sample.sort(key=lambda r: (r["doc_id"], bytes(r["lines"])))
    y = np.array([r["quality"] for r in sample])
    if len(set(y.tolist())) < 2:
        return Field(None, None, float(y.mean()) if len(y) else 0.5)
    return Field(*fit_field([np.frombuffer(bytes(r["lines"]), dtype="<f8").reshape(-1, WIDTH) for r in sample], y), float(y.mean()))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    field = fit(docs, labels)

    def judge(batches):
        for ids, held, some in rows_of(batches, "doc_id", "held_out", "text"):
            scores = field.scores(some)
            yield batch_of(_SCORED, ids, held, scores, [int(s >= PREDICTED_FROM) for s in scores])

    bounded_batches(docs.sparkSession)
    return texts(docs).withColumn("held_out", _held_out()).mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
