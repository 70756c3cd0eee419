"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in stretches of ``STRETCH`` bytes, forwards and backwards, by gated recurrent
units; every position gets probabilities of the labels from both states, and a document's are the mean over
all its positions. Training is backpropagation through time in numpy, on a bounded sample of labelled rows:
at most ``PER_LABEL`` documents of each label, ``MOST_DOCS`` in all, chosen by a hash of doc_id, and of each
at most ``STRETCHES`` stretches from all over its text. Scoring reads whole texts.

Defined results: a NULL text or one without a letter is ``und`` with score 0; so is every text if no row is
labelled; rows that repeat a doc_id are judged each; an empty table gives no rows; columns besides doc_id,
text and lang are ignored (predict) or kept (accepted). The pipeline drops texts that are ``und`` and no others,
whatever their score, and none if no row is labelled.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollweave.llm.common import batch_of, bounded_batches, only_ids, rows_of, saved, texts

STRETCH = 64
STATE = 12
PER_LABEL = 300
MOST_DOCS = 3000
STRETCHES = 12
ROUNDS = 5
LANES = 4096
READ_LANES = 1024  # stretches read at a time: their states stay in the processor's cache
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Network:
    """Two layers of gated units, one for each direction, and an output layer over both."""

    def __init__(self, labels: int, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.weights: dict[str, np.ndarray] = {"out": normal(2 * STATE, labels, scale=0.2), "bias": np.zeros(labels, dtype=np.float32)}
        for d in "fb":
            self.weights |= {f"gates_in_{d}": normal(256, 2 * STATE, scale=0.3), f"new_in_{d}": normal(256, STATE, scale=0.3),
                             f"gates_{d}": normal(STATE, 2 * STATE, scale=0.3), f"new_{d}": normal(STATE, STATE, scale=0.3)}

    def _step(self, d: str, x: np.ndarray, h: np.ndarray):
        w = self.weights
        gates = _sigmoid(np.take(w[f"gates_in_{d}"], x, axis=0) + h @ w[f"gates_{d}"])
        update, reset = gates[:, :STATE], gates[:, STATE:]
        inner = h @ w[f"new_{d}"]
        new = np.tanh(np.take(w[f"new_in_{d}"], x, axis=0) + reset * inner)
        return new + update * (h - new), (x, h, gates, inner, new)

    def states(self, d: str, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """The states at each position of x (positions, lanes)."""
        h = np.zeros((x.shape[1], STATE), dtype=np.float32)
        out = np.empty((*x.shape, STATE), dtype=np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            h, step = self._step(d, x[t], h)
            out[t] = h
            if tape is not None:
                tape.append((t, *step))
        return out

    def _read(self, d: str, x: np.ndarray) -> np.ndarray:
        """The states at each position, units by lanes: ``states`` without a copy or a temporary array in the loop."""
        half = np.float32(0.5)  # a sigmoid is a tanh of half its argument
        into, over = (np.ascontiguousarray(np.concatenate([self.weights[f"gates{k}_{d}"] * half, self.weights[f"new{k}_{d}"]], axis=1).T) for k in ("_in", ""))
        lanes = x.shape[1]
        h, z, u = (np.zeros((n * STATE, lanes), dtype=np.float32) for n in (1, 3, 3))
        gates, update, reset, new, inner = z[: 2 * STATE], z[:STATE], z[STATE : 2 * STATE], z[2 * STATE :], u[2 * STATE :]
        out = np.empty((len(x), STATE, lanes), dtype=np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(into, x[t], axis=1, out=z, mode="clip")
            np.matmul(over, h, out=u)
            gates += u[: 2 * STATE]
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            reset *= inner
            new += reset
            np.tanh(new, out=new)
            h -= new
            h *= update
            h += new
            out[t] = h
        return out

    def pooled(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The sum over the positions under the mask of the labels' probabilities, for each lane."""
        out = np.ascontiguousarray(self.weights["out"].T)
        total = np.empty((x.shape[1], len(self.weights["bias"])), dtype=np.float64)
        for k in range(0, x.shape[1], READ_LANES):
            cut = slice(k, k + READ_LANES)
            some = np.ascontiguousarray(x[:, cut])
            logits = np.matmul(out[:, :STATE], self._read("f", some))
            logits += np.matmul(out[:, STATE:], self._read("b", some))
            logits += self.weights["bias"][:, None]
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            logits *= mask[:, None, cut] / logits.sum(axis=1, keepdims=True)
            total[cut] = logits.sum(axis=0, dtype=np.float64).T
        return total

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions under the mask, by backpropagation through time."""
        w, tapes = self.weights, {"f": [], "b": []}
        both = np.concatenate([self.states(d, x, tapes[d]) for d in "fb"], axis=2)
        wrong = _softmax(both @ w["out"] + w["bias"])
        wrong[:, np.arange(x.shape[1]), label] -= 1
        wrong *= (mask / max(mask.sum(), 1))[:, :, None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["out"] = np.einsum("tls,tlk->sk", both, wrong)
        grad["bias"] = wrong.sum(axis=(0, 1))
        from_out = wrong @ w["out"].T
        for d, part in (("f", slice(0, STATE)), ("b", slice(STATE, None))):
            dh = np.zeros((x.shape[1], STATE), dtype=np.float32)
            for t, at, h, gates, inner, new in reversed(tapes[d]):
                dh = dh + from_out[t][:, part]
                update, reset = gates[:, :STATE], gates[:, STATE:]
                dnew = dh * (1 - update) * (1 - new * new)
                dgates = np.concatenate([dh * (h - new), dnew * inner], axis=1) * gates * (1 - gates)
                dinner = dnew * reset
                np.add.at(grad[f"gates_in_{d}"], at, dgates)
                np.add.at(grad[f"new_in_{d}"], at, dnew)
                grad[f"gates_{d}"] += h.T @ dgates
                grad[f"new_{d}"] += h.T @ dinner
                dh = dh * update + dgates @ w[f"gates_{d}"].T + dinner @ w[f"new_{d}"].T
        return grad


def train(x: np.ndarray, mask: np.ndarray, label: np.ndarray, labels: int, rounds: int = ROUNDS, size: int = 128, rate: float = 0.01) -> Network:
    """A network fitted to stretches x (positions, lanes) by Adam, always in the same way."""
    net, rng = Network(labels), np.random.default_rng(11)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(x.shape[1])
        for at in range(0, len(order), size):
            some = order[at : at + size]
            step += 1
            for k, g in net.gradients(x[:, some], mask[:, some], label[some]).items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by position and lane, mask, the text of each lane): each text cut into stretches, the last filled up with zeros."""
    lanes = [-(-len(t) // STRETCH) for t in texts]
    filled = b"".join([t.ljust(n * STRETCH, b"\0") for t, n in zip(texts, lanes, strict=True)])
    of = np.repeat(np.arange(len(texts)), lanes)
    x = np.frombuffer(filled, dtype=np.uint8).reshape(-1, STRETCH)
    at = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes) if len(of) else of
    left = np.array([len(t) for t in texts], dtype=np.int64)[of] - at * STRETCH
    mask = np.arange(STRETCH)[:, None] < left[None, :]
    return np.ascontiguousarray(x.T), mask, of


def _learnable() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2


def fit(docs: DataFrame) -> tuple[list[str], Network | None]:
    """The labels and the network learned from a bounded sample of rows with a language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(_learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = rows.select("doc_id", "lang").withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    chosen = chosen.where(F.col("_k") <= PER_LABEL).orderBy("_k", "lang").limit(MOST_DOCS).select("doc_id").distinct()
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.int32()), ("bytes", pa.binary())])

    def cut(batches):
        for ids, langs, some in rows_of(batches, "doc_id", "lang", "text"):
            out = [(i, lang, at, raw[at * STRETCH : (at + 1) * STRETCH]) for i, lang, raw in zip(ids, langs, (t.encode() for t in some), strict=True)
                   for n in [-(-len(raw) // STRETCH)] for at in sorted({k * n // STRETCHES for k in range(STRETCHES)} if n else ())]
            yield batch_of(schema, *(list(c) for c in zip(*out, strict=True))) if out else batch_of(schema, [], [], [], [])

    bounded_batches(docs.sparkSession)
    sample = only_ids(rows, saved(chosen, "sample")).mapInArrow(cut, "doc_id long, lang string, at int, bytes binary").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["lang"], r["at"], r["bytes"]))
    labels = sorted({r["lang"] for r in sample})
    if not labels:
        return [], None
    x, mask, _ = stretches([bytes(r["bytes"]) for r in sample])
    return labels, train(x, mask, np.array([labels.index(r["lang"]) for r in sample]), len(labels))


def judged(texts: list[str | None], labels: list[str], net: Network | None) -> tuple[list[str], list[float]]:
    """(label, score) of each whole text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    real = [i for i, t in enumerate(texts) if t and net is not None and _LETTER.search(t)]
    at = 0
    while at < len(real):
        held, size = [], 0
        while at < len(real) and (not held or size < LANES * STRETCH):
            held.append(real[at])
            size += len(texts[real[at]])
            at += 1
        raw = [texts[i].encode() for i in held]
        x, mask, of = stretches(raw)
        total = np.zeros((len(raw), len(labels)))
        for k in range(0, x.shape[1], LANES):
            np.add.at(total, of[k : k + LANES], net.pooled(x[:, k : k + LANES], mask[:, k : k + LANES]))
        total /= np.array([len(r) for r in raw])[:, None]
        for i, row in zip(held, total, strict=True):
            names[i], scores[i] = labels[int(row.argmax())], float(min(1.0, row.max()))
    return names, scores


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    labels, net = fit(docs)

    def label(batches):
        for ids, held, some in rows_of(batches, "doc_id", "held_out", "text"):
            yield batch_of(_PREDICTED, ids, held, *judged(some, labels, net))

    bounded_batches(docs.sparkSession)
    rows = texts(docs).withColumn("held_out", F.coalesce(~_learnable(), F.lit(False)))
    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that have a language, that is not ``und``; all if there is nothing to learn from."""
    labels, net = fit(docs)
    if net is None:
        return docs
    at = docs.columns.index("text")

    def choose(batches):
        for batch in batches:
            names, _ = judged(batch.column(at).to_pylist(), labels, net)
            yield batch.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(choose, docs.schema)
