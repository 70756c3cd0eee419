"""Language, rules, classifier and decontamination: held-out accuracy, SQL and brute force."""

import zlib

import duckdb
import numpy as np
import pytest
from compare import connect, difference
from llm import brute

import __spark_entry__ as contract
from rollweave.llm import decontaminate, language, quality_crf, quality_rules

CASES = {"awkward": brute.awkward, "empty": list}


def remainder(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    found = brute.rows_by_id(language.predict(docs))
    assert all(r.held_out == (remainder(i, 4) == 2) and 0 <= r.score <= 1 for i, r in found.items())
    held = [r for r in found.values() if r.held_out and truth[r.doc_id] is not None]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 3)).astype(np.uint8)
    mask, label, net = np.arange(5)[:, None] < np.array([5, 3, 1]), np.array([0, 1, 0]), language.Network(2)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}

    def loss():
        both = np.concatenate([net.states(d, x).astype(np.float64) for d in "fb"], axis=2)
        p = language._softmax(both @ net.weights["out"] + net.weights["bias"])
        return -(np.log(p[:, np.arange(3), label]) * mask).sum() / mask.sum()

    for name, grad in net.gradients(x, mask, label).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        weight = net.weights[name]
        weight[at] += 1e-2
        up = loss()
        weight[at] -= 2e-2
        down = loss()
        weight[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[at]) < 2e-3


@pytest.mark.parametrize("case", CASES)
def test_language_of_awkward_texts(spark, case):
    rows = CASES[case]()
    found = brute.rows_by_id(language.predict(brute.frame(spark, rows)))
    assert found.keys() == {i for i, _ in rows}
    for i, text in rows:
        assert (found[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    kept = language.accepted(brute.frame(spark, rows))
    assert kept.columns == brute.frame(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.lang_pred != "und"}


def test_no_labels_at_all(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.predict(docs).collect()] == [("und", 0.0)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_crf.score(docs, labels).collect()] == [0.5]


def test_rules_on_awkward_texts_equal_sql(spark):
    rows = [(i, t, "en" if i % 3 else None, "a" if i % 2 else None) for i, t in brute.awkward()]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows * 2)
    assert difference(spark, con, None, lambda s, _: quality_rules.judge(docs), quality_rules.oracle()) is None
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_rules_equal_sql(spark):
    query = contract.queries()["op2_quality_rules"]
    assert difference(spark, connect("/root/testdata/sf0.01"), "/root/testdata/sf0.01", query, contract.oracle_sql()["op2_quality_rules"]) is None


SHARES = "doc_id long, lang string, source string, symbol_share long, dup_line_share long, repeat_share long, word_length long"


def limits(spark, rows):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SHARES)
    return {r.source: r for r in quality_rules.thresholds(quality_rules.sketches(frame)).collect()}


def test_merged_sketches_are_sketches_of_all(spark):
    rows = [(k, "en", "ab"[k % 2], k * k % 1000, 0, 0, 500) for k in range(400)]
    frame = spark.createDataFrame(rows, SHARES)
    got = {r.signal: r for r in quality_rules.merged(quality_rules.sketches(frame), "lang").collect()}
    values = sorted(r[3] for r in rows)
    cells = sorted((c.value, c.n) for c in got["symbol_share"].cells)
    assert sum(n for _, n in cells) == got["symbol_share"].n == 400
    seen = 0
    for value, n in cells:
        assert value <= values[seen] and values[seen + n - 1] <= value * (1 + 1 / 32) + 1
        seen += n
    assert [tuple(c) for c in got["word_length"].cells] == [(496, 400)]


def test_thresholds_follow_their_source(spark):
    rng = np.random.default_rng(5)

    def source(name, n, unit):
        return [("en", name, *(int(x) for x in unit * rng.integers(50, 100, 4))) for _ in range(n)]

    rows = source("plain", 5000, 10) + source("code", 5000, 40) + source("small", 3, 10)
    got = limits(spark, rows)
    for signal in quality_rules.FENCES:
        most = {s: r[f"{signal}_most"] for s, r in got.items()}
        assert most["plain"] < 0.5 * most["code"]
        assert most["small"] > most["plain"]  # three rows are judged mostly by their language


def test_scaling_a_signal_scales_its_thresholds(spark):
    rng = np.random.default_rng(6)
    rows = [("en", "a" if k % 3 else None, *(int(x) for x in rng.integers(100, 300, 4) * (rng.random(4) < 0.9))) for k in range(2000)]
    once, eight = limits(spark, rows), limits(spark, [(x, y, *(8 * v for v in signals)) for x, y, *signals in rows])
    for source, row in once.items():
        for name, value in row.asDict().items():
            if name not in ("lang", "source"):
                assert abs(eight[source][name] - 8 * value) <= 8 * quality_rules.FENCES["word_length"][2]


def test_a_group_of_copies_rejects_no_neighbouring_values(spark):
    got = limits(spark, [("en", "a", 0, 0, 0, 500)] * 900 + [("en", "a", 0, 0, 0, 520)] * 100)["a"]
    assert got.word_length_least <= 480 and 520 <= got.word_length_most and got.symbol_share_most == 0


def test_share_of_rows_rejected(spark):
    folder = "/root/testdata/sf0.1"
    bad = duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rejected = {r.doc_id for r in quality_rules.judge(docs).where("NOT base_failed AND NOT kept").select("doc_id").collect()}
    good = [i for i, quality in bad if quality == 1]
    assert sum(i in rejected for i in good) < 0.02 * len(good)
    assert 0.05 < len(rejected) / 10000 < 0.12


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    found = brute.rows_by_id(quality_crf.score(spark.read.parquet(f"{folder}/documents.parquet"), labels))
    assert all(r.held_out == (remainder(i, 5) == 0) and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [r for r in found.values() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


@pytest.mark.parametrize("case", CASES)
def test_classifier_on_awkward_texts(spark, case):
    rows = CASES[case]()
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = brute.rows_by_id(quality_crf.score(brute.frame(spark, rows), labels))
    assert found.keys() == {i for i, _ in rows} and all(0 <= r.score <= 1 for r in found.values())


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(3)
    energy, links = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    _, good, _ = quality_crf.marginals(energy, np.array([4, 2]), links)
    for doc, n in enumerate((4, 2)):
        weight = {}
        for code in range(2**n):
            y = [code >> t & 1 for t in range(n)]
            weight[tuple(y)] = np.exp(sum(energy[t, doc] * y[t] for t in range(n)) + sum(links[a, b] for a, b in zip(y, y[1:])))
        total = sum(weight.values())
        for t in range(n):
            assert abs(sum(w for y, w in weight.items() if y[t]) / total - good[t, doc]) < 1e-9


def test_decontamination(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{brute.FOLDER}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in contract.queries()["op6_decontamination"](spark, brute.FOLDER).collect()}
    assert got == brute.item_matches(brute.documents(), items) and got


def test_decontamination_of_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 3)  # several slices
    passage = " ".join(f"word{k}" for k in range(10, 50))
    items = [(0, None), (1, ""), (2, "two words"), (3, "a b c"), (4, passage), (5, passage), (6, "one two three four five six"), (7, passage.replace("word30", "else"))]
    rows = brute.awkward()
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    docs = brute.frame(spark, rows)
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.contaminated(docs, frame).collect()}
    want = brute.item_matches(rows, items)
    assert got == want
    kept = decontaminate.decontaminated(docs, frame)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(docs, frame.limit(0)).collect() == []


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    prints = np.packbits(rng.integers(0, 2, (300, 64)), axis=1)
    items = decontaminate.Items.__new__(decontaminate.Items)
    items.ids, items.prints = list(range(300)), prints
    apart = decontaminate._ONES[np.arange(256, dtype=np.uint8)[:, None, None] ^ prints[None, :, :]]
    items.near = (apart <= decontaminate.RADIUS // decontaminate.BLOCKS).transpose(2, 0, 1)
    got = set(zip(*(x.tolist() for x in items.within(prints)), strict=True))
    distance = decontaminate._ONES[prints[:, None, :] ^ prints[None, :, :]].sum(axis=2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS)), strict=True))
