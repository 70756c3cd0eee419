"""The filter audit against a plain walk through every order, row by row."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from rollweave.llm import filter_audit

DOCS = "doc_id long, text string, lang string, row string, part int, digest string"
LABELS = "doc_id long, quality int, toxic int, good string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(docs, labels):
    found = []
    for i, text, lang, *_ in docs:
        text = text or ""
        f = fails(text)
        f["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs)
        good, toxic = (any(x[0] == i is not None and x[k] == 1 for x in labels) for k in (1, 2))
        found.append((lang or "", f, good, toxic))
    out = {}
    for part in {p for p, *_ in found}:
        mine = [x for x in found if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, name in enumerate(order):
                gone = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                total[name] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(x[1][name] for x in mine) - len(gone), sum(x[1][name] and sum(x[1].values()) == 1 for x in mine),
                    sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def result(spark, docs, labels):
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}


def rows():
    rng = random.Random(5)
    texts = [None, "", " \n", "a b c", "SHOUT " * 120, "x " * 200_000, "word | pipe", "é" * 50 + " #", "A" * 10 + "b" * 90]
    texts += [" ".join(rng.choices([f"w{k}" for k in range(400)], k=rng.choice([20, 99, 100, 101, 300]))) for _ in range(20)]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", "", None]), "r", k, "d") for k in range(120)]
    docs += [docs[3], (7, "again", "en", None, None, None), (None, "a b c", "fr", "r", 0, "d"), (None, "a b c", "fr", "r", 0, "d")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "g") for k in range(0, 120, 2)] + [(4, 1, 1, "g"), (None, 1, 1, "g"), (9999, 1, 1, "g")]
    return docs, labels


def test_same_as_brute_force(spark):
    docs, labels = rows()
    assert result(spark, docs, labels) == brute(docs, labels)


def test_hot_copies_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_COPIES", 3)
    docs, labels = rows()
    docs += [(1000 + k, "one hot text", "en", "r", 0, "d") for k in range(60)]
    assert result(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert result(spark, [], []) == {}
    docs, _ = rows()
    assert result(spark, docs, []) == brute(docs, [])


def test_own_filters_and_parts(spark):
    docs = spark.createDataFrame([(1, "bad thing", "s1"), (2, "good", "s1"), (3, "good", "s2")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, {"bad": lambda text: text.contains("bad")}, part="source")
    first = {(r.part, r.filter_order): (r.kept, r.removed, r.good_lost) for r in got.where(F.col("step") == 1).collect()}
    assert first == {("s1", "badE"): (1, 1, 1), ("s1", "Ebad"): (2, 0, 0), ("s2", "badE"): (1, 0, 0), ("s2", "Ebad"): (0, 1, 0)}
