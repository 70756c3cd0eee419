"""Ranked lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from rollweave.llm import lexical_search

DOCS = "doc_id long, text string, norm string, item int, ids string"
ITEMS = "item_id long, text string, score string"


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top):
    bags = [(d, Counter(words(t))) for d, t, *_ in docs if words(t)]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for item in {i for i, *_ in items}:
        asked = Counter(w for t in {t for i, t, *_ in items if i == item} for w in words(t))
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * count // total
            score = sum(k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (1000000000 * b[w] // (1000 * b[w] + 8 * m))
                        for w, k in asked.items() if w in b)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scores)[:top], 1):
            out[item, rank] = (d, -score)
    return out


def result(spark, docs, items, top=10):
    rows = lexical_search.search(spark.createDataFrame([(*d, "n", 1, "i") for d in docs], DOCS).repartition(5),
                                 spark.createDataFrame([(*i, "s") for i in items], ITEMS), top).collect()
    assert len({(r.item_id, r["rank"]) for r in rows}) == len(rows)
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}


def tables(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Über", "naïve", "一二", "x_y", "A1"]
    odds = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rng.choices(vocabulary, odds, k=rng.choice([1, 3, 20, 60, 300])))) for k in range(n)]
    items = [(k, " ".join(rng.choices(vocabulary, odds, k=rng.choice([1, 5, 40])))) for k in range(25)]
    docs += [(n + k, items[k][1].upper() + " more") for k in range(10)] + [(n + 20 + k, "the same text w299") for k in range(30)]
    docs += [(2000, None), (2001, ""), (2002, "-- ..."), (2003, "w7 " * 100_000), (5, docs[5][1]), (5, "w298 w298"), (None, "w298"), (None, "w298")]
    items += [(100, None), (101, ""), (102, "neverseen"), (103, "w299 w299"), (104, "w298"), (1, items[1][1]), (3, "w0 w1"), (None, "w2 w250")]
    return docs, items


@pytest.mark.parametrize("seed, bucket, block, slice_", [(1, 512, 256, 50_000), (2, 7, 4, 60)])
def test_same_as_brute_force(spark, monkeypatch, seed, bucket, block, slice_):
    """Also with buckets, item blocks and slices so small that there are many of each."""
    for name, value in (("BUCKET", bucket), ("ITEM_BLOCK", block), ("SLICE_TERMS", slice_)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = tables(seed)
    assert result(spark, docs, items) == brute(docs, items, 10)


def test_fewer_hits_than_asked_for(spark):
    docs, items = tables(3, 20)
    assert result(spark, docs, items, 200) == brute(docs, items, 200)


def test_empty_tables(spark):
    docs, items = tables(4, 20)
    assert result(spark, [], items) == {} == result(spark, docs, []) == result(spark, [(1, None)], items)


def test_bounds_leave_out_most_pairs():
    """Vectors that share no heavy term with an item are not scored once there are hits."""
    import numpy as np

    weights = np.arange(1, 101, dtype=np.int64) * 100
    items = lexical_search.Items([{90: 1, 95: 1, 99: 2, 3: 1}], weights)
    rows = [[1, 3, 5], [90, 99], [3, 50], [95], [99]]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids, impacts = np.concatenate(rows), np.full(at[-1], 500_000, dtype=np.int64)
    norms = np.sqrt(np.diff(at)) * 500_000
    own = items.entries(at, ids, impacts)
    doc, item = lexical_search.survivors(items, np.array([True]), np.array([9e9]), norms, *own)
    assert doc.tolist() == [1, 4] and item.tolist() == [0, 0]
    assert lexical_search.exact_scores(items, doc, item, *own).tolist() == [(9100 + 2 * 10000) * 500_000, 20000 * 500_000]
