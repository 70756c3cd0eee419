"""Documents with fewer words than a benchmark item, against their own definition: the whole text is the one window."""

import random
from collections import Counter

from llm import brute

from rollweave.llm import decontaminate


def whole_matches(rows, items, least=0.8):
    """(doc_id, item_id) -> (0, words, similarity) of the texts shorter than the item."""
    def count(w):
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))

    out = {}
    for item, text in items:
        b = brute.words(text.translate(brute.LOWER))
        for i, t in rows:
            w = brute.words((t or "").translate(brute.LOWER))
            if len(w) < len(b):
                x, y = count(w), count(b)
                like = sum((x & y).values()) / max(sum((x | y).values()), 1)
                if like >= least:
                    out[i, item] = (0, len(w), like)
    return out


def cases():
    rng = random.Random(3)
    items = [(n, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for n in (3, 5, 6, 9, 10, 20, 37, 37, 80, 300)]
    items = [(k, t) for k, (_, t) in enumerate(items)] + [(90, "la " * 40)]
    rows = []
    for _, text in items:
        w = text.split()
        for gone in range(1, max(2, len(w) // 3)):
            at = rng.randrange(gone + 1)
            rows.append(" ".join(w[at : len(w) - gone + at]))  # cut at the ends
        rows += [" ".join(w[: len(w) // 2] + w[len(w) // 2 + 1 :]).upper(), " ".join([*w[:-4], "other"]), text, "before " + text]
    return list(enumerate([*rows, None, "", "one"])), items


def test_an_item_less_one_word_is_found(spark):
    item = " ".join(f"word{k}" for k in range(37))
    docs = brute.frame(spark, [(1, item.rsplit(" ", 1)[0]), (2, " ".join(item.split()[:20])), (3, "clean")])
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 7, 0, 36, 32 / 33)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, items).collect()) == [2, 3]


def test_texts_shorter_than_the_item(spark):
    rows, items = cases()
    frame = spark.createDataFrame(items, "item_id long, text string")
    docs = brute.frame(spark, rows)
    want = {**brute.item_matches(rows, items), **whole_matches(rows, items)}
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.contaminated(docs, frame).collect()}
    assert got == want and len(whole_matches(rows, items)) > 50
    assert {r.doc_id for r in decontaminate.decontaminated(docs, frame).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_items_without_an_id_are_looked_for(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 2)
    passages = [" ".join(f"{c}{k}" for k in range(30)) for c in "pqr"]
    docs = brute.frame(spark, [(1, f"{passages[0]} and {passages[1]}"), (2, passages[2]), (3, "clean")])
    items = spark.createDataFrame([(None, passages[0]), (None, passages[1]), (5, passages[2]), (None, None)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start_word) for r in decontaminate.contaminated(docs, items).collect()), key=str)
    assert got == [(1, None, 0), (1, None, 31), (2, 5, 0)]
    assert [r.doc_id for r in decontaminate.decontaminated(docs, items).collect()] == [3]
