"""Near duplicates, repeated words and repeated bytes against brute force."""

import hashlib
import random

import numpy as np
import pytest
from llm import brute

from rollweave.llm import near_dedup, substring, suffix_dedup
from rollweave.llm.components import components


def mutations(seed: int) -> list[tuple]:
    """Documents with chains of near copies, shared passages and periodic stretches."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [rng.choices(vocabulary, k=rng.randint(0, 130)) for _ in range(25)]
    passages = [rng.choices(vocabulary, k=rng.randint(20, 60)) for _ in range(4)]
    rows = []
    for k in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)[rng.randint(0, 5) :]
        if rng.random() < 0.1:
            w += ["tick", "tock"] * rng.randint(5, 60)
        rows.append((k, " ".join(w)))
    return rows


CASES = {"test table": brute.documents, "awkward": brute.awkward, "mutations": lambda: mutations(1), "empty": list}


@pytest.fixture(params=CASES)
def rows(request):
    return CASES[request.param]()


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, rows, width, percent):
    found = brute.rows_by_id(near_dedup.near_duplicates(brute.frame(spark, rows), width, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == brute.near_components(rows, width, percent)
    assert all(r.kept == (r.component_id == i) for i, r in found.items())


def test_near_duplicates_in_rounds(spark, monkeypatch):
    """Lists with many members: one member at a time, then the pairs that are left."""
    monkeypatch.setattr(near_dedup, "PAIRS_AN_ENTRY", 0)
    monkeypatch.setattr(near_dedup, "LINKED_SHARE", 0)
    monkeypatch.setattr(near_dedup, "MOST_ROUNDS", 2)
    monkeypatch.setattr(near_dedup, "HUBS", 1)
    rows = mutations(2)
    found = brute.rows_by_id(near_dedup.near_duplicates(brute.frame(spark, rows), 3, 85))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == brute.near_components(rows, 3, 85)


def test_near_duplicates_drops_copies_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here now then"), (None, "a b c d e f"), (4, None), (5, None)]
    kept = near_dedup.deduplicated(brute.frame(spark, rows))
    assert kept.columns == brute.frame(spark, []).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 4, 5]


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)}


@pytest.mark.parametrize("width", [20, 4])
def test_repeated_words(spark, rows, width):
    found = brute.rows_by_id(substring.remove_repeats(brute.frame(spark, rows), width))
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in found.items()} == brute.word_repeats(rows, width)


def test_repeated_words_keep_columns_and_clean_texts(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(0, f"Start.\n{passage}\n\nend  here"), (1, f"Other\tstart {passage} other  end"), (2, None), (3, " clean \n text ")]
    frame = brute.frame(spark, rows)
    got = {r.doc_id: r for r in substring.deduplicated(frame).select(frame.columns).collect()}
    assert got[0].text == rows[0][1] and got[2].text is None and got[3].text == rows[3][1]
    assert got[1].text == "Other\tstart other  end" and got[1].n_chars == len(got[1].text)
    assert [got[1][c] for c in brute.CLASHING] == list(brute.CLASHING)


def test_rows_that_repeat_an_id_are_one_document(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    got = substring.remove_repeats(brute.frame(spark, [(7, passage), (7, passage)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 25]


@pytest.mark.parametrize("width", [400, 60])
def test_repeated_bytes(spark, rows, width):
    found = brute.rows_by_id(suffix_dedup.remove_repeats(brute.frame(spark, rows), width))
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for i, r in found.items()}
    assert got == brute.byte_repeats(rows, width)


def test_long_lists_in_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(40):
        size = int(rng.integers(20, 40))
        bits = None if k % 9 == 0 else [int(x) for x in rng.integers(0, 1 << 60, 2)] + [0] * (near_dedup.BITS // 64 - 2)
        rows.append((k % 2, k, size, size - int(rng.integers(0, 5)), k // 5, k // 2, bits, 20))
    frame = spark.createDataFrame(rows, "value long, rep long, n_shingles long, most long, label long, place int, bits array<long>, n long")

    def close(x, y):
        sizes, shared = x[2] + y[2], min(x[3], y[3])
        if shared * 100 < (sizes - shared) * 80:
            return False
        if x[6] is None or y[6] is None:
            return True
        twice = sizes - sum((p ^ q).bit_count() for p, q in zip(x[6], y[6], strict=True))
        return twice * 100 >= (2 * sizes - twice) * 80

    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[4] != y[4] and x[5] >= 4 and y[5] >= 4 and close(x, y)}
    got = [tuple(sorted(r)) for r in near_dedup.block_pairs(frame, 4, 80).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
