"""Near duplicates of tables whose rows repeat a doc_id with other texts: links of any row are the id's."""

import random

from llm import brute

from rollweave.llm import near_dedup


def linked(rows, width: int, percent: int) -> dict[int, int]:
    """doc_id -> component, over all pairs of rows."""
    sets = [(i, brute.shingles(t, width)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 100 * len(a & b) >= percent * len(a | b) > 0:
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in top}


def components(spark, rows):
    found = near_dedup.near_duplicates(brute.frame(spark, rows), 3, 85)
    return {(r.doc_id, r.component_id) for r in found.collect()}


def test_sets_of_equal_size(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail")]
    assert components(spark, rows) == {(1, 1), (2, 1), (3, 1)}


def test_own_words_of_another_row(spark, monkeypatch):
    """A hot list in which only later rounds compare most pairs; every id has a second row of words of its own."""
    monkeypatch.setattr(near_dedup, "PAIRS_AN_ENTRY", 0)
    monkeypatch.setattr(near_dedup, "LINKED_SHARE", 0)
    monkeypatch.setattr(near_dedup, "MOST_ROUNDS", 2)
    monkeypatch.setattr(near_dedup, "HUBS", 1)
    rng, template, rows = random.Random(1), [f"t{k}" for k in range(400)], []
    for family in range(20):  # two near copies, told from the others only by a stretch that both lack
        at = rng.randrange(320)
        rest = template[:at] + template[at + 80 :]
        rows += [(2 * family, " ".join(rest)), (2 * family + 1, " ".join(rest[:-1]))]
    rows += [(i, " ".join(f"own{i}z{k}" for k in range(500))) for i, _ in rows]
    assert components(spark, rows) == set(linked(rows, 3, 85).items())
