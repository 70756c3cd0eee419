"""Name and relative together, in bulk, against comparing every query with every record."""

import random

import pytest

from rollweave.operators import pairsearch


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def like(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def rows(seed):
    rng = random.Random(seed)
    words = ["anita", "anil", "patil", "patel", "more", "mohan", "li", "shinde", "shinda"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 3)))
    voters = [(i, rng.choice("xy"), text(), text()) for i in range(200)] + [(900 + i, "x", "hot name", "hot relative") for i in range(50)]
    queries = [(i, rng.choice("xyz"), text().upper(), "  " + text()) for i in range(40)] + [(90, "x", "hot nam", "hot"), (91, "x", None, "hot"), (92, "x", "hot", "")]
    return voters, queries


@pytest.mark.parametrize("name_t, relative_t, k", [(0.3, 0.3, 5), (0.3, 0.3, 1000), (0.6, 0.2, 1000)])
def test_same_as_all_pairs(spark, name_t, relative_t, k):
    voters, queries = rows(1)
    v = spark.createDataFrame(voters, "voter_record_id long, ac string, name_normalized string, relative_name_normalized string")
    q = spark.createDataFrame(queries, "query_id long, ac string, name string, relative string")
    got = pairsearch.name_and_relative_search_batch(q, v, ["ac"], name_t, relative_t, k).collect()
    want = {}
    for i, ac, n, r in queries:
        hits = [(-(like(n or "", a) + like(r, b)), j) for j, at, a, b in voters if at == ac and like(n or "", a) >= name_t and like(r, b) >= relative_t]
        want[i] = sorted(hits)[:k]
    assert len(got) == sum(map(len, want.values()))
    for i, hits in want.items():
        mine = sorted((r["rank"], r.voter_record_id, r.name_score + r.relative_score) for r in got if r.query_id == i)
        assert [s for *_, s in mine] == pytest.approx([-s for s, _ in hits], abs=2e-4)
        if k == 1000:
            assert {j for _, j, _ in mine} == {j for _, j in hits}


def test_pairs_pass_both_size_bounds(spark):
    voters, queries = rows(2)
    v = spark.createDataFrame([r[1:] for r in voters], "ac string, name string, relative string")
    q = spark.createDataFrame([(r[1], (r[2] or "").lower(), r[3].strip()) for r in queries], "ac string, name string, relative string")
    pairs = pairsearch.candidate_pairs(q, v, ["ac"], {"name": 0.3, "relative": 0.3}).collect()
    assert pairs
    for p in pairs:
        for a, b in ((p.query_name, p.name), (p.query_relative, p.relative)):
            x, y = len(grams(a)), len(grams(b))
            assert min(x, y) >= 0.3 * max(x, y) * 0.999
    assert len({tuple(p) for p in pairs}) == len(pairs)


def test_threshold_of_nothing(spark):
    v = spark.createDataFrame([], "voter_record_id long, ac string, name_normalized string, relative_name_normalized string")
    q = spark.createDataFrame([(1, "x", "a", "b")], "query_id long, ac string, name string, relative string")
    assert pairsearch.name_and_relative_search_batch(q, v, ["ac"]).count() == 0
    with pytest.raises(ValueError):
        pairsearch.name_and_relative_search_batch(q, v, ["ac"], 0.0)
