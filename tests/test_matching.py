"""Scored matching, its learned weights, and connected components against plain versions."""

import random
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollweave.operators import components, crossroll, matching
from rollweave.operators.matching import Equal, Moving, Similar

FIELDS = (Equal("name"), Equal("relative"), Moving("age"))
WEIGHTS = {"name": (-300, 400), "relative": (-200, 300), "age": (-200, 250)}
ROLL = "id long, name string, relative string, age int"


def groups(links):
    """node -> smallest reachable, by union-find."""
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def chain(n):
    order = list(range(n))
    random.Random(1).shuffle(order)
    return list(zip(order, order[1:]))


GRAPHS = {
    "random": [(random.Random(k).randrange(300), random.Random(k + 9999).randrange(300)) for k in range(200)],
    "chain": chain(700), "line": [(k, k + 1) for k in range(300)], "star": [(0, k) for k in range(1, 500)], "high hub": [(999, k) for k in range(500)],
    "dense": [(a, b) for a in range(30) for b in range(30)], "two": [(1, 2), (2, 1), (5, 5), (7, 8)], "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    links = [(a, b) for a, b in GRAPHS[name]]
    rows = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    want = {x: c for x, c in groups(links).items() if any(x in pair and pair[0] != pair[1] for pair in links)}
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want


def test_component_rounds_grow_slowly(spark, monkeypatch):
    rounds = Counter()
    real = components.stage

    def counted(df, label):
        rounds[label] += 1
        return real(df, label)

    monkeypatch.setattr(components, "stage", counted)
    found = {}
    for n in (16, 256):
        rounds.clear()
        components.connected(spark.createDataFrame(chain(n), "a long, b long")).count()
        found[n] = rounds["stars"]
    assert found[256] <= 2 * found[16] <= 16


def test_components_of_texts(spark):
    rows = components.connected(spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "a string, b string")).collect()
    assert {r.node: r.component for r in rows} == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def test_persons_linked_by_hot_key(spark):
    rows = [(k, "hot" if k % 3 == 0 else None, k // 4) for k in range(600)]
    got = crossroll.link_persons(spark.createDataFrame(rows, "id long, a string, b long"), "id", ["a", "b"])
    links = [(x, min(y for y, *key in rows if key[at] == rows[x][at + 1])) for x in range(600) for at in (0, 1) if rows[x][at + 1] is not None]
    want = groups(links)
    assert {r.id: r.canonical_id for r in got.collect()} == {k: want.get(k, k) for k, *_ in rows}


def rolls(seed):
    rng = random.Random(seed)
    names, relatives = [f"n{k}" for k in range(12)], [f"r{k}" for k in range(8)] + [None]
    old = [(k, rng.choice(names), rng.choice(relatives), rng.choice([30, 31, 45, None])) for k in range(60)]
    new = [(k + 100, rng.choice([n, rng.choice(names)]), r, None if a is None else a + 20 + rng.choice([0, 1, 5])) for k, n, r, a in rng.sample(old, 50)]
    copies = [(300 + k, "n0", "r0", 50) for k in range(25)]
    return old + copies, new + [(400 + k, "n0", "r0", 70) for k in range(17)] + [(500, None, None, None)]


def level(o, n):
    return [None if x is None or y is None else int(f(x, y)) for x, y, f in (
        (o[1], n[1], lambda x, y: x == y), (o[2], n[2], lambda x, y: x == y), (o[3], n[3], lambda x, y: abs(y - x - 20) <= 1))]


def blocked(o, n):
    return (o[1] is not None and o[1] == n[1]) or (o[2] is not None and o[2] == n[2])


def total(levels):
    return sum(WEIGHTS[f.field][x] for f, x in zip(FIELDS, levels) if x is not None)


def profile_matches(old, new, threshold):
    """Greedy over profiles with copies: (old profile, new profile) -> number of records."""
    sides = []
    for rows in (old, new):
        by = {}
        for r in rows:
            by.setdefault(r[1:], []).append(r[0])
        sides.append({min(ids): [len(ids), (None, *key)] for key, ids in by.items()})
    edges = []
    for a, (_, o) in sides[0].items():
        for b, (_, n) in sides[1].items():
            if blocked(o, n) and total(level(o, n)) >= threshold:
                edges.append((-total(level(o, n)), md5(f"{a}|{b}".encode()).hexdigest(), a, b))
    out = Counter()
    for _, _, a, b in sorted(edges):
        k = min(sides[0][a][0], sides[1][b][0])
        if k:
            out[a, b] += k
            sides[0][a][0] -= k
            sides[1][b][0] -= k
    return out


@pytest.mark.parametrize("seed, block", [(1, 2000), (2, 3)])
def test_one_to_one_matches(spark, monkeypatch, seed, block):
    monkeypatch.setattr(matching, "BLOCK_ROWS", block)  # also with blocks and copies counted in several parts
    old, new = rolls(seed)
    a, b = spark.createDataFrame(old, ROLL), spark.createDataFrame(new, ROLL)
    got = matching.match_rolls(a, b, "id", FIELDS, [("name",), ("relative",)], 20, WEIGHTS, 300).collect()
    assert len({r.old_id for r in got}) == len(got) == len({r.new_id for r in got})
    first = [{}, {}]
    for side, rows in enumerate((old, new)):
        for r in rows:
            first[side][r[1:]] = min(r[0], first[side].get(r[1:], r[0]))
    by_id = [{r[0]: r for r in rows} for rows in (old, new)]
    found = Counter((first[0][by_id[0][r.old_id][1:]], first[1][by_id[1][r.new_id][1:]]) for r in got)
    assert found == profile_matches(old, new, 300)
    assert all(r.weight == total(level(by_id[0][r.old_id], by_id[1][r.new_id])) for r in got)


def test_empty_rolls(spark):
    old, new = rolls(3)
    empty, full = spark.createDataFrame([], ROLL), spark.createDataFrame(old, ROLL)
    assert matching.match_rolls(empty, full, "id", FIELDS, [("name",)], 20, WEIGHTS, 300).count() == 0
    with pytest.raises(ValueError, match="no candidate pairs"):
        matching.match_rolls(empty, full, "id", FIELDS, [("name",)], 20)


def plain_learning(pairs, size, random=None):
    """Expectation-maximisation pair by pair."""
    share, match = 0.1, [[0.2 / (s - 1)] * (s - 1) + [0.8] for s in size]
    n = len(pairs)

    def shares(weight, pairs=pairs):
        out = []
        for k, s in enumerate(size):
            c = [sum(w for p, w in zip(pairs, weight) if p[k] == x) + 1e-4 for x in range(s)]
            out.append([v / sum(c) for v in c])
        return out

    other = shares([1] * n) if random is None else shares([1] * len(random), random)
    for _ in range(60):
        post = []
        for p in pairs:
            a, b = share, 1 - share
            for k, x in enumerate(p):
                if x is not None:
                    a, b = a * match[k][x], b * other[k][x]
            post.append(a / (a + b))
        share, match, other = sum(post) / n, shares(post), shares([1 - p for p in post]) if random is None else other
    return share, match, other


@pytest.mark.parametrize("apart", [False, True])
def test_learned_weights(spark, apart):
    rng = random.Random(4)
    pairs = []
    for k in range(600):
        same = k % 5 == 0
        pairs.append([None if rng.random() < 0.1 else int(rng.random() < (0.9 if same else 0.15)), int(rng.random() < (0.85 if same else 0.3)),
                      int(rng.random() < (0.95 if same else 0.1))])
    random_ = [[int(rng.random() < 0.15), int(rng.random() < 0.3), int(rng.random() < 0.1)] for _ in range(300)] if apart else None

    def counts(levels):
        rows = spark.createDataFrame(levels, "name_level int, relative_level int, age_level int")
        return matching.patterns(rows.withColumns({"old_n": F.lit(1), "new_n": F.lit(1)}), FIELDS)

    model = matching.learn(counts(pairs), FIELDS, counts(random_) if apart else None, rounds=60, still=0)
    share, match, other = plain_learning(pairs, [2, 2, 2], random_)
    assert model.share == pytest.approx(share, rel=1e-6)
    for k, f in enumerate(FIELDS):
        assert np.allclose(model.match[f.field], match[k], rtol=1e-6) and np.allclose(model.other[f.field], other[k], rtol=1e-6)
    assert abs(model.share - 0.2) < 0.05 and model.weights()["name"][1] > 150 > 0 > model.weights()["name"][0]


@pytest.mark.parametrize("learned", [False, True])
def test_planted_persons_are_found(spark, learned):
    """Customers are the same persons in both stand-in rolls: most are matched, and nearly all matches are right."""
    from rollweave.plans import full_catalog

    job = full_catalog().jobs["person_match_learned" if learned else "person_match"]
    got = job(spark, "/root/testdata/sf0.01").collect()
    right = sum(r.new_id == r.old_id + 1000000 for r in got)
    possible = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_custkey").distinct().count()
    assert right / len(got) > 0.9 and right / possible > 0.85, (right, len(got), possible)


def test_linkage_by_score(spark):
    old, _ = rolls(6)
    old += [(k + 1000, *r[1:]) for k, r in enumerate(old[:10])]
    got = matching.link_by_score(spark.createDataFrame(old, ROLL), "id", (Similar("name"), Equal("relative")), [("name",), ("relative",)],
                                 {"name": (-400, 0, 0, 400), "relative": (-100, 200)}, 600)
    links = [(a[0], b[0]) for a in old for b in old if a[1] == b[1] and a[2] == b[2] and a[2] is not None] + [(a[0], b[0]) for a in old for b in old if a[1:3] == b[1:3]]
    assert {r.id: r.canonical_id for r in got.collect()} == groups(links)


def test_array_keys_meet_once(spark):
    a = spark.createDataFrame([(1, [1, 2, 3], "x"), (2, [9], "x"), (3, None, None)], "profile long, born array<int>, name string").withColumn("n", F.lit(1))
    pairs = matching.candidates(a, a, [("born",), ("name",)], ordered=True)
    assert [(r.old_profile, r.new_profile) for r in pairs.collect()] == [(1, 2)]
    b = spark.createDataFrame([(7, [2, 3, 4], "y")], "profile long, born array<int>, name string").withColumn("n", F.lit(1))
    assert [(r.old_profile, r.new_profile) for r in matching.candidates(a, b, [("born",), ("name",)]).collect()] == [(1, 7)]
