"""Pairs compared inside tasks against pairs as rows of a table."""

import random

import pytest
from pyspark.sql import functions as F

from rollweave.operators import blocks, components, matching
from rollweave.operators.matching import Equal, Moving, Similar

FIELDS = (Similar("name"), Equal("sex"), Moving("age"))
PASSES = (("scope", "name"), ("born", "sex"), ("scope", "sex"))
WEIGHTS = {"name": (-300, 50, 200, 400), "sex": (-100, 100), "age": (-200, 250)}


def roll(spark, seed, start, several):
    rng = random.Random(seed)
    names = ["anna berg", "ana berg", "jon dahl", "john dahl", "jo", "", "--", None, "ökad bergå", "berg anna"]
    rows = [(start + k, rng.choice([1, 2, None]), rng.choice(names), rng.choice(["f", "m", None]), rng.choice([30, 31, 32, 50, None])) for k in range(70)]
    df = spark.createDataFrame(rows, "id long, scope int, name string, sex string, age int")
    return df.withColumn("born", F.expr("array(2001 - age, 2002 - age, 2003 - age)") if several else F.expr("2002 - age"))


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("block, chunk, table, several", [(2000, 1_000_000, 20_000_000, False), (4, 100, 0, True)])
def test_same_as_pairs_in_a_table(spark, monkeypatch, block, chunk, table, several):
    monkeypatch.setattr(matching, "BLOCK_ROWS", block)
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    monkeypatch.setattr(blocks, "TABLE", table)
    keys = ["scope", "name", "born", "sex"]
    old, new = (matching.profiles(roll(spark, *x), "id", FIELDS, keys) for x in ((1, 0, True), (2, 1000, several)))
    plain = matching.levels(matching.candidates(old, new, PASSES), FIELDS, 1)
    names = [f"{c.field}_level" for c in FIELDS] + ["pairs"]
    assert rows(matching.pattern_counts(old, new, PASSES, FIELDS, 1), *names) == rows(matching.patterns(plain, FIELDS), *names)
    kept = ["old", "new", "old_n", "new_n", "weight"]
    assert rows(matching.edges(old, new, PASSES, FIELDS, 1, WEIGHTS, 300), *kept) == rows(matching.weighed(plain, FIELDS, WEIGHTS, 300), *kept)


def test_ties_give_the_groups_of_all_edges(spark):
    folded = matching.profiles(roll(spark, 3, 0, True), "id", FIELDS, ["scope", "name", "born", "sex"])
    edges = matching.weighed(matching.levels(matching.candidates(folded, folded, PASSES, ordered=True), FIELDS), FIELDS, WEIGHTS, 500)
    want = components.connected(edges.select(F.col("old").alias("a"), F.col("new").alias("b")))
    got = components.connected(matching.ties(folded, PASSES, FIELDS, WEIGHTS, 500))
    assert rows(got, "node", "component") == rows(want, "node", "component") != []


def test_no_table_of_pairs_is_written(spark, monkeypatch):
    labels = []
    real = matching.stage
    monkeypatch.setattr(matching, "stage", lambda df, label: labels.append(label) or real(df, label))
    a, b = roll(spark, 4, 0, True), roll(spark, 5, 1000, True)
    matching.match_rolls(a, b, "id", FIELDS, PASSES, 1, WEIGHTS, 300).count()
    matching.link_by_score(a, "id", FIELDS, PASSES, WEIGHTS, 500).count()
    assert "levels" not in labels
