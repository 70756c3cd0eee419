"""Words and keys that very many records share, in typo-tolerant and spelling search."""

import random

import pytest
from pyspark.sql import functions as F

from rollweave.operators import typos, variants
from tests.test_spelling import distance, near

LONG = ["sharma", "ramesh", "suresh", "mahesh", "patil", "lata", "an"]


@pytest.mark.parametrize("hot", [0, 3, 20])
def test_typo_search_is_the_same_by_profiles_and_by_records(spark, hot):
    rng = random.Random(7)
    spelled = [*LONG, "sarma", "rames", "surehs", "idx1234", "idx1243", "idx9934"]
    records = [(i, " ".join(rng.choices(LONG, k=2) + rng.choices(spelled, k=1))) for i in range(120)] + [(None, "sharma patil"), (3, "lata idx1234")]
    queries = [(i, " ".join(rng.choices([*spelled, "ramsh", "lta", "idx1235"], k=rng.randint(1, 3)))) for i in range(30)] + [(0, "ramesh"), (None, "lata"), (40, "nobody lata")]
    held = typos.index(spark.createDataFrame(records, "id long, name string"), "id", ["name"], hot=hot)
    got = typos.typo_search(spark.createDataFrame(queries, "query_id long, query string"), held, 4).collect()
    has = {}
    for i, text in records:
        has.setdefault(i, set()).update(text.split())
    want = set()
    for q in {q for q, _ in queries if q is not None}:
        hits = []
        for asked in {frozenset(t.split()) for i, t in queries if i == q}:
            for i in has.keys() - {None}:
                best = [min((distance(a, w) for w in has[i] if near(a, w)), default=None) for a in asked]
                if None not in best:
                    hits.append((sum(best), i))
        want |= {(q, n, i, t) for n, (t, i) in enumerate(sorted(hits)[:4], 1)}
    assert {tuple(r) for r in got} == want


def test_pairs_of_one_key_are_dealt_over_tasks(spark):
    held = spark.createDataFrame([(i, "patil") for i in range(90)] + [(100, "more"), (None, "patil")], "record_id long, name string")
    asked = spark.createDataFrame([(i, "Pateel") for i in range(45)] + [(60, "zzz")], "query_id long, query string")
    got = variants.spelling_search(asked, variants.with_variants(held, "name"), cell=10).select("*", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.query_id, -1 if r.record_id is None else r.record_id) for r in got) == sorted((q, r) for q in range(45) for r in [-1, *range(90)])
    tasks = [r.task for r in got]
    assert max(map(tasks.count, set(tasks))) < len(tasks) / 4
