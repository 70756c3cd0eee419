"""Scored person matching and linkage over the test tables: customers as the old roll, those with orders as the new one."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollweave.operators import matching
from rollweave.operators.matching import Equal, Moving, Similar
from rollweave.plans import Catalog, table
from rollweave.plans.scalars import duck_similarity, duck_trigrams

GIVEN = ("sanjay", "sunita", "ramesh", "rajesh", "anita", "mangesh", "vishal", "kavita", "prakash", "deepa", "ganesh", "lata", "suresh")
FAMILY = ("patil", "shinde", "jadhav", "pawar", "kulkarni", "deshmukh", "more", "gaikwad", "joshi", "kadam", "chavan")


def _pick(words: tuple[str, ...], key: str) -> str:
    return "CASE " + f"({key}) % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


_NAME = f"concat({_pick(GIVEN, 'k')}, ' ', {_pick(FAMILY, 'floor(k / 5)')})"
_RELATIVE = f"concat({_pick(GIVEN, 'floor(k / 3) + 4')}, ' ', {_pick(FAMILY, 'floor(k / 5)')})"
_OLD = ("k AS record_id", "scope", f"{_NAME} AS name", f"{_RELATIVE} AS relative", "CAST(k % 2 AS INT) AS gender", "CAST(20 + k % 40 AS INT) AS age", "CAST(k % 60 AS INT) AS house")
# Twenty years on: letters lost, other relatives, moved houses and scopes, ages off by more than a year.
_NEW = (
    "k + 1000000 AS record_id", "CAST(CASE WHEN k % 19 = 0 THEN scope + 1 ELSE scope END AS INT) AS scope",
    f"CASE WHEN k % 5 = 0 THEN concat(substr({_NAME}, 1, 2), substr({_NAME}, 4)) WHEN k % 17 = 0 THEN concat({_NAME}, ' rao') ELSE {_NAME} END AS name",
    f"CASE WHEN k % 7 = 0 THEN concat('smt ', {_NAME}) WHEN k % 13 = 0 THEN NULL ELSE {_RELATIVE} END AS relative", "CAST(k % 2 AS INT) AS gender",
    "CAST(40 + k % 40 + CASE WHEN k % 11 = 0 THEN 7 WHEN k % 3 = 0 THEN 1 ELSE 0 END AS INT) AS age", "CAST(CASE WHEN k % 6 = 0 THEN 61 ELSE k % 60 END AS INT) AS house")

FIELDS = (Similar("name"), Similar("relative"), Equal("gender"), Moving("age"), Equal("house"))
PASSES = (("scope", "name"), ("scope", "relative", "gender"), ("scope", "gender", "born"))
WEIGHTS = {"name": (-400, 20, 250, 550), "relative": (-250, 50, 200, 450), "gender": (-500, 90), "age": (-300, 180), "house": (-150, 300)}
THRESHOLD, YEARS = 500, 20
_CUSTOMERS = "SELECT c_custkey AS k, CAST(c_nationkey AS INT) AS scope FROM customer"
_ORDERING = "SELECT c_custkey AS k, CAST(c_nationkey AS INT) AS scope FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"


def old_roll(spark, folder):
    rows = table(spark, folder, "customer").selectExpr("c_custkey AS k", "CAST(c_nationkey AS INT) AS scope").selectExpr(*_OLD)
    return rows.withColumn("born", F.expr("array(2001 - age, 2002 - age, 2003 - age)"))


def new_roll(spark, folder):
    asked = table(spark, folder, "orders").select("o_custkey").distinct()
    rows = table(spark, folder, "customer").join(asked, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return rows.selectExpr("c_custkey AS k", "CAST(c_nationkey AS INT) AS scope").selectExpr(*_NEW).withColumn("born", F.expr("2022 - age"))


def _level_sql(a: str, b: str, years: int) -> str:
    """The levels of a pair of aliases in SQL."""
    def similar(field: str) -> str:
        s = f"CAST({duck_similarity(duck_trigrams(f'{a}.{field}'), duck_trigrams(f'{b}.{field}'))} AS DOUBLE)"
        return (f"CASE WHEN {a}.{field} IS NULL OR {b}.{field} IS NULL THEN NULL WHEN {s} >= 1.0 THEN 3 WHEN {s} >= 0.7 THEN 2 "
                f"WHEN {s} >= 0.4 THEN 1 ELSE 0 END AS {field}_level")

    return ", ".join((
        similar("name"), similar("relative"), f"CASE WHEN {a}.gender = {b}.gender THEN 1 ELSE 0 END AS gender_level",
        f"CASE WHEN abs({b}.age - {a}.age - {years}) <= 1 THEN 1 ELSE 0 END AS age_level", f"CASE WHEN {a}.house = {b}.house THEN 1 ELSE 0 END AS house_level"))


def _blocked(a: str, b: str, years: int, reach: int = 1) -> str:
    return (f"{a}.scope = {b}.scope AND ({a}.name = {b}.name OR ({a}.relative = {b}.relative AND {a}.gender = {b}.gender) "
            f"OR ({a}.gender = {b}.gender AND abs({b}.age - {a}.age - {years}) <= {reach}))")


def _total() -> str:
    def one(field: str) -> str:
        return f"CASE {field}_level " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS[field])) + " ELSE 0 END"

    return " + ".join(one(f) for f in WEIGHTS)


_LEVELS = f"""o AS (SELECT {", ".join(_OLD)} FROM ({_CUSTOMERS})), n AS (SELECT {", ".join(_NEW)} FROM ({_ORDERING})),
        levels AS (SELECT o.record_id AS old, n.record_id AS new, {_level_sql('o', 'n', YEARS)} FROM o JOIN n ON {_blocked('o', 'n', YEARS)})"""
# Pairs one after the other, in order of weight; each record is taken once.
_GREEDY = f"""{_LEVELS},
        edges AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight DESC, md5(old || '|' || new)) AS rn FROM (SELECT old, new, {_total()} AS weight FROM levels) WHERE weight >= {THRESHOLD}),
        taken(i, olds, news) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL
            SELECT i + 1, CASE WHEN list_contains(olds, old) OR list_contains(news, new) THEN olds ELSE list_append(olds, old) END,
                CASE WHEN list_contains(olds, old) OR list_contains(news, new) THEN news ELSE list_append(news, new) END FROM taken JOIN edges ON rn = i + 1),
        pairs AS (SELECT unnest(olds) AS old_id, unnest(news) AS new_id FROM (SELECT * FROM taken ORDER BY i DESC LIMIT 1)),
        matched AS (SELECT old_id, new_id, weight FROM pairs JOIN edges ON old_id = old AND new_id = new)"""


def register(catalog: Catalog) -> None:
    level_columns = ", ".join(f"{c.field}_level" for c in FIELDS)

    @catalog.add("match_patterns", f"WITH {_LEVELS} SELECT {level_columns}, count(*) AS pairs FROM levels GROUP BY {level_columns}")
    def match_patterns(spark, folder):
        keys = ["scope", "name", "relative", "gender", "born"]
        old, new = (matching.profiles(roll(spark, folder), "record_id", FIELDS, keys) for roll in (old_roll, new_roll))
        return matching.pattern_counts(old, new, PASSES, FIELDS, YEARS)

    @catalog.add("person_match", f"WITH RECURSIVE {_GREEDY} SELECT * FROM matched")
    def person_match(spark, folder):
        return matching.match_rolls(old_roll(spark, folder), new_roll(spark, folder), "record_id", FIELDS, PASSES, YEARS, WEIGHTS, THRESHOLD)

    @catalog.add("person_match_compare", f"""WITH RECURSIVE {_GREEDY},
        j AS (SELECT o.record_id AS old_id, n.record_id AS new_id, array_to_string(list_filter([
            CASE WHEN o.name IS DISTINCT FROM n.name THEN 'name' END, CASE WHEN o.relative IS DISTINCT FROM n.relative THEN 'relative' END,
            CASE WHEN o.house IS DISTINCT FROM n.house THEN 'house' END, CASE WHEN abs(n.age - o.age - {YEARS}) > 1 THEN 'age' END], lambda x: x IS NOT NULL), ',') AS differences
          FROM o JOIN matched ON o.record_id = old_id JOIN n ON n.record_id = new_id)
        SELECT old_id, new_id, differences, CASE WHEN differences = '' THEN 'unchanged' ELSE 'under_review' END AS status FROM j
        UNION ALL SELECT record_id, NULL, '', 'deleted' FROM o WHERE record_id NOT IN (SELECT old_id FROM matched)
        UNION ALL SELECT NULL, record_id, '', 'added' FROM n WHERE record_id NOT IN (SELECT new_id FROM matched)""")
    def person_match_compare(spark, folder):
        old, new = old_roll(spark, folder), new_roll(spark, folder)
        matched = matching.match_rolls(old, new, "record_id", FIELDS, PASSES, YEARS, WEIGHTS, THRESHOLD)
        told = matching.compare_matched(old, new, "record_id", matched, ["name", "relative", "house"], YEARS)
        return told.select("person.old_id", "person.new_id", F.array_join("differences", ",").alias("differences"), "status")

    # Weights learned from the pairs themselves: beyond SQL; tests hold the learning against a plain version.
    @catalog.add("person_match_learned")
    def person_match_learned(spark, folder):
        return matching.match_rolls(old_roll(spark, folder), new_roll(spark, folder), "record_id", FIELDS, PASSES, YEARS)

    one_roll = f"""r AS (SELECT {", ".join(_OLD)} FROM ({_CUSTOMERS}) UNION ALL
        SELECT record_id, scope, name, relative, gender, age - {YEARS}, house FROM (SELECT {", ".join(_NEW)} FROM ({_ORDERING})))"""

    @catalog.add("similar_linkage", f"""WITH RECURSIVE {one_roll},
        levels AS (SELECT a.record_id AS a, b.record_id AS b, {_level_sql('a', 'b', 0)} FROM r a JOIN r b ON a.record_id < b.record_id AND {_blocked('a', 'b', 0, 2)}),
        edges AS MATERIALIZED (SELECT a, b FROM levels WHERE {_total()} >= {THRESHOLD} UNION ALL SELECT b, a FROM levels WHERE {_total()} >= {THRESHOLD}),
        reach(id, other) AS (SELECT a, b FROM edges UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.other = edges.a)
        SELECT record_id, least(record_id, coalesce(min(other), record_id)) AS canonical_id FROM r LEFT JOIN reach ON id = record_id GROUP BY record_id""")
    def similar_linkage(spark, folder):
        near = F.expr("array(2001 - age, 2002 - age, 2003 - age)")
        columns = ["record_id", "scope", "name", "relative", "gender", "age", "house"]
        later = new_roll(spark, folder).withColumn("age", F.col("age") - YEARS).select(*columns)
        both = old_roll(spark, folder).select(*columns).unionByName(later).withColumn("born", near)
        return matching.link_by_score(both, "record_id", FIELDS, PASSES, WEIGHTS, THRESHOLD)
