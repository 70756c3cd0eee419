"""Typo-tolerant, spelling and phonetic search over the test tables: customers as records, suppliers as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rollweave.operators import typos, variants
from rollweave.plans import Catalog, table
from rollweave.plans.matching import _NAME, _RELATIVE

_RECORDS = f"SELECT k AS record_id, {_NAME} AS name, {_RELATIVE} AS relative, concat('mt', lpad(concat('', k), 7, '0')) AS ident FROM (SELECT c_custkey AS k FROM customer)"
# A letter lost, doubled, replaced, two swapped; names alone or with a relative's or an identifier.
_TYPED = (
    f"CASE k % 8 WHEN 0 THEN {_NAME} WHEN 1 THEN concat(substr({_NAME}, 1, 3), substr({_NAME}, 5)) WHEN 2 THEN concat(substr({_NAME}, 2, 1), substr({_NAME}, 1, 1), substr({_NAME}, 3)) "
    f"WHEN 3 THEN concat({_NAME}, 'x ', {_RELATIVE}) WHEN 4 THEN concat('mt', lpad(concat('', k * 7 + 3), 7, '0'), ' ', substr({_NAME}, 1, 4)) WHEN 5 THEN concat('mt', lpad(concat('', k), 6, '0')) "
    f"WHEN 6 THEN concat(' Z', substr({_NAME}, 2), '  ') ELSE 'no such person' END")
_QUERIES = f"SELECT k AS query_id, {_TYPED} AS query FROM (SELECT s_suppkey AS k FROM supplier)"
# Other spellings of a name.
_RESPELLED = f"replace(replace(replace({_NAME}, 'sh', 's'), 'v', 'w'), 'ee', 'i')"
_SPELLED = f"CASE k % 3 WHEN 0 THEN upper({_RESPELLED}) WHEN 1 THEN replace(replace({_NAME}, 'a', 'aa'), 't', 'tt') ELSE replace({_NAME}, 'i', 'ee') END"
# A word of another sound, and words in another order.
_SOUNDED = f"CASE k % 4 WHEN 0 THEN replace({_NAME}, 'd', 't') WHEN 1 THEN replace({_NAME}, 'k', 'kh') WHEN 2 THEN concat('patil ', replace({_NAME}, 'g', 'k')) ELSE {_NAME} END"


def _rows(spark, folder, source: str, key: str, *columns: str):
    return table(spark, folder, source).selectExpr(f"{key} AS k").selectExpr(*columns)


def _records(spark, folder):
    return _rows(spark, folder, "customer", "c_custkey", "k AS record_id", f"{_NAME} AS name", f"{_RELATIVE} AS relative", "concat('mt', lpad(concat('', k), 7, '0')) AS ident")


def _chain(text: str, steps) -> str:
    return reduce(lambda t, one: f"regexp_replace({t}, '{one[0]}', '{one[1]}', 'g')", steps, text)


def _normal(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), ' +', ' ', 'g'))"


def _codes(word: str) -> tuple[str, str]:
    text = f"regexp_replace(replace(replace(regexp_replace({word}, '[^a-z]', '', 'g'), 'ce', 'se'), 'ci', 'si'), '^wh', 'v')"
    close, runs = _chain(text, variants.SOUNDS), [(f"{x}+", x) for x in "ABCDFGJKLMNPRSTV"]
    loose = f"translate({close}, '{variants.LOOSE[0]}', '{variants.LOOSE[1]}')"
    return tuple(f"substring({_chain(c, runs)}, 1, {variants.CODE_LENGTH})" for c in (close, loose))


def register(catalog: Catalog) -> None:
    @catalog.add("typo_search", f"""
        WITH q AS (SELECT query_id, list_filter(list_distinct(string_split({_normal('query')}, ' ')), lambda w: w <> '') AS words FROM ({_QUERIES})),
        r AS (SELECT record_id, list_distinct(string_split(concat(name, ' ', relative, ' ', ident), ' ')) AS words FROM ({_RECORDS})),
        v AS (SELECT DISTINCT unnest(words) AS near FROM r), a AS (SELECT DISTINCT unnest(words) AS word FROM q),
        near AS (SELECT word, near, damerau_levenshtein(word, near) AS typos FROM a, v
            WHERE damerau_levenshtein(word, near) <= CASE WHEN length(word) >= 6 THEN 2 WHEN length(word) >= 3 THEN 1 ELSE 0 END),
        qw AS (SELECT query_id, len(words) AS n, unnest(words) AS word FROM q), rw AS (SELECT record_id, unnest(words) AS near FROM r),
        met AS (SELECT query_id, n, record_id, word, min(typos) AS typos FROM qw JOIN near USING (word) JOIN rw USING (near) GROUP BY ALL),
        whole AS (SELECT query_id, record_id, CAST(sum(typos) AS INT) AS typos FROM met GROUP BY query_id, n, record_id HAVING count(*) = n)
        SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY typos, record_id) AS rank, record_id, typos FROM whole) WHERE rank <= 20""")
    def typo_search(spark, folder):
        held = typos.index(_records(spark, folder), "record_id", ["name", "relative", "ident"])
        return typos.typo_search(_rows(spark, folder, "supplier", "s_suppkey", "k AS query_id", f"{_TYPED} AS query"), held)

    key = _chain(_normal("{}"), variants.CLASSES)

    @catalog.add("spelling_search", f"""
        WITH q AS (SELECT k AS query_id, {key.format('query')} AS key FROM (SELECT k, {_SPELLED} AS query FROM (SELECT s_suppkey AS k FROM supplier))),
        r AS (SELECT record_id, {key.format('name')} AS key FROM ({_RECORDS}))
        SELECT query_id, record_id FROM q JOIN r USING (key)""")
    def spelling_search(spark, folder):
        held = variants.with_variants(_records(spark, folder), "name")
        return variants.spelling_search(_rows(spark, folder, "supplier", "s_suppkey", "k AS query_id", f"{_SPELLED} AS query"), held)

    @catalog.add("name_variants", f"""
        WITH w AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS word FROM ({_RECORDS})), b AS (SELECT word, {_chain('word', variants.CLASSES)} AS key FROM w)
        SELECT word, key, {_codes('word')[0]} AS close, {_codes('word')[1]} AS loose, CAST(power(2, least(6, length(regexp_replace(key, '[^aiuvsfj]', '', 'g')))) AS BIGINT)
            + CASE WHEN regexp_matches(word, '([bcdghklmnpqrtxy])') AND regexp_matches(word, '(bb|cc|dd|gg|hh|kk|ll|mm|nn|pp|qq|rr|tt|xx|yy)') THEN 1 ELSE 0 END AS n_spellings FROM b""")
    def name_variants(spark, folder):
        word = _records(spark, folder).select(F.explode(F.split("name", " ")).alias("word")).distinct()
        return word.select("word", variants.spelling_key(F.col("word")).alias("key"), variants.phonetic_codes(F.col("word")).alias("_c"),
                           F.size(variants.spellings(F.col("word"))).cast("bigint").alias("n_spellings")).select("word", "key", "_c.close", "_c.loose", "n_spellings")

    close, loose = _codes("word")

    @catalog.add("phonetic_search", f"""
        WITH q AS (SELECT k AS query_id, {_normal(_SOUNDED)} AS query FROM (SELECT s_suppkey AS k FROM supplier)), r AS (SELECT record_id, name FROM ({_RECORDS})),
        qw AS (SELECT query, len(words) AS n, unnest(words) AS word FROM (SELECT DISTINCT query, list_distinct(string_split(query, ' ')) AS words FROM q)),
        rw AS (SELECT name, unnest(list_distinct(string_split(name, ' '))) AS word FROM (SELECT DISTINCT name FROM r)),
        qc AS (SELECT query, n, word, {close} AS close, {loose} AS loose FROM qw), rc AS (SELECT name, {close} AS close, {loose} AS loose FROM rw),
        met AS (SELECT query, n, name, qc.word, max(CASE WHEN qc.close = rc.close THEN 1.0 ELSE 0.5 END) AS s FROM qc JOIN rc ON qc.loose = rc.loose GROUP BY ALL),
        scored AS (SELECT query, name, round(sum(s) / n, 4) AS score FROM met GROUP BY query, n, name HAVING count(*) = n),
        placed AS (SELECT query, record_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, record_id) AS rank FROM scored JOIN r USING (name))
        SELECT query_id, rank, record_id, CAST(score AS DOUBLE) AS score FROM q JOIN placed USING (query) WHERE rank <= 20""")
    def phonetic_search(spark, folder):
        return variants.phonetic_search(_rows(spark, folder, "supplier", "s_suppkey", "k AS query_id", f"{_SOUNDED} AS query"), _records(spark, folder))
