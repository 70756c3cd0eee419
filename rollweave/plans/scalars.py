"""Text, identifier and similarity expressions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollweave.functions import text
from rollweave.operators import search
from rollweave.operators.lines import decode_bold, has_bold
from rollweave.plans import Catalog, table
from rollweave.sources.writers import enrich_names
from rollweave.plans.standins import GLYPH_NAMES, glyph_name

# A messy name: mixed case, doubled blanks, a tab, letters that case-fold specially.
MESSY = "concat('  ', c_name, '   ', c_mktsegment, chr(9), CASE WHEN c_custkey % 5 = 0 THEN 'Straße µ' ELSE 'É  ' END)"
MESSY_OR_NOT = f"CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN '' ELSE {MESSY} END"
SALT = "pepper"

_DUCK_FOLD = "replace(replace(lower({0}), 'ß', 'ss'), 'µ', 'μ')"
_DUCK_SQUEEZE = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def duck_normal(c: str) -> str:
    return "coalesce(" + _DUCK_SQUEEZE.format(_DUCK_FOLD.format(c)) + ", '')"


def duck_trigrams(c: str) -> str:
    """Distinct 3-grams in SQL, word by word, as the definition reads."""
    words = f"list_filter(string_split_regex(lower({c}), '[^\\pL\\pM\\pN]+'), lambda w: w <> '')"
    return (
        f"list_distinct(flatten(list_transform({words}, lambda w: list_transform("
        "range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
    )


def duck_soundex(c: str) -> str:
    """The four-character code in SQL: letters to digits, H and W skipped, runs to one, vowels dropped."""
    digits = f"translate(regexp_replace(upper({c}), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    runs = f"substring({digits}, 1, 1) || replace(substring({digits}, 2), '7', '')"
    for digit in "0123456":
        runs = f"regexp_replace({runs}, '{digit}+', '{digit}', 'g')"
    code = f"upper(substring({c}, 1, 1)) || rpad(substring(replace(substring({runs}, 2), '0', ''), 1, 3), 3, '0')"
    return f"CASE WHEN regexp_matches({c}, '^[A-Za-z]') THEN {code} ELSE {c} END"


def duck_similarity(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {common})"
    return f"CAST(CASE WHEN {union} > 0 THEN {common} * 1.0 / {union} ELSE 0 END AS FLOAT)"


def _duck_id(prefix: str, *parts: str) -> str:
    joined = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), 'None')" for p in parts)
    return f"'{prefix}_' || substring(sha256({joined}), 1, 24)"


PATH = "regexp_replace(url, '^https?://', '')"


def register(catalog: Catalog) -> None:
    @catalog.add("normalize_name", f"SELECT c_custkey, {duck_normal(MESSY_OR_NOT)} AS name FROM customer")
    def normalize_name(spark, folder):
        return table(spark, folder, "customer").selectExpr("c_custkey", f"{MESSY_OR_NOT} AS raw").select(
            "c_custkey", text.normalize_name(F.col("raw")).alias("name")
        )

    @catalog.add("stable_ids", f"""
        SELECT o_orderkey, {_duck_id('roll', 'o_orderstatus', 'year(o_orderdate)', 'o_orderpriority', "'mr'", 'o_custkey % 288', 'o_orderkey % 300')} AS roll_version_id,
               {_duck_id('srcdoc', 'o_orderstatus', 'o_orderkey')} AS source_document_id,
               {_duck_id('ac', 'o_orderstatus', 'o_custkey % 288')} AS ac_id,
               {_duck_id('ps', 'o_orderstatus', 'o_custkey % 288', 'o_orderkey % 300')} AS polling_station_id,
               {_duck_id('voter', "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END", 'o_orderkey')} AS voter_record_id
        FROM orders""")
    def stable_ids(spark, folder):
        c = F.col
        df = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate")).withColumns(
            {"ac": c("o_custkey") % 288, "part": c("o_orderkey") % 300}
        )
        maybe = F.when(c("o_orderkey") % 7 != 0, c("o_custkey"))
        return df.select(
            "o_orderkey",
            text.stable_id("roll", c("o_orderstatus"), c("year"), c("o_orderpriority"), F.lit("mr"), c("ac"), c("part")).alias("roll_version_id"),
            text.stable_id("srcdoc", c("o_orderstatus"), c("o_orderkey")).alias("source_document_id"),
            text.stable_id("ac", c("o_orderstatus"), c("ac")).alias("ac_id"),
            text.stable_id("ps", c("o_orderstatus"), c("ac"), c("part")).alias("polling_station_id"),
            text.stable_id("voter", maybe, c("o_orderkey")).alias("voter_record_id"),
        )

    raw_id = "CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN NULL ELSE concat(' mt/07/', lpad(concat('', o_custkey % 1000), 3, '0'), '/ ', lpad(concat('', o_orderkey), 7, '0'), ' ') END"
    clean = "regexp_replace(upper(raw), '\\s+', '', 'g')"

    @catalog.add("fingerprint", f"""
        SELECT o_orderkey, CASE WHEN raw <> '' THEN sha256('{SALT}:' || {clean}) END AS epic_hash,
               CASE WHEN raw <> '' THEN right({clean}, 4) END AS epic_last4
        FROM (SELECT o_orderkey, {raw_id} AS raw FROM orders)""")
    def fingerprint(spark, folder):
        df = table(spark, folder, "orders").selectExpr("o_orderkey", f"{raw_id} AS raw")
        return df.withColumn("f", text.fingerprint(F.col("raw"), F.lit(SALT))).select(
            "o_orderkey", F.col("f.hash").alias("epic_hash"), F.col("f.last4").alias("epic_last4")
        )

    query = "CASE WHEN event_id % 6 = 0 THEN concat(' ', substr(event_type, 1, 1), '  ') ELSE concat('  ', upper(event_type), '  ', user_id, ' ß ') END"
    norm = duck_normal("q")
    squeezed = _DUCK_SQUEEZE.format("q")

    @catalog.add("query_summary", f"""
        SELECT event_id,
          CASE WHEN length({norm}) <= 2 THEN 'short-query' ELSE 'len:' || length({norm}) || ' prefix:' || substring({norm}, 1, 2) END AS search_summary,
          CASE WHEN length({squeezed}) <= 2 THEN 'short-query' ELSE 'len:' || length({squeezed}) || ' prefix:' || {_DUCK_FOLD.format(f"substring({squeezed}, 1, 2)")} END AS log_summary
        FROM (SELECT event_id, {query} AS q FROM events)""")
    def query_summary(spark, folder):
        df = table(spark, folder, "events").selectExpr("event_id", f"{query} AS q")
        return df.select("event_id", text.query_summary(F.col("q")).alias("search_summary"),
                         text.log_summary(F.col("q")).alias("log_summary"))

    client = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN '' ELSE concat(' Client  ', user_id, ' ') END"
    identity = f"coalesce(nullif(CASE WHEN raw = '' THEN NULL ELSE {_DUCK_SQUEEZE.format('raw')} END, NULL), 'unknown-client')"

    @catalog.add("client_keys", f"""
        SELECT event_id, 'search:client:' || substring(sha256({_DUCK_FOLD.format(identity)}), 1, 16) || ':state:' || event_type || ':ac:' || (user_id % 288) AS client_key
        FROM (SELECT event_id, event_type, user_id, {client} AS raw FROM events)""")
    def client_keys(spark, folder):
        df = table(spark, folder, "events").selectExpr("*", f"{client} AS raw")
        return df.select("event_id", text.client_key(F.col("raw"), F.col("event_type"), F.col("user_id") % 288).alias("client_key"))

    a, b = duck_trigrams("p_name"), duck_trigrams("concat(p_type, '-', p_name, ' ', p_brand)")

    @catalog.add("trigram_similarity", f"SELECT p_partkey, round(CAST({duck_similarity('a', 'b')} AS DOUBLE), 4) AS score, len(b) AS grams FROM (SELECT p_partkey, {a} AS a, {b} AS b FROM part)")
    def trigram_similarity(spark, folder):
        df = table(spark, folder, "part").select(
            "p_partkey", text.trigrams(F.col("p_name")).alias("a"),
            text.trigrams(F.concat("p_type", F.lit("-"), "p_name", F.lit(" "), "p_brand")).alias("b"),
        )
        return df.select("p_partkey", F.round(text.gram_similarity(F.col("a"), F.col("b")).cast("double"), 4).alias("score"),
                         F.size("b").alias("grams"))

    @catalog.add("document_trigrams", f"SELECT doc_id, len({duck_trigrams('text')}) AS grams FROM documents")
    def document_trigrams(spark, folder):
        return table(spark, folder, "documents").select("doc_id", F.size(text.trigrams(F.col("text"))).alias("grams"))

    @catalog.add("content_checksum", """
        SELECT doc_id, 'sha256:' || sha256(text) AS checksum,
               regexp_matches('sha256:' || sha256(text), '^sha256:[0-9a-f]{64}$') AS well_formed FROM documents""")
    def content_checksum(spark, folder):
        df = table(spark, folder, "documents").select("doc_id", text.text_checksum(F.col("text")).alias("checksum"))
        return df.withColumn("well_formed", text.is_checksum(F.col("checksum")))

    bold = "CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE concat(c_custkey % 90, ' ', repeat(substr(c_mktsegment, 1, 1), 4), repeat(substr(c_mktsegment, 2, 1), CAST(c_custkey % 9 AS INT)), repeat(substr(c_mktsegment, 3, 1), 5), c_name) END"

    @catalog.add("bold_decode", f"""
        WITH t AS (SELECT c_custkey, {bold} AS s FROM customer),
        c AS (SELECT c_custkey, generate_subscripts(a, 1) AS i, unnest(a) AS ch FROM (SELECT c_custkey, regexp_extract_all(s, '.') AS a FROM t)),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY c_custkey, ch ORDER BY i) AS run FROM c),
        r AS (SELECT c_custkey, ch, min(i) AS pos, count(*) AS n FROM g GROUP BY c_custkey, ch, run)
        SELECT c_custkey, string_agg(repeat(ch, CAST(n // 4 + n % 4 AS INT)), '' ORDER BY pos) AS decoded, max(n) >= 4 AS bold
        FROM r GROUP BY c_custkey""")
    def bold_decode(spark, folder):
        df = table(spark, folder, "customer").selectExpr("c_custkey", f"{bold} AS s")
        return df.select("c_custkey", decode_bold(F.col("s")).alias("decoded"), has_bold(F.col("s")).alias("bold"))

    dev_sql = " ".join(f"WHEN {i} THEN '{n[1]}'" for i, n in enumerate(GLYPH_NAMES))
    latin_sql = " ".join(f"WHEN {i} THEN '{n[2]}'" for i, n in enumerate(GLYPH_NAMES))
    n = len(GLYPH_NAMES)
    two = lambda s: f"concat(CASE o_custkey % {n} {s} END, ' ', o_orderkey % 97, ' ', CASE o_orderkey % {n} {s} END)"

    @catalog.add("name_enrich", f"SELECT o_orderkey, {two(dev_sql)} AS voter_name_dev, {two(latin_sql)} AS voter_name_en FROM orders")
    def name_enrich(spark, folder):
        name = f"concat({glyph_name('o_custkey')}, ' ', o_orderkey % 97, ' ', {glyph_name('o_orderkey')})"
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
        df = orders.selectExpr("o_orderkey", f"{name} AS voter_name")
        return enrich_names(df, ("voter_name",)).drop("voter_name")

    @catalog.add("redact", """
        SELECT concat('ST-', c_nationkey) AS state_id, CAST(c_nationkey AS INT) AS ac_number, CAST(c_custkey % 40 AS INT) AS part_number,
               CAST(c_custkey AS INT) AS serial_number, c_name AS display_name, 2002 AS roll_year, 'base_roll' AS roll_kind,
               'ok' AS data_quality, c_mktsegment AS source_label, c_acctbal AS confidence,
               CASE WHEN c_custkey % 5 > 1 THEN '***' || right(c_name, 4) END AS epic_hint FROM customer""")
    def redact(spark, folder):
        return search.redact(search_records(spark, folder))


def search_records(spark, folder):
    """Customers as search records."""
    return table(spark, folder, "customer").selectExpr(
        "concat('ST-', c_nationkey) AS state_id", "c_nationkey AS ac_number",
        "CAST(c_custkey % 40 AS INT) AS part_number", "CAST(c_custkey AS INT) AS serial_number",
        "c_name AS name", "2002 AS roll_year", "'base_roll' AS roll_kind", "'ok' AS data_quality",
        "c_mktsegment AS source_label", "c_acctbal AS confidence",
        "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE right(c_name, 4) END AS epic_last4",
    )
