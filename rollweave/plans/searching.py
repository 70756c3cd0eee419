"""Name search over part names and text scans over documents and page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollweave.operators import scan, search
from rollweave.plans import Catalog, table
from rollweave.plans.scalars import duck_similarity, duck_trigrams, search_records

# Longer, more varied names than the part table has alone.
NAME = "concat(p_name, ' ', lower(p_type), ' ', p_size)"
AC_NUMBER = "CAST(substr(p_brand, 7) AS INT)"
SCAN_TERMS = ("example corp",)
SCAN_PATTERNS = scan.patterns_with_names(SCAN_TERMS)


def voter_tables(spark, folder):
    """Parts as voter records, brands as constituencies, sizes as parts of them."""
    parts = table(spark, folder, "part")
    voters = parts.selectExpr(
        "p_partkey AS voter_record_id", "'IN-TS' AS state_id", "p_brand AS ac_id", "CASE WHEN p_size < 40 THEN p_size END AS polling_station_id",
        "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(p_partkey AS INT) END AS serial_number",
        f"{NAME} AS name_original", f"lower({NAME}) AS name_normalized", "p_size AS age", "'F' AS gender",
        "'father' AS relation_type", "'ok' AS data_quality", "right(p_type, 4) AS epic_last4",
    )
    acs = parts.selectExpr("p_brand AS ac_id", f"{AC_NUMBER} AS ac_number").distinct()
    stations = parts.selectExpr("p_size AS polling_station_id", "p_size + 1000 AS part_number").distinct()
    return voters, acs, stations


QUERY_TEXT = "concat(substr(p_name, 1, 3), substr(p_name, 5), ' ', upper(p_type))"


def _duck_line(pattern: str, blind: bool) -> str:
    return "'" + ("(?i)" if blind else "") + pattern.replace("'", "''") + "'"


def register(catalog: Catalog) -> None:
    g, q = duck_trigrams(f"lower({NAME})"), duck_trigrams("'red widgt econ'")

    @catalog.add("fuzzy_search", f"""
        WITH s AS (SELECT p_partkey, {NAME} AS name, p_size AS age, 'F' AS gender, 'father' AS relation_type, {AC_NUMBER} AS ac_number,
              CASE WHEN p_size < 40 THEN p_size + 1000 END AS part_number, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(p_partkey AS INT) END AS serial_number,
              {g} AS g, {q} AS q FROM part WHERE p_brand = 'Brand#17'),
        r AS (SELECT *, {duck_similarity('g', 'q')} AS score FROM s)
        SELECT name, age, gender, relation_type, ac_number, part_number, serial_number, round(CAST(score AS DOUBLE), 4) AS score, 'ok' AS data_quality
        FROM r WHERE CAST(score AS DOUBLE) >= 0.2 ORDER BY r.score DESC, serial_number ASC NULLS LAST, p_partkey LIMIT 10""")
    def fuzzy_search(spark, folder):
        return search.fuzzy_search(*voter_tables(spark, folder), "IN-TS", 17, "  Red  WIDGT econ ")

    a, b = duck_trigrams("query"), duck_trigrams("name")

    @catalog.add("fuzzy_search_batch", f"""
        WITH q AS (SELECT DISTINCT o_custkey AS query_id, p_brand, trim(lower({QUERY_TEXT})) AS query FROM orders JOIN part ON p_partkey = o_custkey),
        qg AS (SELECT *, {a} AS a FROM (SELECT DISTINCT p_brand, query FROM q)),
        ng AS (SELECT *, {b} AS b FROM (SELECT DISTINCT p_brand, lower({NAME}) AS name FROM part)),
        m AS (SELECT qg.p_brand, query, name, {duck_similarity('a', 'b')} AS score FROM qg JOIN ng ON qg.p_brand = ng.p_brand),
        v AS (SELECT p_brand, lower({NAME}) AS name, p_partkey AS voter_record_id, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(p_partkey AS INT) END AS serial_number FROM part),
        r AS (SELECT q.query_id, q.p_brand, q.query, voter_record_id, serial_number, m.name, score,
                row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, serial_number ASC NULLS LAST, voter_record_id) AS rank
              FROM q JOIN m ON q.p_brand = m.p_brand AND q.query = m.query JOIN v ON m.p_brand = v.p_brand AND m.name = v.name WHERE CAST(score AS DOUBLE) >= 0.4)
        SELECT query_id, p_brand AS ac_id, query, rank, voter_record_id, serial_number, name, round(CAST(score AS DOUBLE), 4) AS score FROM r WHERE rank <= 10""")
    def fuzzy_search_batch(spark, folder):
        voters, _, _ = voter_tables(spark, folder)
        asked = table(spark, folder, "orders").select("o_custkey").distinct()
        queries = asked.join(table(spark, folder, "part"), F.col("o_custkey") == F.col("p_partkey")).selectExpr(
            "o_custkey AS query_id", "p_brand AS ac_id", f"{QUERY_TEXT} AS query"
        )
        return search.fuzzy_search_batch(queries, voters, k=10, threshold=0.4, scope=("ac_id",))

    @catalog.add("substring_search", """
        SELECT 'ST-7' AS state_id, c_nationkey AS ac_number, CAST(c_custkey % 40 AS INT) AS part_number, CAST(c_custkey AS INT) AS serial_number, c_name AS display_name,
          2002 AS roll_year, 'base_roll' AS roll_kind, 'ok' AS data_quality, c_mktsegment AS source_label, c_acctbal AS confidence, CASE WHEN c_custkey % 5 > 1 THEN '***' || right(c_name, 4) END AS epic_hint
        FROM customer WHERE c_nationkey = 7 AND contains(lower(c_name), 'mer#00000') ORDER BY c_acctbal DESC, c_custkey LIMIT 12""")
    def substring_search(spark, folder):
        return search.substring_search(search_records(spark, folder), "ST-7", 7, "  MER#00000 ", limit=12)

    @catalog.add("anchored_scan", """
        WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
        lines AS (SELECT doc_id, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM cut)
        SELECT doc_id, line_no, 'opening' AS label, substring(line, 1, 160) AS excerpt FROM lines WHERE regexp_matches(line, '^The ')
        UNION ALL SELECT doc_id, line_no, 'closing', substring(line, 1, 160) FROM lines WHERE regexp_matches(line, 'on\\.$')""")
    def anchored_scan(spark, folder):
        texts = table(spark, folder, "documents").select("doc_id", "text")
        return scan.sensitive_scan(texts, "doc_id", patterns=(("opening", "^The ", False), ("closing", "on\\.$", False)))

    # -- scans --------------------------------------------------------------------------
    hit = ", ".join(f"CASE WHEN regexp_matches(line, {_duck_line(p, bl)}) THEN '{label}' END" for label, p, bl in SCAN_PATTERNS)
    found = f"""
        WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
        lines AS (SELECT doc_id, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM cut),
        hits AS (SELECT doc_id, line_no, line, unnest(list_filter([{hit}], lambda x: x IS NOT NULL)) AS label FROM lines)"""

    @catalog.add("sensitive_scan", found + " SELECT doc_id, line_no, label, substring(line, 1, 160) AS excerpt FROM hits")
    def sensitive_scan(spark, folder):
        return scan.sensitive_scan(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", patterns=SCAN_PATTERNS)

    @catalog.add("sensitive_summary", found + " SELECT label, count(*) AS findings FROM hits GROUP BY label")
    def sensitive_summary(spark, folder):
        return scan.scan_summary(scan.sensitive_scan(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", patterns=SCAN_PATTERNS))

    path = (
        "concat(CASE CAST(page_id AS INT) % 12 WHEN 0 THEN 'data/' WHEN 1 THEN 'samples/regions/' WHEN 2 THEN 'src/node_modules/' WHEN 3 THEN 'dist/' "
        "WHEN 4 THEN 'a/build/' WHEN 5 THEN '__pycache__/' WHEN 6 THEN 'samples/' ELSE 'docs/' END, url, "
        "CASE CAST(page_id AS INT) % 7 WHEN 0 THEN '.PEM' WHEN 1 THEN '/.env.local' WHEN 2 THEN '.JPEG' WHEN 3 THEN '/notes.md' ELSE '' END)"
    )
    # RE2 has no look-ahead: the first pattern's exception is spelled as a second test.
    tests = ["CASE WHEN regexp_matches(path, '^data/.+') AND path <> 'data/README.md' THEN '^data/(?!README\\.md$).+' END"]
    tests += [f"CASE WHEN regexp_matches(path, {_duck_line(p, bl)}) THEN '{p}' END" for p, bl in scan.BLOCKED_PATHS[1:]]

    @catalog.add("path_scan", f"SELECT * FROM (SELECT page_id, path, coalesce({', '.join(tests)}) AS pattern FROM (SELECT page_id, {path} AS path FROM pages)) WHERE pattern IS NOT NULL")
    def path_scan(spark, folder):
        pages = table(spark, folder, "pages").selectExpr("page_id", f"{path} AS path")
        return pages.withColumn("pattern", scan.blocked_path(F.col("path"))).where("pattern IS NOT NULL")

    @catalog.add("page_scan", f"""
        WITH cut AS (SELECT page_id, string_split(html, chr(10)) AS a FROM pages), lines AS (SELECT page_id, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM cut)
        SELECT page_id, line_no, unnest(list_filter([{hit}], lambda x: x IS NOT NULL)) AS label, substring(line, 1, 160) AS excerpt FROM lines""")
    def page_scan(spark, folder):
        return scan.sensitive_scan(table(spark, folder, "pages"), "page_id", "html", patterns=SCAN_PATTERNS)
