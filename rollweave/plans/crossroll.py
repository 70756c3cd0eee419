"""Lookups, comparisons and linkage across rolls, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollweave.functions.text import fingerprint
from rollweave.operators import crossroll, pairsearch
from rollweave.plans import Catalog, table
from rollweave.plans.loaded import CTES, loaded
from rollweave.plans.scalars import SALT, duck_similarity, duck_soundex, duck_trigrams
from rollweave.plans.searching import NAME

_ID = "concat('MT/07/', lpad(concat('', o_custkey % 1000), 3, '0'), '/', lpad(concat('', o_custkey), 7, '0'))"


def named_parts(spark, folder):
    return table(spark, folder, "part").selectExpr(
        "p_partkey AS voter_record_id", "p_brand AS ac_id", "CAST(p_partkey AS INT) AS serial_number",
        f"lower({NAME}) AS name_normalized", "lower(concat(p_type, ' ', p_name)) AS relative_name_normalized")


def register(catalog: Catalog) -> None:
    @catalog.add("id_lookup", f"""
        SELECT o_orderkey, {_ID} AS identifier FROM orders WHERE {_ID} = 'MT/07/077/0000077'""")
    def id_lookup(spark, folder):
        raw = table(spark, folder, "orders").selectExpr("o_orderkey", f"{_ID} AS identifier")
        hashed = raw.withColumn("epic_hash", fingerprint(F.col("identifier"), F.lit(SALT))["hash"])
        return crossroll.id_lookup(hashed, " mt/07/077/ 0000077", SALT).select("o_orderkey", "identifier")

    @catalog.add("id_lookup_batch", f"""
        WITH w AS (SELECT DISTINCT 'MT/07/' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS identifier FROM customer)
        SELECT o_orderkey, identifier FROM w JOIN orders ON identifier = {_ID}""")
    def id_lookup_batch(spark, folder):
        raw = table(spark, folder, "orders").selectExpr("o_orderkey", f"{_ID} AS own")
        hashed = raw.select("o_orderkey", fingerprint(F.col("own"), F.lit(SALT))["hash"].alias("epic_hash"))
        asked = table(spark, folder, "customer").selectExpr(
            "concat('MT/07/', lpad(concat('', c_custkey % 1000), 3, '0'), '/', lpad(concat('', c_custkey), 7, '0')) AS identifier")
        return crossroll.id_lookup_batch(hashed, asked, SALT).select("o_orderkey", "identifier")

    n, r = duck_trigrams(f"lower({NAME})"), duck_trigrams("lower(concat(p_type, ' ', p_name))")
    qn, qr = duck_trigrams("'old widget promo'"), duck_trigrams("'promo widget'")

    @catalog.add("name_relative_search", f"""
        WITH s AS (SELECT p_partkey, {n} AS n, {r} AS r, {qn} AS qn, {qr} AS qr FROM part),
        t AS (SELECT p_partkey, {duck_similarity('n', 'qn')} AS a, {duck_similarity('r', 'qr')} AS b FROM s)
        SELECT p_partkey AS voter_record_id, round(CAST(a AS DOUBLE), 4) AS name_score, round(CAST(b AS DOUBLE), 4) AS relative_score
        FROM t WHERE CAST(a AS DOUBLE) >= 0.3 AND CAST(b AS DOUBLE) >= 0.3 ORDER BY a + b DESC, p_partkey LIMIT 20""")
    def name_relative_search(spark, folder):
        got = crossroll.name_and_relative_search(named_parts(spark, folder), F.lit(True), "Old  widget PROMO", "promo widget")
        return got.select("voter_record_id", F.round(F.col("name_score").cast("double"), 4).alias("name_score"),
                          F.round(F.col("relative_score").cast("double"), 4).alias("relative_score"))

    pair_sql = ("SELECT s_suppkey AS query_id, concat('Brand#', s_suppkey % 25 + 1) AS ac_id, concat(CASE s_suppkey % 3 WHEN 0 THEN 'Red  widgt' WHEN 1 THEN 'old bolt' ELSE 'smal ring' END, ' ', s_suppkey % 50) AS name, "
                "concat(CASE s_suppkey % 4 WHEN 0 THEN 'promo ' WHEN 1 THEN 'standard ' WHEN 2 THEN '' ELSE 'econmy ' END, CASE s_suppkey % 3 WHEN 0 THEN 'widget' WHEN 1 THEN 'bolt' ELSE 'ring' END) AS relative FROM supplier")
    n_q, r_q = (duck_trigrams(f"trim(regexp_replace(lower(q.{c}), ' +', ' ', 'g'))") for c in ("name", "relative"))

    @catalog.add("name_relative_search_batch", f"""
        WITH q AS ({pair_sql}), qg AS (SELECT query_id, ac_id, {n_q} AS qn, {r_q} AS qr FROM q), g AS (SELECT p_partkey, p_brand, {n} AS n, {r} AS r FROM part),
        t AS (SELECT query_id, p_partkey, {duck_similarity('n', 'qn')} AS a, {duck_similarity('r', 'qr')} AS b FROM qg JOIN g ON ac_id = p_brand),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a + b DESC, p_partkey) AS rank FROM t WHERE CAST(a AS DOUBLE) >= 0.3 AND CAST(b AS DOUBLE) >= 0.3)
        SELECT query_id, rank, p_partkey AS voter_record_id, round(CAST(a AS DOUBLE), 4) AS name_score, round(CAST(b AS DOUBLE), 4) AS relative_score FROM k WHERE rank <= 20""")
    def name_relative_search_batch(spark, folder):
        asked = table(spark, folder, "supplier").selectExpr(
            "s_suppkey AS query_id", "concat('Brand#', s_suppkey % 25 + 1) AS ac_id",
            "concat(CASE s_suppkey % 3 WHEN 0 THEN 'Red  widgt' WHEN 1 THEN 'old bolt' ELSE 'smal ring' END, ' ', s_suppkey % 50) AS name",
            "concat(CASE s_suppkey % 4 WHEN 0 THEN 'promo ' WHEN 1 THEN 'standard ' WHEN 2 THEN '' ELSE 'econmy ' END, CASE s_suppkey % 3 WHEN 0 THEN 'widget' WHEN 1 THEN 'bolt' ELSE 'ring' END) AS relative")
        return pairsearch.name_and_relative_search_batch(asked, named_parts(spark, folder), ["ac_id"])

    def coded(spark, folder):
        return crossroll.with_search_columns(named_parts(spark, folder), "name_normalized", "relative_name_normalized")

    name, asked_name = f"lower({NAME})", "'smal boldt'"
    same_code = f"{duck_soundex(name)} = {duck_soundex(asked_name)}"

    @catalog.add("phonetic_lookup", f"""
        SELECT p_partkey AS voter_record_id, {name} AS name_normalized FROM part WHERE p_brand = 'Brand#3' AND {same_code}
        ORDER BY CAST(p_partkey AS INT), p_partkey LIMIT 20""")
    def phonetic_lookup(spark, folder):
        return crossroll.phonetic_lookup(coded(spark, folder), F.col("ac_id") == "Brand#3", "smal boldt").select("voter_record_id", "name_normalized")

    @catalog.add("combined_score", f"""
        WITH g AS (SELECT p_partkey, {duck_trigrams(name)} AS a, {duck_trigrams(asked_name)} AS b, {same_code} AS same FROM part WHERE p_brand = 'Brand#3'),
        s AS (SELECT p_partkey, greatest(CAST({duck_similarity('a', 'b')} AS DOUBLE), CASE WHEN same THEN 0.7 ELSE 0.0 END) AS score FROM g)
        SELECT p_partkey AS voter_record_id, round(score, 4) AS score FROM s WHERE score >= 0.3 ORDER BY s.score DESC, p_partkey LIMIT 20""")
    def combined_score(spark, folder):
        got = crossroll.combined_score(coded(spark, folder), F.col("ac_id") == "Brand#3", "smal boldt")
        return got.select("voter_record_id", F.round("score", 4).alias("score"))

    asked_sql = ("concat(CASE s_suppkey % 3 WHEN 0 THEN 'red widgt' WHEN 1 THEN 'old bolt' ELSE 'smal ring' END, ' ', s_suppkey % 50)")

    @catalog.add("two_phase_search", f"""
        WITH q AS (SELECT s_suppkey AS query_id, concat('Brand#', s_suppkey % 25 + 1) AS ac, {asked_sql} AS query FROM supplier),
        qg AS (SELECT *, {duck_trigrams('query')} AS a, {duck_soundex('query')} AS qc FROM (SELECT DISTINCT ac, query FROM q)),
        ng AS (SELECT *, {duck_trigrams('name')} AS b, {duck_soundex('name')} AS nc FROM (SELECT p_partkey, p_brand, {name} AS name FROM part)),
        m AS (SELECT ac, query, name, p_partkey, qc = nc AS same, {duck_similarity('a', 'b')} AS score FROM qg JOIN ng ON ac = p_brand),
        f AS (SELECT *, row_number() OVER (PARTITION BY ac, query ORDER BY score DESC, p_partkey) AS rn FROM m WHERE CAST(score AS DOUBLE) >= 0.3),
        r AS (SELECT *, round(0.6 * CAST(score AS DOUBLE) + 0.3 * (len(list_intersect(string_split(query, ' '), string_split(name, ' '))) * 1.0
            / len(list_distinct(string_split(query, ' ')))) + CASE WHEN same THEN 0.1 ELSE 0.0 END, 6) AS rank_score FROM f WHERE rn <= 200),
        t AS (SELECT query_id, p_partkey, score, rank_score, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, p_partkey) AS rank
            FROM q JOIN r ON q.ac = r.ac AND q.query = r.query)
        SELECT query_id, rank, p_partkey AS voter_record_id, round(CAST(score AS DOUBLE), 4) AS score, rank_score FROM t WHERE rank <= 20""")
    def two_phase_search(spark, folder):
        asked = table(spark, folder, "supplier").selectExpr(
            "s_suppkey AS query_id", "concat('Brand#', s_suppkey % 25 + 1) AS ac_id",
            "concat(CASE s_suppkey % 3 WHEN 0 THEN 'red widgt' WHEN 1 THEN 'old bolt' ELSE 'smal ring' END, ' ', s_suppkey % 50) AS query")
        return crossroll.two_phase_search(asked, named_parts(spark, folder), ["ac_id"])

    @catalog.add("variant_match", f"""
        SELECT p_partkey AS voter_record_id FROM part WHERE p_name IN ('red bolt', 'old gear') OR p_type || ' ' || p_name IN ('red bolt', 'old gear')""")
    def variant_match(spark, folder):
        spelled = table(spark, folder, "part").selectExpr("p_partkey AS voter_record_id", "array(p_name, concat(p_type, ' ', p_name)) AS name_variants")
        return crossroll.variant_match(spelled, ["red bolt", "old gear"]).select("voter_record_id")

    @catalog.add("ac_mapping", f"""WITH {CTES}, mapping AS (SELECT n_nationkey + 100 AS old_ac, n_nationkey * 10 AS new_ac FROM nation UNION ALL SELECT n_nationkey + 100, n_nationkey * 10 + 1 FROM nation WHERE n_regionkey < 3)
        SELECT new_ac, count(*) AS records FROM voter_records v JOIN assembly_constituencies a ON v.ac_id = a.ac_id JOIN mapping m ON a.ac_number = old_ac GROUP BY new_ac""")
    def ac_mapping(spark, folder):
        t = loaded(spark, folder)
        nation = table(spark, folder, "nation")
        mapping = nation.selectExpr("n_nationkey + 100 AS old_ac", "explode(IF(n_regionkey < 3, array(n_nationkey * 10, n_nationkey * 10 + 1), array(n_nationkey * 10))) AS new_ac")
        # Counted per old constituency, then carried over.
        counts = t["voter_records"].groupBy("ac_id").agg(F.count("*").alias("n")).join(t["assembly_constituencies"], "ac_id")
        return crossroll.map_constituencies(counts, mapping).groupBy("new_ac").agg(F.sum("n").alias("records"))

    # The same people in two rolls: customers, and what their orders of later years say.
    old_sql = "SELECT c_custkey AS k, c_mktsegment AS name, c_nationkey % 2 AS gender, 20 + c_custkey % 50 AS age FROM customer"
    new_sql = ("SELECT o_custkey + CASE WHEN o_custkey % 7 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN o_custkey % 5 = 0 THEN 'RENAMED' ELSE max(c_mktsegment) END AS name, "
               "max(c_nationkey % 2) AS gender, 40 + o_custkey % 50 + (CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE 1 END) AS age FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
    diff_sql = f"""
        WITH o AS ({old_sql}), n AS ({new_sql}),
        j AS (SELECT coalesce(o.k, n.k) AS k, o.k AS ok, n.k AS nk, CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL THEN array_to_string(list_filter([
            CASE WHEN o.name IS DISTINCT FROM n.name THEN 'name' END, CASE WHEN o.gender IS DISTINCT FROM n.gender THEN 'gender' END,
            CASE WHEN abs(n.age - o.age - 20) > 1 THEN 'age' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS differences FROM o FULL OUTER JOIN n ON o.k = n.k),
        d AS (SELECT k, differences, CASE WHEN ok IS NULL THEN 'added' WHEN nk IS NULL THEN 'deleted' WHEN differences <> '' THEN 'under_review' ELSE 'unchanged' END AS status FROM j)"""

    def compared(spark, folder):
        customer = table(spark, folder, "customer")
        old = customer.selectExpr("c_custkey AS k", "c_mktsegment AS name", "c_nationkey % 2 AS gender", "20 + c_custkey % 50 AS age")
        asked = table(spark, folder, "orders").select("o_custkey").distinct()
        new = asked.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
            "o_custkey + CASE WHEN o_custkey % 7 = 0 THEN 1000000 ELSE 0 END AS k", "CASE WHEN o_custkey % 5 = 0 THEN 'RENAMED' ELSE c_mktsegment END AS name",
            "c_nationkey % 2 AS gender", "40 + o_custkey % 50 + (CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE 1 END) AS age")
        return crossroll.compare_rolls(old, new, ["k"], ["name", "gender"], years=20)

    @catalog.add("cross_year_diff", diff_sql + " SELECT k, differences, status FROM d")
    def cross_year_diff(spark, folder):
        return compared(spark, folder).select("k", F.array_join("differences", ",").alias("differences"), "status")

    @catalog.add("roll_diff", diff_sql + " SELECT status, count(*) AS records FROM d GROUP BY status")
    def roll_diff(spark, folder):
        return compared(spark, folder).groupBy("status").agg(F.count("*").alias("records"))

    # Chains: four orders share one key, the ends of neighbouring fours share another.
    @catalog.add("person_linkage", "SELECT o_orderkey AS record_id, CAST(floor(o_orderkey / 16) * 16 AS BIGINT) AS canonical_id FROM orders")
    def person_linkage(spark, folder):
        rows = table(spark, folder, "orders").selectExpr(
            "o_orderkey AS record_id", "floor(o_orderkey / 4) AS name_key",
            "CASE WHEN o_orderkey % 16 NOT IN (0, 15) AND o_orderkey % 4 IN (0, 3) THEN floor((o_orderkey + 1) / 4) END AS id_key")
        return crossroll.link_persons(rows, "record_id", ["name_key", "id_key"])

    shown_id = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('ABC', lpad(concat('', o_orderkey), 7, '0')) WHEN 2 THEN concat('AB', o_orderkey) ELSE concat('MT/07/046/', lpad(concat('', o_custkey), 7, '0')) END"
    columns = [f"{shown_id} AS id_text", "CAST(o_custkey % 140 AS INT) AS age", "CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE o_orderpriority END AS name", "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'M' ELSE 'F' END AS gender"]

    @catalog.add("record_quality_score", f"""
        WITH r AS (SELECT o_orderkey, {", ".join(columns)} FROM orders)
        SELECT o_orderkey, round(CASE WHEN regexp_matches(id_text, '^([A-Z]{{3}}\\d{{7}}|MT/\\d{{2}}/\\d{{3}}/\\d{{7}})$') THEN 0.25 ELSE 0 END + CASE WHEN age BETWEEN 18 AND 120 THEN 0.25 ELSE 0 END
          + CASE WHEN trim(name) <> '' THEN 0.25 ELSE 0 END + CASE WHEN gender IN ('M', 'F') THEN 0.25 ELSE 0 END, 4) AS score FROM r""")
    def record_quality_score(spark, folder):
        rows = table(spark, folder, "orders").selectExpr("o_orderkey", *columns)
        return rows.select("o_orderkey", crossroll.record_quality(*[F.col(c) for c in ("id_text", "age", "name", "gender")]).alias("score"))

    @catalog.add("doc_routing", """
        WITH c AS (SELECT l_orderkey AS doc_id, count(*) AS parsed_records, CAST(max(l_linenumber) AS BIGINT) AS expected_records FROM lineitem GROUP BY 1)
        SELECT *, CASE WHEN parsed_records = expected_records THEN 'done' WHEN parsed_records * 1.0 / expected_records >= 0.9 THEN 'retry' ELSE 'manual' END AS route FROM c""")
    def doc_routing(spark, folder):
        counts = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
            F.count("*").alias("parsed_records"), F.max("l_linenumber").cast("bigint").alias("expected_records"))
        return crossroll.route_documents(counts)

    @catalog.add("layout_routing", """
        SELECT doc_id, coalesce('layout ' || n_name, 'unknown') AS layout FROM documents LEFT JOIN nation ON 'src' || n_nationkey = source AND n_regionkey > 0""")
    def layout_routing(spark, folder):
        docs = table(spark, folder, "documents").selectExpr("doc_id", "source AS font_name")
        fonts = table(spark, folder, "nation").where("n_regionkey > 0").selectExpr("concat('src', n_nationkey) AS font_name", "concat('layout ', n_name) AS layout")
        return crossroll.route_layouts(docs, fonts).select("doc_id", "layout")

    @catalog.add("searchable_pages", """
        SELECT source AS doc_id, max(length(trim(text))) AS longest_page, max(length(trim(text))) > 100 AS searchable FROM documents WHERE doc_id % 9 + 1 <= 5 GROUP BY source""")
    def searchable_pages(spark, folder):
        pages = table(spark, folder, "documents").selectExpr("source AS doc_id", "CAST(doc_id % 9 + 1 AS INT) AS page_no", "text")
        return crossroll.searchable_documents(pages)

    block = "concat('cover ', o_orderkey % 3 + 1, ' ABC', lpad(concat('', o_custkey), 7, '0'), ' Name A ', o_orderpriority, ' ', o_orderkey % 9 + 10, ' XYZ', lpad(concat('', o_orderkey), 7, '0'), ' Name B')"

    @catalog.add("block_split", """
        SELECT o_orderkey AS doc_id, 1 AS block_no, (o_orderkey % 3 + 1) || ' ABC' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') || ' Name A ' || o_orderpriority || ' ' AS block FROM orders
        UNION ALL SELECT o_orderkey, 2, (o_orderkey % 9 + 10) || ' XYZ' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || ' Name B' FROM orders""")
    def block_split(spark, folder):
        return crossroll.split_blocks(table(spark, folder, "orders").selectExpr("o_orderkey AS doc_id", f"{block} AS text"))

    @catalog.add("dropdowns", f"""WITH {CTES} SELECT DISTINCT a.state_id, a.ac_number, a.name, p.part_number FROM assembly_constituencies a LEFT JOIN polling_stations p ON a.ac_id = p.ac_id""")
    def dropdowns(spark, folder):
        return crossroll.dropdown(loaded(spark, folder))

    acs = "SELECT CAST(c_custkey AS INT) AS ac_number, c_mktsegment AS district_id, 'S' || (c_nationkey % 3) AS state_id, c_name AS name FROM customer"

    @catalog.add("nearby_acs", f"""WITH a AS ({acs}) SELECT x.ac_number AS from_ac, y.ac_number, y.name FROM a x JOIN a y ON x.state_id = y.state_id AND x.district_id = y.district_id AND y.ac_number BETWEEN x.ac_number - 3 AND x.ac_number + 3 AND x.ac_number <> y.ac_number""")
    def nearby_acs(spark, folder):
        rows = table(spark, folder, "customer").selectExpr(
            "CAST(c_custkey AS INT) AS ac_number", "c_mktsegment AS district_id", "concat('S', c_nationkey % 3) AS state_id", "c_name AS name")
        return crossroll.nearby_constituencies(rows, 3).select("from_ac", "ac_number", "name")

    @catalog.add("ac_ranges", "SELECT CAST(floor(o_custkey % 288 / 25) AS INT) AS ac_range, count(*) AS records FROM orders GROUP BY 1")
    def ac_ranges(spark, folder):
        return table(spark, folder, "orders").groupBy(crossroll.ac_range(F.col("o_custkey") % 288).alias("ac_range")).agg(F.count("*").alias("records"))
