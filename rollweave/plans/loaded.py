"""Loaded-table queries: joins, integrity checks, summaries, readiness, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollweave.operators import readiness, search, upsert
from rollweave.plans import Catalog, table
from rollweave.plans.scalars import search_records

# lineitem rows as voter records, nation as constituencies, supplier as stations and roll
# versions, part as source documents, orders as extraction runs.
_QUALITY = (
    "CASE WHEN l_quantity < 2 THEN 'missing_age' WHEN l_quantity < 3 THEN 'truncated_line,underage' "
    "WHEN l_suppkey % 7 = 3 AND l_quantity < 9 THEN 'underage' ELSE 'ok' END"
)
VOTERS = (
    f"SELECT l_orderkey * 8 + l_linenumber AS voter_record_id, concat('S', l_suppkey % 25 % 5) AS state_id, l_suppkey % 25 AS ac_id, "
    f"l_suppkey + (CASE WHEN l_partkey % 10 = 0 THEN 1000000 ELSE 0 END) AS polling_station_id, l_partkey AS serial_number, {_QUALITY} AS data_quality FROM lineitem"
)
ACS = "SELECT CAST(n_nationkey AS BIGINT) AS ac_id, concat('S', n_nationkey % 5) AS state_id, n_nationkey + 100 AS ac_number, n_name AS name FROM nation"
STATIONS = "SELECT s_suppkey AS polling_station_id, s_suppkey % 25 AS ac_id, CAST(floor(s_suppkey / 25) AS INT) + 1 AS part_number FROM supplier"
ROLLS = "SELECT s_suppkey AS roll_version_id, concat('S', s_suppkey % 5) AS state_id FROM supplier"
SOURCES = "SELECT p_partkey AS source_document_id, p_partkey % 120 AS roll_version_id FROM part"
RUNS = (
    "SELECT o_orderkey AS extraction_run_id, o_orderkey % 2500 AS source_document_id, "
    "CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'failed' END AS status, "
    "CAST(floor(o_totalprice / 1000) AS INT) AS expected_records, "
    "CAST(floor(o_totalprice / 1000) AS INT) - (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS parsed_records FROM orders"
)
SQL = {
    "voter_records": VOTERS, "assembly_constituencies": ACS, "polling_stations": STATIONS,
    "roll_versions": ROLLS, "source_documents": SOURCES, "extraction_runs": RUNS,
}
_BASE = {
    "voter_records": "lineitem", "assembly_constituencies": "nation", "polling_stations": "supplier",
    "roll_versions": "supplier", "source_documents": "part", "extraction_runs": "orders",
}
CTES = ",\n".join(f"{n} AS ({s})" for n, s in SQL.items())


def loaded(spark, folder):
    """The six tables, each a projection of one scan."""
    return {
        name: spark.sql(text.replace(f"FROM {_BASE[name]}", "FROM {base}"), base=table(spark, folder, _BASE[name]))
        for name, text in SQL.items()
    }


SCOPED = """FROM voter_records v JOIN assembly_constituencies a ON v.ac_id = a.ac_id
    LEFT JOIN polling_stations p ON v.polling_station_id = p.polling_station_id"""
ROLL_JOIN = """FROM roll_versions rv LEFT JOIN source_documents sd ON rv.roll_version_id = sd.roll_version_id
    LEFT JOIN extraction_runs er ON sd.source_document_id = er.source_document_id"""
ROLL_COUNTS = """count(DISTINCT sd.source_document_id) AS source_documents, count(DISTINCT er.extraction_run_id) AS extraction_runs,
    count(DISTINCT er.extraction_run_id) FILTER (WHERE er.status = 'validated') AS validated_runs,
    count(DISTINCT er.extraction_run_id) FILTER (WHERE er.status <> 'validated') AS nonvalidated_runs,
    coalesce(sum(er.expected_records), 0) AS expected_records, coalesce(sum(er.parsed_records), 0) AS parsed_records"""

# Registry rows of the readiness reports, one per region key; S4 is not registered.
STATES = (
    "SELECT CASE WHEN r_regionkey = 4 THEN 'ZZ' ELSE concat('S', r_regionkey) END AS state_id, CASE WHEN r_regionkey % 2 = 0 THEN 'official' ELSE 'reported' END AS confidence, "
    "r_regionkey % 3 <> 1 AS public_launch_ready, concat('capability ', r_name) AS data_capability, concat('parser ', r_name) AS parser_status FROM region"
)


def states(spark, folder):
    flat = spark.sql(STATES.replace("FROM region", "FROM {base}"), base=table(spark, folder, "region"))
    return flat.withColumn("schedule_provenance", F.struct("confidence"))


def _report_sql(by: str) -> str:
    part = ", part_number" if by == "part" else ""
    scopes = (
        "SELECT DISTINCT a.state_id, a.ac_number, p.part_number FROM assembly_constituencies a JOIN polling_stations p ON a.ac_id = p.ac_id"
        if by == "part" else "SELECT DISTINCT state_id, ac_number FROM assembly_constituencies"
    )
    on = "s.state_id = c.state_id AND s.ac_number = c.ac_number" + (" AND s.part_number = c.part_number" if part else "")
    where = " WHERE part_number IS NOT NULL" if part else ""
    keys = "s.state_id, s.ac_number" + (", s.part_number" if part else "")
    return f"""WITH {CTES}, states AS ({STATES}),
    flags AS (SELECT v.state_id, a.ac_number, p.part_number, data_quality {SCOPED}),
    fc AS (SELECT state_id, ac_number{part}, data_quality, count(*) AS n FROM flags{where} GROUP BY ALL),
    counts AS (SELECT state_id, ac_number{part}, sum(n) AS voter_records, sum(n) FILTER (WHERE data_quality = 'ok') AS ok_records,
        sum(n) FILTER (WHERE data_quality <> 'ok') AS issue_records, string_agg(data_quality || '=' || n, ';' ORDER BY data_quality) AS quality FROM fc GROUP BY ALL),
    rolls AS (SELECT rv.state_id, {ROLL_COUNTS} {ROLL_JOIN} GROUP BY rv.state_id),
    scopes AS ({scopes}),
    j AS (SELECT {keys}, t.state_id AS known, t.public_launch_ready, t.confidence, quality,
        coalesce(voter_records, 0) AS voter_records, coalesce(ok_records, 0) AS ok_records, coalesce(issue_records, 0) AS issue_records,
        coalesce(source_documents, 0) AS source_documents, coalesce(extraction_runs, 0) AS extraction_runs, coalesce(nonvalidated_runs, 0) AS nonvalidated_runs,
        coalesce(expected_records, 0) AS expected_records, coalesce(parsed_records, 0) AS parsed_records,
        CASE WHEN coalesce(voter_records, 0) > 0 THEN coalesce(issue_records, 0) * 1.0 / voter_records ELSE 0 END AS rate
      FROM scopes s LEFT JOIN counts c ON {on} LEFT JOIN rolls r ON s.state_id = r.state_id LEFT JOIN states t ON s.state_id = t.state_id),
    b AS (SELECT *, CASE WHEN known IS NULL THEN ['unknown state_id: ' || state_id] ELSE list_filter([
        CASE WHEN NOT public_launch_ready THEN 'state config is not marked public_launch_ready' END,
        CASE WHEN confidence <> 'official' THEN 'schedule provenance is not official' END,
        CASE WHEN source_documents = 0 THEN 'no source documents loaded' END,
        CASE WHEN extraction_runs = 0 THEN 'no extraction runs loaded' END,
        CASE WHEN nonvalidated_runs > 0 THEN 'one or more extraction runs are not validated' END,
        CASE WHEN expected_records <> parsed_records THEN 'expected and parsed record counts do not match' END,
        CASE WHEN voter_records = 0 THEN 'no scoped voter records loaded' END,
        CASE WHEN rate > 0.05 THEN 'data quality issue rate exceeds threshold' END], lambda x: x IS NOT NULL) END AS blockers FROM j)
    SELECT state_id, ac_number{part}, len(blockers) = 0 AS ready_for_public, voter_records, ok_records, issue_records, source_documents, extraction_runs,
      nonvalidated_runs, expected_records, parsed_records, round(rate, 4) AS quality_issue_rate, coalesce(quality, '') AS quality, array_to_string(blockers, '; ') AS blockers FROM b"""


def _report(spark, folder, by):
    got = readiness.readiness(loaded(spark, folder), states(spark, folder), by=by)
    pairs = F.transform(F.map_entries("quality_summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    keys = ["state_id", "ac_number"] + (["part_number"] if by == "part" else [])
    return got.select(
        *keys, "ready_for_public", "voter_records", "ok_records", "issue_records", "source_documents",
        "extraction_runs", "nonvalidated_runs", "expected_records", "parsed_records", "quality_issue_rate",
        F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("quality"), F.array_join("blockers", "; ").alias("blockers"),
    )


def register(catalog: Catalog) -> None:
    def tables(spark, folder, *names):
        t = loaded(spark, folder)
        return [t[n] for n in names]

    three = ("voter_records", "assembly_constituencies", "polling_stations")

    @catalog.add("join_inner", f"""WITH {CTES} SELECT v.state_id, a.ac_number, a.name, count(*) AS records, sum(serial_number) AS serials
        FROM voter_records v JOIN assembly_constituencies a ON v.ac_id = a.ac_id GROUP BY 1, 2, 3""")
    def join_inner(spark, folder):
        v, a, _ = tables(spark, folder, *three)
        # Counted per constituency before the join.
        pre = v.groupBy("state_id", "ac_id").agg(F.count("*").alias("records"), F.sum("serial_number").alias("serials"))
        return pre.join(a.select("ac_id", "ac_number", "name"), "ac_id").select("state_id", "ac_number", "name", "records", "serials")

    @catalog.add("join_left", f"""WITH {CTES} SELECT voter_record_id, serial_number, v.state_id, a.ac_number, p.part_number, data_quality {SCOPED}""")
    def join_left(spark, folder):
        return search.scoped_records(*tables(spark, folder, *three)).select(
            "voter_record_id", "serial_number", "state_id", "ac_number", "part_number", "data_quality")

    @catalog.add("join_left_part", f"""WITH {CTES} SELECT voter_record_id, serial_number {SCOPED} WHERE v.state_id = 'S2' AND a.ac_number = 107 AND p.part_number = 2""")
    def join_left_part(spark, folder):
        return search.scoped_records(*tables(spark, folder, *three), "S2", 107, 2).select("voter_record_id", "serial_number")

    @catalog.add("roll_summary", f"WITH {CTES} SELECT {ROLL_COUNTS} {ROLL_JOIN} WHERE rv.state_id = 'S2'")
    def roll_summary(spark, folder):
        rv, sd, er = tables(spark, folder, "roll_versions", "source_documents", "extraction_runs")
        return readiness.roll_summary(rv.where("state_id = 'S2'"), sd, er)

    @catalog.add("roll_summary_by_state", f"WITH {CTES} SELECT rv.state_id, {ROLL_COUNTS} {ROLL_JOIN} GROUP BY rv.state_id")
    def roll_summary_by_state(spark, folder):
        return readiness.roll_summary(*tables(spark, folder, "roll_versions", "source_documents", "extraction_runs"), by="state_id")

    counts = "count(*) AS voter_records, count(*) FILTER (WHERE data_quality = 'ok') AS ok_records, count(*) FILTER (WHERE data_quality <> 'ok') AS issue_records"

    @catalog.add("voter_summary", f"""WITH {CTES}, s AS (SELECT {counts} {SCOPED} WHERE v.state_id = 'S3' AND a.ac_number = 103)
        SELECT *, round(CASE WHEN voter_records > 0 THEN issue_records * 1.0 / voter_records ELSE 0 END, 4) AS quality_issue_rate FROM s""")
    def voter_summary(spark, folder):
        return readiness.voter_summary(*tables(spark, folder, *three), "S3", 103)

    @catalog.add("quality_breakdown", f"""WITH {CTES} SELECT data_quality, count(*) AS count {SCOPED} WHERE v.state_id = 'S3' AND a.ac_number = 103 GROUP BY data_quality""")
    def quality_breakdown(spark, folder):
        return readiness.quality_breakdown(*tables(spark, folder, *three), "S3", 103)

    @catalog.add("readiness_report", _report_sql("ac"))
    def readiness_report(spark, folder):
        return _report(spark, folder, "ac")

    @catalog.add("readiness_by_part", _report_sql("part"))
    def readiness_by_part(spark, folder):
        return _report(spark, folder, "part")

    @catalog.add("record_audit", """SELECT count(*) AS total, count(*) FILTER (WHERE hint IS NULL OR hint = '' OR length(hint) = 4) AS redaction_ready,
        count(*) FILTER (WHERE c_nationkey IS NOT NULL) AS scoped FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE right(c_name, 4) END AS hint FROM customer)""")
    def record_audit(spark, folder):
        return readiness.record_audit(search_records(spark, folder))

    @catalog.add("fk_orphans", f"""WITH {CTES}
        SELECT 'voter_records' AS child, 'polling_station_id' AS "column", 'polling_stations' AS parent, count(*) AS orphans FROM voter_records v WHERE NOT EXISTS (SELECT 1 FROM polling_stations p WHERE p.polling_station_id = v.polling_station_id)
        UNION ALL SELECT 'voter_records', 'ac_id', 'assembly_constituencies', count(*) FROM voter_records v WHERE NOT EXISTS (SELECT 1 FROM assembly_constituencies a WHERE a.ac_id = v.ac_id)
        UNION ALL SELECT 'polling_stations', 'ac_id', 'assembly_constituencies', count(*) FROM polling_stations v WHERE NOT EXISTS (SELECT 1 FROM assembly_constituencies a WHERE a.ac_id = v.ac_id)
        UNION ALL SELECT 'source_documents', 'roll_version_id', 'roll_versions', count(*) FROM source_documents v WHERE NOT EXISTS (SELECT 1 FROM roll_versions a WHERE a.roll_version_id = v.roll_version_id)
        UNION ALL SELECT 'extraction_runs', 'source_document_id', 'source_documents', count(*) FROM extraction_runs v WHERE NOT EXISTS (SELECT 1 FROM source_documents a WHERE a.source_document_id = v.source_document_id)""")
    def fk_orphans(spark, folder):
        from rollweave.schemas import FOREIGN_KEYS

        t = loaded(spark, folder)
        return upsert.orphan_counts(t, [k for k in FOREIGN_KEYS if k[0] in t and k[2] in t and k[1] in t[k[0]].columns])

    @catalog.add("fk_orphan_rows", f"""WITH {CTES} SELECT voter_record_id, polling_station_id FROM voter_records WHERE polling_station_id NOT IN (SELECT polling_station_id FROM polling_stations)""")
    def fk_orphan_rows(spark, folder):
        v, p = tables(spark, folder, "voter_records", "polling_stations")
        return upsert.orphans(v, p, "polling_station_id", "polling_station_id").select("voter_record_id", "polling_station_id")

    @catalog.add("unique_violations", f"""WITH {CTES} SELECT ac_id, serial_number, count(*) AS occurrences FROM voter_records GROUP BY 1, 2 HAVING count(*) > 1""")
    def unique_violations(spark, folder):
        (v,) = tables(spark, folder, "voter_records")
        return upsert.key_violations(v, ["ac_id", "serial_number"])

    # Lines of other orders get keys the target lacks.
    new_key = "l_orderkey + (CASE WHEN l_linenumber > 5 THEN 10000000 ELSE 0 END)"

    @catalog.add("upsert_merge", f"""
        WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS created_at FROM orders),
        u0 AS (SELECT {new_key} AS k, l_linestatus AS status, l_extendedprice AS price, l_shipdate AS created_at FROM lineitem),
        u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, price DESC, status DESC) AS rn FROM u0) WHERE rn = 1)
        SELECT coalesce(t.k, u.k) AS k, CASE WHEN u.k IS NOT NULL THEN u.status ELSE t.status END AS status,
               CASE WHEN u.k IS NOT NULL THEN u.price ELSE t.price END AS price, CASE WHEN t.k IS NOT NULL THEN t.created_at ELSE u.created_at END AS created_at
        FROM t FULL OUTER JOIN u ON t.k = u.k""")
    def upsert_merge(spark, folder):
        t = table(spark, folder, "orders").selectExpr("o_orderkey AS k", "o_orderstatus AS status", "o_totalprice AS price", "o_orderdate AS created_at")
        u = table(spark, folder, "lineitem").selectExpr(f"{new_key} AS k", "l_linestatus AS status", "l_extendedprice AS price", "l_shipdate AS created_at")
        newest = upsert.latest(u.select("k", "created_at", "price", "status"), ["k"], F.col("created_at"))
        return upsert.merge_rows(t, newest, ["k"])

    @catalog.add("seed_states", """
        WITH t AS (SELECT concat('ST-', s_suppkey * 20) AS state_id, 'old' AS name, 'en' AS default_language FROM supplier),
        r AS (SELECT concat('ST-', c_custkey) AS state_id, c_name AS name, c_mktsegment AS default_language FROM customer)
        SELECT coalesce(t.state_id, r.state_id) AS state_id, coalesce(r.name, t.name) AS name, coalesce(r.default_language, t.default_language) AS default_language
        FROM t FULL OUTER JOIN r ON t.state_id = r.state_id""")
    def seed_states(spark, folder):
        fixed = ["'E1' AS eci_state_code", "'guidance_only' AS data_capability", "false AS public_launch_ready"]
        t = table(spark, folder, "supplier").selectExpr("concat('ST-', s_suppkey * 20) AS state_id", "'old' AS name", "'en' AS default_language", *fixed)
        r = table(spark, folder, "customer").selectExpr("concat('ST-', c_custkey) AS state_id", "c_name AS name", "c_mktsegment AS default_language", *fixed)
        return upsert.seed_states(t, r).select("state_id", "name", "default_language")

    @catalog.add("manifest_append", """
        SELECT p_partkey * 2 AS source_id, p_name AS source_label, 'kept' AS outcome FROM part
        UNION ALL SELECT c_custkey, c_name, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey * 2 = c_custkey) THEN 'rejected' ELSE 'added' END FROM customer""")
    def manifest_append(spark, folder):
        old = table(spark, folder, "part").selectExpr("p_partkey * 2 AS source_id", "p_name AS source_label", "'kept' AS outcome")
        new = table(spark, folder, "customer").selectExpr("c_custkey AS source_id", "c_name AS source_label", "'added' AS outcome")
        merged, rejected = upsert.append_new(old, new, "source_id")
        return merged.unionByName(rejected.drop("error").withColumn("outcome", F.lit("rejected")))

    # Ids that the existing rows have, and ids that come again within the new ones.
    @catalog.add("manifest_append_rejected", """
        WITH new AS (SELECT c_custkey % 90 AS source_id, c_name AS source_label, row_number() OVER (PARTITION BY c_custkey % 90 ORDER BY c_name) AS nth FROM customer)
        SELECT source_id, source_label, 'source_id already exists in manifest: ' || source_id AS error FROM new
        WHERE nth > 1 OR source_id IN (SELECT p_partkey * 2 FROM part)""")
    def manifest_append_rejected(spark, folder):
        old = table(spark, folder, "part").selectExpr("p_partkey * 2 AS source_id", "p_name AS source_label")
        new = table(spark, folder, "customer").selectExpr("c_custkey % 90 AS source_id", "c_name AS source_label")
        return upsert.append_new(old, new, "source_id")[1]
