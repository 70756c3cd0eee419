"""What is written is read back: JSON documents with damaged ones among them, exports, files and their checksums."""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import functions as F

from rollweave.operators import scan
from rollweave.operators.ingest import stamp_documents
from rollweave.plans import Catalog, table
from rollweave.plans.extraction import DOCUMENTS_SQL, RECORDS_SQL, documents, lines, roll_lines
from rollweave.plans.standins import glyph_name
from rollweave.session import scratch_path
from rollweave.sources import readers, writers
from rollweave.sources.writers import local_path, on_mounted_disk, write_texts

_FILE = "CAST(regexp_extract(file, 'doc=([0-9]+)', 1) AS BIGINT)"
# Every eleventh document is cut off, every seventh has another type where the rows should be, every thirteenth lacks them.
_DAMAGE = "CASE WHEN {0} % 11 = 0 THEN substr({1}, 1, 20) WHEN {0} % 7 = 0 THEN {2} WHEN {0} % 13 = 0 THEN '{{\"other\": 1}}' ELSE {1} END"
_ERRORS = "CASE WHEN {0} % 11 = 0 THEN 'document is not valid JSON' WHEN {0} % 7 = 0 OR {0} % 13 = 0 THEN '{1}' END"


def _written(spark, texts, label: str) -> str:
    """A file for each (doc, value) below a new folder."""
    path = scratch_path(spark, label)
    by_doc = texts.select("doc", "value").repartition("doc")
    if not on_mounted_disk(spark, path):
        by_doc.write.partitionBy("doc").text(path)
        return path
    os.makedirs(local_path(path), exist_ok=True)
    by_doc.sortWithinPartitions("doc").foreachPartition(partial(write_texts, local_path(path)))
    return path


def _manifest_files(spark, folder) -> str:
    rows = table(spark, folder, "part").selectExpr(
        "CAST(p_partkey % 60 AS BIGINT) AS doc", "p_partkey", "struct(concat('src-', p_partkey % 700) AS source_id, p_name AS source_label, p_partkey % 2 = 0 AS reviewed) AS s")
    docs = rows.groupBy("doc").agg(F.to_json(F.struct(F.transform(
        F.array_sort(F.collect_list(F.struct("p_partkey", "s"))), lambda x: x["s"]).alias("sources"))).alias("json"))
    return _written(spark, docs.selectExpr("doc", f"{_DAMAGE.format('doc', 'json', repr(chr(123) + chr(34) + 'sources' + chr(34) + ': 5}'))} AS value"), "manifests")


def _state_files(spark, folder) -> str:
    docs = table(spark, folder, "supplier").selectExpr(
        "CAST(s_suppkey AS BIGINT) + 10000 AS doc", "to_json(named_struct('state_id', concat('ST-', s_suppkey % 40), 'name', s_name, 'sir_schedule', "
        "named_struct('claims_end', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE date_format(DATE '2026-01-01' + CAST(s_suppkey % 200 AS INT), 'yyyy-MM-dd') END))) AS json")
    return _written(spark, docs.selectExpr("doc", f"{_DAMAGE.format('doc', 'json', repr('[5]'))} AS value"), "states")


def _stamped(spark, folder):
    recs = lines.extract_records(roll_lines(spark, folder))
    return stamp_documents(recs, documents(spark, folder))


def _records(stamped):
    """Records of stamped lines, in the columns' order of :func:`_stamped`. A record is over twice its line: it is read after the shuffle."""
    found, stamps = lines.extract_records(stamped), ["state_code", "ac_number", "part_number", "year"]
    return found.select(*[c for c in found.columns if c not in stamps], *stamps)


def register(catalog: Catalog) -> None:
    sources_error = _ERRORS.format("doc", "sources is missing or not a list")

    @catalog.add("manifest_files", f"""
        WITH e AS (SELECT CAST(p_partkey % 60 AS BIGINT) AS doc, p_partkey, 'src-' || (p_partkey % 700) AS source_id, p_name, p_partkey % 2 = 0 AS reviewed FROM part),
        good AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CAST(doc AS VARCHAR) DESC, p_partkey DESC) AS rn FROM e WHERE {sources_error} IS NULL)
        SELECT source_id, p_name AS source_label, reviewed, CAST(NULL AS BIGINT) AS doc, CAST(NULL AS VARCHAR) AS error FROM good WHERE rn = 1
        UNION ALL SELECT NULL, NULL, NULL, doc, {sources_error} FROM (SELECT DISTINCT doc FROM e) WHERE {sources_error} IS NOT NULL""")
    def manifest_files(spark, folder):
        entries, errors = readers.read_checked_manifests(spark, _manifest_files(spark, folder))
        return entries.select("source_id", "source_label", "reviewed").unionByName(
            errors.select(F.expr(_FILE).alias("doc"), "error"), allowMissingColumns=True)

    state_error = _ERRORS.format("doc", "state_id is missing")

    @catalog.add("state_files", f"""
        WITH e AS (SELECT CAST(s_suppkey AS BIGINT) + 10000 AS doc, 'ST-' || (s_suppkey % 40) AS state_id, s_name AS name,
          CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(DATE '2026-01-01' + CAST(s_suppkey % 200 AS INT) AS DATE) END AS claims_end FROM supplier)
        SELECT state_id, name, claims_end, CAST(NULL AS BIGINT) AS doc, CAST(NULL AS VARCHAR) AS error FROM
          (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY doc DESC) AS rn FROM e WHERE {state_error} IS NULL) WHERE rn = 1
        UNION ALL SELECT NULL, NULL, NULL, doc, {state_error} FROM e WHERE {state_error} IS NOT NULL""")
    def state_files(spark, folder):
        states, errors = readers.read_checked_states(spark, _state_files(spark, folder))
        return states.select("state_id", "name", "sir_schedule.claims_end").unionByName(
            errors.select(F.expr(_FILE).alias("doc"), "error"), allowMissingColumns=True)

    columns = "serial_number, house_number, voter_name, relation_type, relative_name, gender, age, epic_number"
    stamped_sql = f"WITH {RECORDS_SQL}, {DOCUMENTS_SQL}, st AS (SELECT r.*, state_code, ac_number, part_number, revision_year AS year FROM records r JOIN docs d ON r.doc_id = d.doc_id)"

    @catalog.add("export_json", f"{stamped_sql} SELECT doc_id, page_no, line_no, {columns}, data_quality, ac_number, part_number, year FROM st")
    def export_json(spark, folder):
        path = scratch_path(spark, "json-export")
        stamped = stamp_documents(roll_lines(spark, folder), documents(spark, folder))
        writers.export_json(stamped, path, _records)
        kinds = {f.name: f.dataType.simpleString() for f in _records(stamped).schema.fields}
        wanted = ["doc_id", "page_no", "line_no", *columns.split(", "), "data_quality"]
        back = spark.read.schema(", ".join(f"{c} {kinds[c]}" for c in [*wanted, "ac_number", "part_number", "year"])).json(path)
        return back.select(*wanted, "ac_number", "part_number", "year")

    @catalog.add("export_csv", f"""{stamped_sql} SELECT {", ".join(f"nullif({c}, '') AS {c}" if c.endswith(("_name", "_number", "gender")) and c != "serial_number" else c for c in columns.split(", "))},
        data_quality, printf('ac%03d_part%03d_%d', ac_number, part_number, year) AS file FROM st""")
    def export_csv(spark, folder):
        path = scratch_path(spark, "csv-export")
        rows = _stamped(spark, folder)
        writers.export_csv(rows, path)
        # In the order of the file's columns; an empty text comes back as NULL.
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        held = [c for c in writers.EXPORT_COLUMNS if c in kinds]
        back = spark.read.schema(", ".join(f"{c} {kinds[c]}" for c in held) + ", file string").option("header", True).csv(path)
        return back.select(*columns.split(", "), "data_quality", "file")

    @catalog.add("export_enriched", "SELECT o_orderkey, voter_name_dev, voter_name_en FROM (" + catalog.sql["name_enrich"] + ")")
    def export_enriched(spark, folder):
        path = scratch_path(spark, "enriched-export")
        name = f"concat({glyph_name('o_custkey')}, ' ', o_orderkey % 97, ' ', {glyph_name('o_orderkey')})"
        writers.export_enriched(table(spark, folder, "orders").selectExpr("o_orderkey", f"{name} AS voter_name", "voter_name AS relative_name"), path)
        return spark.read.schema("o_orderkey bigint, voter_name_dev string, voter_name_en string").json(path)

    @catalog.add("search_record_files", """
        SELECT 'ST-' || c_nationkey AS state_id, CAST(c_nationkey AS INT) AS ac_number, CAST(c_custkey AS INT) AS serial_number, c_name AS name, c_acctbal AS confidence,
          CASE WHEN c_custkey % 5 > 1 THEN right(c_name, 4) END AS epic_last4 FROM customer""")
    def search_record_files(spark, folder):
        rows = table(spark, folder, "customer").selectExpr(
            "CAST(c_nationkey AS BIGINT) AS doc", "concat('ST-', c_nationkey) AS state_id", "CAST(c_nationkey AS INT) AS ac_number", "CAST(c_custkey AS INT) AS serial_number",
            "c_name AS name", "c_acctbal AS confidence", "CASE WHEN c_custkey % 5 > 1 THEN right(c_name, 4) END AS epic_last4")
        kept = [c for c in rows.columns if c != "doc"]
        docs = rows.groupBy("doc").agg(F.to_json(F.collect_list(F.struct(*kept))).alias("value"))
        return readers.read_search_records(spark, _written(spark, docs, "search-records")).select(*kept)

    # Files of text, of bytes that are no text, and of blocked names; checksums of their bytes.
    kind = "CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.bin' WHEN 2 THEN '.txt' WHEN 3 THEN '.pem' ELSE '.py' END"
    data = "CASE WHEN doc_id % 5 = 1 THEN concat(substr(coalesce(text, ''), 1, 30), chr(0), 'x') ELSE coalesce(text, '') END"

    def file_rows(spark, folder):
        return table(spark, folder, "documents").selectExpr(f"concat('docs/', doc_id, {kind}) AS path", f"encode({data}, 'UTF-8') AS content", "doc_id")

    @catalog.add("file_routing", f"""
        SELECT 'docs/' || doc_id || {kind} AS path, CASE doc_id % 5 WHEN 1 THEN 'binary candidate' WHEN 3 THEN 'blocked path' END AS finding FROM documents WHERE doc_id % 5 IN (1, 3)""")
    def file_routing(spark, folder):
        return scan.path_scan(file_rows(spark, folder), "path", "content").select("path", "finding")

    @catalog.add("file_lists", f"SELECT DISTINCT 'docs/' || doc_id || {kind} AS path FROM documents")
    def file_lists(spark, folder):
        rows = file_rows(spark, folder)
        return scan.candidate_files(rows.where("doc_id % 3 < 2"), rows.where("doc_id % 2 = 0 OR doc_id % 3 = 2"))

    @catalog.add("file_checksums", "SELECT CAST(c_nationkey AS BIGINT) AS doc, 'sha256:' || sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS checksum, CAST(sum(length(c_name) + 1) AS BIGINT) AS bytes FROM customer GROUP BY 1")
    def file_checksums(spark, folder):
        rows = table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("doc")).agg(
            F.array_join(F.array_sort(F.collect_list("c_name")), "\n").alias("value"))
        found = readers.checksums(spark, _written(spark, rows, "checked-files"), glob="*.txt")
        local = F.col("source_uri").startswith("local:///") & F.col("source_uri").endswith(".txt")
        return found.where(local).withColumn("file", F.col("path")).select(F.expr(_FILE).alias("doc"), "checksum", "bytes")
