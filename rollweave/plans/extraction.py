"""Extraction of roll-like pages built from orders, and of cover pages built from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollweave.functions import layout
from rollweave.operators import cover, ingest, lines
from rollweave.plans import Catalog, table
from rollweave.plans.standins import (
    COVER, DOC, PAGE, PAGES_SQL, SECOND, SECTION_NAME, SECTION_NUMBER, SUMMARY,
    cover_pages, page_text,
)
from rollweave.session import stage

LINES_SQL = f"""
    pages AS ({PAGES_SQL}),
    ends AS (SELECT doc_id, min(page_no) AS f, max(page_no) AS l FROM pages GROUP BY doc_id),
    cut AS (SELECT p.doc_id, page_no, string_split(text, chr(10)) AS a FROM pages p JOIN ends e ON p.doc_id = e.doc_id WHERE page_no > f AND page_no < l),
    raw AS (SELECT doc_id, page_no, generate_subscripts(a, 1) - 1 AS line_no, trim(unnest(a)) AS line FROM cut),
    lines AS (SELECT * FROM raw WHERE line <> '')"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_A, _H, _R = _q(layout.ANCHOR), _q(layout.HEAD), _q(layout.RELATION)
RECORDS_SQL = LINES_SQL + f""",
    m AS (SELECT doc_id, page_no, line_no, line, regexp_extract(line, {_A}, 0) AS an, regexp_extract(line, {_H}, 0) AS hd FROM lines),
    mid AS (SELECT *, trim(CASE WHEN length(line) - length(an) > length(hd) THEN substring(line, length(hd) + 1, length(line) - length(an) - length(hd)) ELSE '' END) AS middle,
                   CAST(regexp_extract(line, {_A}, 2) AS INT) AS yrs FROM m WHERE an <> '' AND hd <> ''),
    rel AS (SELECT *, regexp_extract(middle, {_R}, 0) AS mk, CASE WHEN yrs BETWEEN -1 AND 130 THEN yrs END AS age FROM mid),
    named AS (SELECT doc_id, page_no, line_no, line, CAST(regexp_extract(line, {_H}, 1) AS INT) AS serial_number, regexp_extract(line, {_H}, 2) AS house_number,
        CASE WHEN mk <> '' THEN trim(substring(middle, 1, strpos(middle, mk) - 1)) ELSE middle END AS voter_name,
        CASE WHEN mk = '' THEN 'unknown' WHEN trim(mk) = '{{É' THEN 'husband' ELSE 'father' END AS relation_type,
        CASE WHEN mk <> '' THEN trim(substring(middle, strpos(middle, mk) + length(mk))) ELSE '' END AS relative_name,
        CASE WHEN regexp_extract(line, {_A}, 1) = '{{ÉÖ' THEN 'M' ELSE 'F' END AS gender, age,
        CASE WHEN regexp_matches(an, {_q(layout.FULL_ID)}) THEN regexp_extract(an, {_q(layout.FULL_ID)}, 0)
             WHEN regexp_matches(an, {_q(layout.SPLIT_ID)}) THEN regexp_extract(an, {_q(layout.SPLIT_ID)}, 1) ||
                  CASE WHEN length(regexp_extract(an, {_q(layout.SPLIT_ID)}, 2) || regexp_extract(an, {_q(layout.SPLIT_ID)}, 3)) >= 7
                       THEN regexp_extract(an, {_q(layout.SPLIT_ID)}, 2) || regexp_extract(an, {_q(layout.SPLIT_ID)}, 3)
                       ELSE lpad(regexp_extract(an, {_q(layout.SPLIT_ID)}, 2) || regexp_extract(an, {_q(layout.SPLIT_ID)}, 3), 7, '0') END
             ELSE '' END AS epic_number FROM rel),
    records AS (SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN voter_name = '' THEN 'truncated_line' END,
        CASE WHEN age IS NULL THEN 'corrupt_age' WHEN age IN (0, -1) THEN 'missing_age' WHEN age < 17 THEN 'underage' END), ''), 'ok') AS data_quality FROM named)""".replace("{{", "{")

# Section lines by construction: number, blank, three characters four times each.
SECTIONS_SQL = f"""
    secs AS (SELECT l.doc_id, l.page_no, l.line_no, {SECTION_NUMBER} AS section_number, {SECTION_NAME} AS section_name
             FROM lines l JOIN orders o ON l.doc_id = {DOC} AND l.page_no = {PAGE} WHERE o_orderkey % 8 = 1 AND l.line_no = 1)"""

# A position that orders lines of a document.
_AT = "page_no * 1000 + line_no"
CARRIED_SQL = RECORDS_SQL + "," + SECTIONS_SQL + f""",
    marks AS (SELECT doc_id, {_AT} AS pos, section_number, section_name FROM secs),
    carried AS (SELECT r.*, coalesce(s.section_number, 0) AS section_number, coalesce(s.section_name, '') AS section_name
        FROM (SELECT *, {_AT} AS pos FROM records) r ASOF LEFT JOIN marks s ON r.doc_id = s.doc_id AND r.pos >= s.pos),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, serial_number ORDER BY pos) AS rn FROM carried) WHERE rn = 1)"""

VOTER_COLUMNS = (
    "doc_id, page_no, line_no, serial_number, house_number, voter_name, relation_type, relative_name, "
    "gender, age, epic_number, data_quality"
)
# Documents of the same orders, as the cover of each would report them.
DOCUMENTS_SQL = f"""
    docs AS (SELECT {DOC} AS doc_id, 'ST-' || ({DOC} % 3) AS state_id, CASE WHEN {DOC} % 10 = 3 THEN 0 ELSE 2002 END AS revision_year,
        'S' || ({DOC} % 3) AS state_code, CAST({DOC} % 288 AS INT) AS ac_number, CAST({DOC} % 40 + 1 AS INT) AS part_number,
        CASE {DOC} % 4 WHEN 0 THEN 0 WHEN 1 THEN 70 ELSE 67 END AS total_voters,
        CASE WHEN {DOC} % 5 = 0 THEN '' ELSE 'AC ' || max(o_orderpriority) END AS ac_name_encoded,
        '' AS ac_reservation_encoded, 'School ' || min(o_orderstatus) AS polling_station_name_encoded,
        CASE WHEN {DOC} % 17 = 5 THEN '' ELSE 'sha256:' || sha256(CAST(min(o_orderkey) AS VARCHAR)) END AS checksum,
        'local://rolls/' || {DOC} AS source_uri
      FROM orders GROUP BY {DOC})"""


def documents(spark, folder):
    d = F.col("doc_id")
    grouped = table(spark, folder, "orders").withColumn("doc_id", F.expr(DOC)).groupBy("doc_id").agg(
        F.max("o_orderpriority").alias("p"), F.min("o_orderstatus").alias("s"), F.min("o_orderkey").alias("k")
    )
    return grouped.select(
        "doc_id", F.concat(F.lit("ST-"), d % 3).alias("state_id"),
        F.when(d % 10 == 3, 0).otherwise(2002).alias("revision_year"),
        F.concat(F.lit("S"), d % 3).alias("state_code"),
        (d % 288).cast("int").alias("ac_number"), (d % 40 + 1).cast("int").alias("part_number"),
        F.when(d % 4 == 0, 0).when(d % 4 == 1, 70).otherwise(67).alias("total_voters"),
        F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("AC "), "p")).alias("ac_name_encoded"),
        F.lit("").alias("ac_reservation_encoded"),
        F.concat(F.lit("School "), "s").alias("polling_station_name_encoded"),
        F.when(d % 17 == 5, "").otherwise(F.concat(F.lit("sha256:"), F.sha2(F.col("k").cast("string"), 256))).alias("checksum"),
        F.concat(F.lit("local://rolls/"), d).alias("source_uri"),
    )


def roll_lines(spark, folder):
    return lines.page_lines(page_text(spark, folder))


def voters(spark, folder):
    return lines.extract_voters(roll_lines(spark, folder), staged=True)


RECONCILED_SQL = CARRIED_SQL + "," + DOCUMENTS_SQL + """,
    parsed AS (SELECT doc_id, count(*) AS n FROM firsts GROUP BY doc_id),
    rec AS (SELECT d.*, coalesce(n, 0) AS parsed_records, coalesce(nullif(total_voters, 0), coalesce(n, 0)) AS expected_records,
            list_filter([CASE WHEN revision_year <= 0 THEN 'roll year is required when parser metadata does not include revision_year' END,
              CASE WHEN coalesce(nullif(total_voters, 0), coalesce(n, 0)) <> coalesce(n, 0) THEN 'parsed record count mismatch: expected ' || total_voters || ', got ' || coalesce(n, 0) END,
              CASE WHEN checksum = '' THEN 'source document checksum is required before ingestion' END], lambda x: x IS NOT NULL) AS blockers
            FROM docs d LEFT JOIN parsed p ON d.doc_id = p.doc_id),
    acc AS (SELECT * FROM rec WHERE len(blockers) = 0)"""

SALT = "test-salt"


def _sid(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substring(sha256(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 24)"


_IDS = {
    "roll_version_id": _sid("roll", "state_id", "revision_year", "'historical_base_roll'", "'mr'", "ac_number", "part_number"),
    "source_document_id": _sid("srcdoc", "state_id", "checksum"),
    "ac_id": _sid("ac", "state_id", "ac_number"),
    "polling_station_id": _sid("ps", "state_id", "ac_number", "part_number"),
}
IDS_SQL = RECONCILED_SQL + ", ids AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _IDS.items()) + " FROM acc)"


def batch(spark, folder):
    """The six row sets; the run's finishing time is fixed so results can be compared."""
    # Counted, flagged and joined: three uses.
    people = stage(voters(spark, folder), "voters")
    accepted, _ = ingest.split_reconciled(ingest.reconcile(documents(spark, folder), people))
    return ingest.fan_out(accepted, people, SALT, F.lit("2026-01-01 00:00:00").cast("timestamp"))


def register(catalog: Catalog) -> None:
    @catalog.add("page_lines", f"WITH {LINES_SQL} SELECT * FROM lines")
    def page_lines(spark, folder):
        return roll_lines(spark, folder)

    @catalog.add("document_lines", """
        WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
        raw AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, trim(unnest(a), ' ' || chr(9) || chr(13)) AS line FROM cut)
        SELECT doc_id, count(*) AS lines, sum(length(line)) AS chars, max(line_no) AS last_line FROM raw WHERE line <> '' GROUP BY doc_id""")
    def document_lines(spark, folder):
        docs = table(spark, folder, "documents").selectExpr("doc_id", "2 AS page_no", "3 AS page_count", "text")
        return lines.page_lines(docs).groupBy("doc_id").agg(
            F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.max("line_no").alias("last_line")
        )

    @catalog.add("line_extract", f"WITH {RECORDS_SQL} SELECT {VOTER_COLUMNS}, line FROM records")
    def line_extract(spark, folder):
        return lines.extract_records(roll_lines(spark, folder))

    @catalog.add("id_repair", f"WITH {RECORDS_SQL} SELECT doc_id, page_no, line_no, epic_number FROM records WHERE epic_number <> ''")
    def id_repair(spark, folder):
        ls = roll_lines(spark, folder).where(lines.is_record(F.col("line")))
        tail = F.regexp_extract("line", layout.LEGACY_2002.anchor, 0)
        return ls.select("doc_id", "page_no", "line_no", lines.repair_id(tail).alias("epic_number")).where("epic_number <> ''")

    @catalog.add("quality_flags", f"WITH {RECORDS_SQL} SELECT data_quality, count(*) AS records, count(age) AS with_age FROM records GROUP BY data_quality")
    def quality_flags(spark, folder):
        return lines.extract_records(roll_lines(spark, folder)).groupBy("data_quality").agg(
            F.count("*").alias("records"), F.count("age").alias("with_age"))

    @catalog.add("section_lines", f"WITH {LINES_SQL}, {SECTIONS_SQL} SELECT * FROM secs")
    def section_lines(spark, folder):
        return lines.section_headers(roll_lines(spark, folder)).drop("line")

    @catalog.add("section_carry", f"WITH {CARRIED_SQL} SELECT {VOTER_COLUMNS}, section_number, section_name FROM carried")
    def section_carry(spark, folder):
        return lines.carry_sections(roll_lines(spark, folder))

    @catalog.add("first_per_key", f"WITH {CARRIED_SQL} SELECT {VOTER_COLUMNS}, section_number, section_name FROM firsts")
    def first_per_key(spark, folder):
        return voters(spark, folder)

    @catalog.add("section_map", f"""
        WITH {LINES_SQL}, {SECTIONS_SQL},
        last AS (SELECT doc_id, section_number, arg_max(section_name, {_AT}) AS section_name FROM secs GROUP BY 1, 2)
        SELECT doc_id, string_agg(section_number || '=' || section_name, ';' ORDER BY section_number) AS sections FROM last GROUP BY doc_id""")
    def section_map(spark, folder):
        maps = lines.section_map(lines.section_headers(roll_lines(spark, folder)))
        pairs = F.transform(F.map_entries("sections"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
        return maps.select("doc_id", F.array_join(pairs, ";").alias("sections"))

    @catalog.add("stamp_doc", f"""
        WITH {RECORDS_SQL}, {DOCUMENTS_SQL}
        SELECT r.doc_id, page_no, line_no, serial_number, state_code, ac_number, part_number, revision_year AS year FROM records r JOIN docs d ON r.doc_id = d.doc_id""")
    def stamp_doc(spark, folder):
        recs = lines.extract_records(roll_lines(spark, folder)).select("doc_id", "page_no", "line_no", "serial_number")
        return ingest.stamp_documents(recs, documents(spark, folder))

    @catalog.add("parse_stats", f"""
        WITH {CARRIED_SQL}
        SELECT doc_id, count(*) AS parsed, count(*) FILTER (WHERE gender = 'M') AS males, count(*) FILTER (WHERE gender = 'F') AS females,
          count(*) FILTER (WHERE epic_number <> '') AS with_id, round(100.0 * count(*) FILTER (WHERE epic_number <> '') / count(*), 1) AS with_id_percent,
          min(age) AS min_age, max(age) AS max_age, round(avg(age), 1) AS avg_age, count(DISTINCT section_number) AS sections
        FROM firsts GROUP BY doc_id""")
    def parse_stats(spark, folder):
        return ingest.parse_stats(voters(spark, folder))

    @catalog.add("flag_summary", f"""
        WITH {RECORDS_SQL}, f AS (SELECT doc_id, unnest(string_split(data_quality, ',')) AS flag FROM records)
        SELECT doc_id, flag, count(*) AS records FROM f GROUP BY 1, 2""")
    def flag_summary(spark, folder):
        return ingest.flag_summary(lines.extract_records(roll_lines(spark, folder)))

    @catalog.add("count_reconcile", f"""
        WITH {RECONCILED_SQL} SELECT doc_id, expected_records, parsed_records, array_to_string(blockers, '; ') AS blockers FROM rec""")
    def count_reconcile(spark, folder):
        done = ingest.reconcile(documents(spark, folder), voters(spark, folder))
        return done.select("doc_id", "expected_records", "parsed_records", F.array_join("blockers", "; ").alias("blockers"))

    fanned = {
        "assembly_constituencies": "ac_id, state_id, CAST(NULL AS VARCHAR) AS district_id, ac_number, coalesce(nullif(ac_name_encoded, ''), 'AC ' || ac_number) AS name, nullif(ac_reservation_encoded, '') AS reservation_status",
        "polling_stations": "polling_station_id, ac_id, part_number, nullif(polling_station_name_encoded, '') AS name, CAST(NULL AS VARCHAR) AS address_redacted, CAST(NULL AS DATE) AS source_updated_at",
        "roll_versions": "roll_version_id, state_id, revision_year AS roll_year, 'historical_base_roll' AS roll_kind, 'mr' AS language, 'Local dry-run PDF' AS source_label, CAST(NULL AS VARCHAR) AS source_url",
        "source_documents": "source_document_id, state_id, roll_version_id, source_uri, CAST(NULL AS VARCHAR) AS local_path, checksum, 'parse_2002' AS parser_hint, 'registered' AS status",
    }
    for name, columns in fanned.items():
        catalog.add(f"fanout_{name}", f"WITH {IDS_SQL} SELECT {columns} FROM ids")(
            lambda spark, folder, name=name: batch(spark, folder)[name]
        )

    @catalog.add("fanout_extraction_runs", f"""
        WITH {IDS_SQL}, f AS (SELECT doc_id, unnest(string_split(data_quality, ',')) AS flag FROM firsts),
        n AS (SELECT doc_id, flag, count(*) AS c FROM f GROUP BY 1, 2),
        q AS (SELECT doc_id, '{{' || string_agg('"' || flag || '":' || c, ',' ORDER BY flag) || '}}' AS js FROM n GROUP BY doc_id)
        SELECT {_sid('extract', 'source_document_id', "'parse_2002'", 'parsed_records')} AS extraction_run_id, source_document_id, 'parse_2002' AS parser_name,
          expected_records, parsed_records, coalesce(js, '{{}}') AS quality_summary, 'validated' AS status, TIMESTAMP '2026-01-01 00:00:00' AS finished_at
        FROM ids LEFT JOIN q ON ids.doc_id = q.doc_id""")
    def fanout_extraction_runs(spark, folder):
        return batch(spark, folder)["extraction_runs"]

    norm = "trim(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), 'µ', 'μ'), '\\s+', ' ', 'g'))"

    @catalog.add("fanout_voter_records", f"""
        WITH {IDS_SQL}
        SELECT {_sid('voter', 'roll_version_id', 'ac_number', 'part_number', 'serial_number')} AS voter_record_id, roll_version_id, state_id, ac_id, polling_station_id, serial_number,
          voter_name AS name_original, {norm.format('voter_name')} AS name_normalized, CAST(NULL AS VARCHAR) AS name_phonetic, relation_type, {norm.format('relative_name')} AS relative_name_normalized,
          age, gender, CASE WHEN epic_number <> '' THEN sha256('{SALT}:' || upper(epic_number)) END AS epic_hash, CASE WHEN epic_number <> '' THEN right(upper(epic_number), 4) END AS epic_last4,
          data_quality, 1.0 AS source_confidence
        FROM firsts v JOIN ids i ON v.doc_id = i.doc_id""")
    def fanout_voter_records(spark, folder):
        return batch(spark, folder)["voter_records"]

    @catalog.add("load_summary", f"""
        WITH {RECONCILED_SQL} SELECT doc_id, state_id, revision_year AS roll_year, ac_number, part_number, checksum AS source_checksum, expected_records, parsed_records, parsed_records AS voter_rows FROM acc""")
    def load_summary(spark, folder):
        accepted, _ = ingest.split_reconciled(ingest.reconcile(documents(spark, folder), voters(spark, folder)))
        return ingest.load_summary(accepted).withColumn("voter_rows", F.col("row_counts.voter_records")).drop("row_counts")

    # -- cover pages ------------------------------------------------------------------
    spec = {f[0]: f for f in layout.COVER_FIELDS}

    def field(name: str) -> str:
        _, pattern, group, kind, prefix = spec[name]
        pattern = pattern.replace("{ÉkÉÉ", "\\{ÉkÉÉ").replace("iÉ{É", "iÉ\\{É").replace("õ{É", "õ\\{É")
        got = f"regexp_extract(full_text, {_q(prefix.replace('d', '') + pattern)}, {group})"
        if kind == "int":
            return f"coalesce(CAST(nullif({got}, '') AS INT), 0)"
        if kind == "words":
            return f"trim(regexp_replace({got}, '\\s+', ' ', 'g'))"
        if kind == "address":
            return (f"array_to_string(list_filter(list_transform(string_split({got}, chr(10)), lambda s: trim(s)), "
                    f"lambda s: s <> '' AND s <> '{layout.ADDRESS_NOISE}'), ' ')")
        return f"trim({got})"

    ints = lambda m: f"list_transform(string_split_regex({m}, '\\s+'), lambda s: CAST(s AS INT))"
    five = lambda t: (f"list_filter(list_transform(regexp_extract_all({t}, {_q(layout.COUNTS_FIVE)}, 0), lambda m: {ints('m')}), "  # noqa: E731
                      "lambda r: r[3] + r[4] = r[5] AND r[5] > 50 AND r[1] = 1)[1]")
    three = lambda t: (f"list_filter(list_transform(regexp_extract_all({t}, {_q(layout.COUNTS_THREE)}, 0), lambda m: {ints('m')}), "  # noqa: E731
                       "lambda r: r[1] + r[2] = r[3] AND r[3] > 50)[1]")
    # Lines stripped; no run of four equal characters occurs in this plain text.
    docs_sql = f"""
        WITH d AS (SELECT c_custkey AS doc_id, array_to_string(list_transform(string_split({COVER}, chr(10)), lambda s: trim(s)), chr(10)) AS full_text,
                          {SECOND} AS second_text, {SUMMARY} AS last_text FROM customer),
        n AS (SELECT *,
                     {five('full_text')} AS f1, {five('last_text')} AS f2, {three('last_text')} AS t2, {three('full_text')} AS t1 FROM d),
        c AS (SELECT *, CASE WHEN f1 IS NOT NULL THEN f1 WHEN f2 IS NOT NULL THEN f2 WHEN t2 IS NOT NULL THEN list_concat([0, 0], t2)
                     WHEN t1 IS NOT NULL THEN list_concat([0, 0], t1) ELSE [0, 0, 0, 0, 0] END AS cnt FROM n)"""
    counts_sql = ", ".join(f"cnt[{i}] AS {n}" for i, n in enumerate(cover.COUNT_FIELDS, 1))
    plain = [n for n in spec if n not in ("state_code", "ac_number", "ac_name_encoded")]
    block = f"regexp_extract(full_text, {_q('(?s)' + layout.AREA_BLOCK)}, 0)"

    @catalog.add("cover_metadata", docs_sql + f"""
        SELECT doc_id, CASE WHEN {field('state_code')} <> '' THEN 'S' || {field('state_code')} ELSE '' END AS state_code,
          CASE WHEN {field('ac_number')} < 300 THEN {field('ac_number')} ELSE 0 END AS ac_number,
          CASE WHEN {field('ac_number')} < 300 THEN {field('ac_name_encoded')} ELSE '' END AS ac_name_encoded,
          {", ".join(f"{field(n)} AS {n}" for n in plain)},
          coalesce(regexp_extract_all(full_text, {_q(layout.DATE)}, 1)[1], '') AS qualification_date,
          coalesce(regexp_extract_all(full_text, {_q(layout.DATE)}, 1)[2], '') AS publication_date,
          CASE WHEN contains({block}, '{layout.AREA_KINDS[0]}') THEN '{layout.AREA_KINDS[0]}' WHEN contains({block}, '{layout.AREA_KINDS[1]}') THEN '{layout.AREA_KINDS[1]}' ELSE '' END AS area_type_encoded,
          '' AS station_reservation_encoded, '' AS station_category_encoded,
          coalesce(nullif(regexp_extract(full_text, {_q(layout.PINCODE)}, 1), ''), regexp_extract(second_text, {_q(layout.PINCODE)}, 1)) AS pincode,
          {counts_sql} FROM c""")
    def cover_metadata(spark, folder):
        return cover.cover_metadata(cover_pages(spark, folder))

    @catalog.add("count_block", docs_sql + f" SELECT doc_id, {counts_sql} FROM c")
    def count_block(spark, folder):
        texts = table(spark, folder, "customer").selectExpr("c_custkey AS doc_id", f"{COVER} AS t", f"{SUMMARY} AS s")
        got = texts.select("doc_id", cover.count_block(F.col("t"), F.col("s")).alias("c"))
        return got.select("doc_id", "c.*")



