"""Parsed documents and records to the six relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollweave.functions.rules import messages, missing
from rollweave.functions.text import (
    blank_to_null, fingerprint, normalize_name, stable_id, strip, zero_to_null,
)

# Defaults of a registered document.
PARSER = "parse_2002"
DEFAULTS = {
    "roll_kind": "historical_base_roll",
    "language": "mr",
    "source_label": "Local dry-run PDF",
    "parser_name": PARSER,
    "parser_hint": PARSER,
}


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def stamp_documents(voters: DataFrame, documents: DataFrame) -> DataFrame:
    """Records with their document's state code, constituency, part and year. Spark
    broadcasts the document side when its size allows; otherwise AQE splits a hot document."""
    stamps = documents.select(
        "doc_id", "state_code", "ac_number", "part_number", F.col("revision_year").alias("year")
    )
    return voters.join(stamps, "doc_id")


def flag_summary(voters: DataFrame, by: str = "doc_id") -> DataFrame:
    """Rows per (document, flag): combined flags are split, blanks count as ``ok``."""
    quality = F.coalesce(blank_to_null(F.col("data_quality")), F.lit("ok"))
    # Counting whole strings first leaves few rows to split.
    whole = voters.groupBy(by, quality.alias("_q")).agg(F.count("*").alias("_n"))
    flags = whole.select(by, F.explode(F.split("_q", ",")).alias("_f"), "_n")
    flag = F.coalesce(blank_to_null(strip(F.col("_f"))), F.lit("ok"))
    return flags.groupBy(by, flag.alias("flag")).agg(F.sum("_n").alias("records"))


def flag_maps(summary: DataFrame, by: str = "doc_id") -> DataFrame:
    """One sorted map per document from :func:`flag_summary` (a handful of flags each)."""
    return summary.groupBy(by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "records")))).alias("quality_summary")
    )


def parse_stats(voters: DataFrame, by: str = "doc_id") -> DataFrame:
    """Counts, id coverage, age range and section count per document. Ages that are NULL
    are left out of the age figures."""
    return voters.groupBy(by).agg(
        F.count("*").alias("parsed"),
        F.count_if(F.col("gender") == "M").alias("males"),
        F.count_if(F.col("gender") == "F").alias("females"),
        F.count_if(F.col("epic_number") != "").alias("with_id"),
        F.round(100.0 * F.count_if(F.col("epic_number") != "") / F.count("*"), 1).alias("with_id_percent"),
        F.min("age").alias("min_age"),
        F.max("age").alias("max_age"),
        F.round(F.avg("age"), 1).alias("avg_age"),
        F.count_distinct("section_number").alias("sections"),
    )


def reconcile(documents: DataFrame, voters: DataFrame) -> DataFrame:
    """Documents with expected and parsed counts and the messages that block ingestion.

    The record side is counted per document before the join, so only one row per document
    is shuffled to it.
    """
    parsed = voters.groupBy("doc_id").agg(F.count("*").alias("_n"))
    counted = documents.join(parsed, "doc_id", "left").withColumn(
        "parsed_records", F.coalesce("_n", F.lit(0)).cast("int")
    ).drop("_n")
    total = zero_to_null(F.col("total_voters"))
    counted = counted.withColumn("expected_records", F.coalesce(total, F.col("parsed_records")).cast("int"))
    roll_year = F.coalesce(
        zero_to_null(_or_null(counted, "roll_year", "int")), F.col("revision_year"), F.lit(0)
    )
    failures = F.coalesce(_or_null(counted, "parser_failures", "int"), F.lit(0))
    expected_sum = _or_null(counted, "expected_checksum")
    return counted.withColumn("roll_year", roll_year).withColumn(
        "blockers",
        messages([
            (~missing(expected_sum) & (F.coalesce("checksum", F.lit("")) != expected_sum),
             "local PDF checksum does not match expected source manifest checksum"),
            (failures > 0,
             F.concat(F.lit("parser reported "), failures.cast("string"), F.lit(" failure(s)"))),
            (F.col("roll_year") <= 0,
             "roll year is required when parser metadata does not include revision_year"),
            (F.col("expected_records") != F.col("parsed_records"),
             F.concat(F.lit("parsed record count mismatch: expected "),
                      F.col("expected_records").cast("string"), F.lit(", got "),
                      F.col("parsed_records").cast("string"))),
            (missing(F.col("checksum")), "source document checksum is required before ingestion"),
            (missing(F.col("source_uri")), "source document URI is required before ingestion"),
        ]),
    )


def split_reconciled(reconciled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents; a bad document is a row, not a failed job."""
    blocked = F.size("blockers") > 0
    return reconciled.where(~blocked).drop("blockers"), reconciled.where(blocked)


def document_ids(accepted: DataFrame) -> DataFrame:
    """Accepted documents with the five derived identifiers."""
    c = F.col
    filled = accepted
    for name, value in DEFAULTS.items():
        filled = filled.withColumn(name, F.coalesce(_or_null(filled, name), F.lit(value)))
    srcdoc = stable_id("srcdoc", c("state_id"), c("checksum"))
    return filled.select(
        "*",
        stable_id("roll", c("state_id"), c("roll_year"), c("roll_kind"), c("language"),
                  c("ac_number"), c("part_number")).alias("roll_version_id"),
        srcdoc.alias("source_document_id"),
        stable_id("ac", c("state_id"), c("ac_number")).alias("ac_id"),
        stable_id("ps", c("state_id"), c("ac_number"), c("part_number")).alias("polling_station_id"),
        stable_id("extract", srcdoc, c("parser_name"), c("parsed_records")).alias("extraction_run_id"),
    )


def fan_out(
    accepted: DataFrame, voters: DataFrame, salt: str, finished_at: Column | None = None
) -> dict[str, DataFrame]:
    """The six row sets of a load. Raw identifiers are dropped as soon as they are hashed.

    ``salt`` comes from the caller's configuration; an empty one is refused.
    """
    if not salt:
        raise ValueError("a hash salt is required for ingestion")
    docs = document_ids(accepted)
    c = F.col
    null = F.lit(None)
    flags = flag_maps(flag_summary(voters))
    finished = F.current_timestamp() if finished_at is None else finished_at
    records = voters.join(
        docs.select("doc_id", "roll_version_id", "state_id", "ac_id", "polling_station_id",
                    "ac_number", "part_number"), "doc_id",
    ).withColumn("_id", fingerprint(c("epic_number"), F.lit(salt)))
    return {
        "assembly_constituencies": docs.select(
            "ac_id", "state_id", null.cast("string").alias("district_id"), "ac_number",
            F.coalesce(blank_to_null(c("ac_name_encoded")),
                       F.concat(F.lit("AC "), c("ac_number").cast("string"))).alias("name"),
            blank_to_null(c("ac_reservation_encoded")).alias("reservation_status"),
        ),
        "polling_stations": docs.select(
            "polling_station_id", "ac_id", "part_number",
            blank_to_null(c("polling_station_name_encoded")).alias("name"),
            null.cast("string").alias("address_redacted"), null.cast("date").alias("source_updated_at"),
        ),
        "roll_versions": docs.select(
            "roll_version_id", "state_id", "roll_year", "roll_kind", "language", "source_label",
            _or_null(docs, "source_url").alias("source_url"),
        ),
        "source_documents": docs.select(
            "source_document_id", "state_id", "roll_version_id", "source_uri",
            _or_null(docs, "local_path").alias("local_path"), "checksum", "parser_hint",
            F.lit("registered").alias("status"),
        ),
        "extraction_runs": docs.join(flags, "doc_id", "left").select(
            "extraction_run_id", "source_document_id", "parser_name", "expected_records",
            "parsed_records",
            F.coalesce(F.to_json("quality_summary"), F.lit("{}")).alias("quality_summary"),
            F.lit("validated").alias("status"), finished.alias("finished_at"),
        ),
        "voter_records": records.select(
            stable_id("voter", c("roll_version_id"), c("ac_number"), c("part_number"),
                      c("serial_number")).alias("voter_record_id"),
            "roll_version_id", "state_id", "ac_id", "polling_station_id", "serial_number",
            F.coalesce("voter_name", F.lit("")).alias("name_original"),
            normalize_name(c("voter_name")).alias("name_normalized"),
            null.cast("string").alias("name_phonetic"),
            blank_to_null(c("relation_type")).alias("relation_type"),
            normalize_name(c("relative_name")).alias("relative_name_normalized"),
            "age", blank_to_null(c("gender")).alias("gender"),
            c("_id.hash").alias("epic_hash"), c("_id.last4").alias("epic_last4"),
            F.coalesce(blank_to_null(c("data_quality")), F.lit("ok")).alias("data_quality"),
            F.lit(1).cast("decimal(4,3)").alias("source_confidence"),
        ),
    }


def load_summary(accepted: DataFrame) -> DataFrame:
    """One report row per document: counts and checksum, no record values."""
    one = F.lit(1)
    return accepted.select(
        "doc_id", "state_id", "roll_year", "ac_number", "part_number",
        F.col("checksum").alias("source_checksum"), "expected_records", "parsed_records",
        F.struct(
            one.alias("assembly_constituencies"), one.alias("polling_stations"),
            one.alias("roll_versions"), one.alias("source_documents"),
            one.alias("extraction_runs"), F.col("parsed_records").alias("voter_records"),
        ).alias("row_counts"),
    )
