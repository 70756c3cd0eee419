"""Loaded-data summaries and readiness reports, for one scope or for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollweave.functions.rules import messages
from rollweave.operators.search import scoped_records

MAX_ISSUE_RATE = 0.05


def roll_summary(
    roll_versions: DataFrame, documents: DataFrame, runs: DataFrame, by: str | None = None
) -> DataFrame:
    """Document, run and record counts, over all roll versions or per ``by`` (the state).

    The joins are one-to-many chains, so sums are not repeated.
    """
    rv = roll_versions.select("roll_version_id", *([by] if by else []))
    sd = documents.select("source_document_id", "roll_version_id")
    er = runs.select(
        "extraction_run_id", "source_document_id", "status", "expected_records", "parsed_records"
    )
    joined = rv.join(sd, "roll_version_id", "left").join(er, "source_document_id", "left")
    run = F.col("extraction_run_id")
    grouped = joined.groupBy(by) if by else joined.groupBy()
    return grouped.agg(
        F.count_distinct("source_document_id").alias("source_documents"),
        F.count_distinct(run).alias("extraction_runs"),
        F.count_distinct(F.when(F.col("status") == "validated", run)).alias("validated_runs"),
        F.count_distinct(F.when(F.col("status") != "validated", run)).alias("nonvalidated_runs"),
        F.coalesce(F.sum("expected_records"), F.lit(0)).alias("expected_records"),
        F.coalesce(F.sum("parsed_records"), F.lit(0)).alias("parsed_records"),
    )


def _issue_rate(issues: Column, total: Column) -> Column:
    return F.when(total > 0, issues / total).otherwise(0.0)


def voter_summary(voters: DataFrame, acs: DataFrame, stations: DataFrame, state_id: str,
                  ac_number: int, part_number: int | None = None) -> DataFrame:
    """Record, ok and issue counts of one scope."""
    rows = scoped_records(voters, acs, stations, state_id, ac_number, part_number)
    counts = rows.agg(
        F.count("*").alias("voter_records"),
        F.count_if(F.col("data_quality") == "ok").alias("ok_records"),
        F.count_if(F.col("data_quality") != "ok").alias("issue_records"),
    )
    rate = _issue_rate(F.col("issue_records"), F.col("voter_records"))
    return counts.withColumn("quality_issue_rate", F.round(rate, 4))


def quality_breakdown(voters: DataFrame, acs: DataFrame, stations: DataFrame, state_id: str,
                      ac_number: int, part_number: int | None = None) -> DataFrame:
    """Records per whole quality string of one scope, most frequent first."""
    rows = scoped_records(voters, acs, stations, state_id, ac_number, part_number)
    return rows.groupBy("data_quality").agg(F.count("*").alias("count")).orderBy(
        F.col("count").desc(), "data_quality"
    )


def scope_counts(voters: DataFrame, acs: DataFrame, stations: DataFrame, by: str = "ac") -> DataFrame:
    """Quality counts of every scope in one pass.

    Records are counted per (state, constituency, station, quality) before any join, so the
    joins see one row per station and quality instead of one per record.
    """
    cells = voters.groupBy("state_id", "ac_id", "polling_station_id", "data_quality").agg(
        F.count("*").alias("n")
    )
    scoped = cells.join(acs.select("ac_id", "ac_number"), "ac_id").join(
        stations.select("polling_station_id", "part_number"), "polling_station_id", "left"
    )
    keys = ["state_id", "ac_number"]
    if by == "part":
        keys.append("part_number")
        scoped = scoped.where(F.col("part_number").isNotNull())
    # A missing quality is shown as unknown, beside records that say so, but is neither ok nor an issue.
    per_flag = scoped.groupBy(*keys, F.coalesce("data_quality", F.lit("unknown")).alias("flag")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("data_quality").isNotNull(), F.col("n"))).alias("known"))
    ok = F.col("flag") == "ok"
    return per_flag.groupBy(*keys).agg(
        F.sum("n").alias("voter_records"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("ok_records"),
        F.coalesce(F.sum(F.when(~ok, F.col("known"))), F.lit(0)).alias("issue_records"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("quality_summary"),
    )


def _rules(max_issue_rate: float) -> list:
    c = F.col
    return [
        (~F.coalesce(c("public_launch_ready"), F.lit(False)), "state config is not marked public_launch_ready"),
        (F.coalesce(c("schedule_confidence"), F.lit("")) != "official", "schedule provenance is not official"),
        (c("source_documents") == 0, "no source documents loaded"),
        (c("extraction_runs") == 0, "no extraction runs loaded"),
        (c("nonvalidated_runs") > 0, "one or more extraction runs are not validated"),
        (c("expected_records") != c("parsed_records"), "expected and parsed record counts do not match"),
        (c("voter_records") == 0, "no scoped voter records loaded"),
        (c("quality_issue_rate") > max_issue_rate, "data quality issue rate exceeds threshold"),
    ]


def readiness(
    tables: dict[str, DataFrame], states: DataFrame, max_issue_rate: float = MAX_ISSUE_RATE,
    by: str = "ac", scopes: DataFrame | None = None,
) -> DataFrame:
    """One report row per scope. Roll counts belong to the state, record counts to the scope.

    ``scopes(state_id, ac_number[, part_number])`` adds scopes without any record; without it
    every constituency (or part) of the tables is reported. ``states`` is the registry.
    """
    if not 0 <= max_issue_rate <= 1:
        raise ValueError("max_quality_issue_rate must be between 0 and 1")
    keys = ["state_id", "ac_number"] + (["part_number"] if by == "part" else [])
    acs, stations = tables["assembly_constituencies"], tables["polling_stations"]
    counts = scope_counts(tables["voter_records"], acs, stations, by)
    if scopes is None:
        scopes = acs.select("state_id", "ac_id", "ac_number")
        if by == "part":
            scopes = scopes.join(stations.select("ac_id", "part_number"), "ac_id")
        scopes = scopes.select(*keys).distinct()
    rolls = roll_summary(
        tables["roll_versions"], tables["source_documents"], tables["extraction_runs"], by="state_id"
    )
    registry = states.select(
        "state_id", "data_capability", "public_launch_ready", "parser_status",
        F.col("schedule_provenance.confidence").alias("schedule_confidence"), F.lit(True).alias("_known"),
    )
    rows = scopes.join(counts, keys, "left").join(rolls, "state_id", "left").join(registry, "state_id", "left")
    numbers = [
        "voter_records", "ok_records", "issue_records", "source_documents", "extraction_runs",
        "validated_runs", "nonvalidated_runs", "expected_records", "parsed_records",
    ]
    filled = rows.fillna(0, subset=numbers).withColumn(
        "quality_issue_rate", _issue_rate(F.col("issue_records"), F.col("voter_records"))
    )
    unknown = F.array(F.concat(F.lit("unknown state_id: "), F.col("state_id")))
    blockers = F.when(F.col("_known"), messages(_rules(max_issue_rate))).otherwise(unknown)
    return filled.withColumn("blockers", blockers).select(
        *keys, F.lit(True).alias("local_only"), F.lit(False).alias("safe_for_public"),
        (F.size("blockers") == 0).alias("ready_for_public"),
        F.lit(float(max_issue_rate)).alias("max_quality_issue_rate"),
        "data_capability", "public_launch_ready", "parser_status", "schedule_confidence", *numbers,
        F.round("quality_issue_rate", 4).alias("quality_issue_rate"), "quality_summary", "blockers",
    )


def record_audit(records: DataFrame) -> DataFrame:
    """Totals of search records: all, safe to redact, fully scoped."""
    last4 = F.col("epic_last4")
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(last4.isNull() | (last4 == "") | (F.length(last4) == 4)).alias("redaction_ready"),
        F.count_if(F.col("ac_number").isNotNull() & F.col("part_number").isNotNull()).alias("scoped"),
    )
