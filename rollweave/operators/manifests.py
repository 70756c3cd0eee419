"""Source-manifest validation, review and onboarding checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollweave.functions.rules import messages, missing
from rollweave.functions.text import blank_to_null, is_checksum

# Where local files may live and which parser the pipeline has.
LOCAL_ROOTS = ("data", "samples")
PARSER_HINT = "parse_2002"
ENV_NAME = "^[\\p{L}\\p{N}_]*[\\p{L}\\p{N}][\\p{L}\\p{N}_]*$"


def first_segment(path: Column) -> Column:
    """First path part, leading ``./`` left out; NULL when the path has none."""
    clean = F.regexp_replace(path, "^(?:\\./+)+|^\\.$", "")
    return blank_to_null(F.split(clean, "/")[0])


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def _outside(path: Column) -> Column:
    part = first_segment(path)
    return part.isNotNull() & ~part.isin(*LOCAL_ROOTS)


def _field_rules() -> list:
    c = F.col
    path = blank_to_null(c("local_path"))
    absolute = F.coalesce(is_absolute(path), F.lit(False))
    return [
        (~F.coalesce(c("reviewed"), F.lit(False)), "source manifest entry must be reviewed before ingestion"),
        (c("roll_year") <= 0, "roll_year must be positive"),
        (missing(c("source_label")), "source_label is required"),
        (missing(c("source_uri")), "source_uri is required"),
        (~is_checksum(c("checksum")), "checksum must be sha256:<64 lowercase hex>"),
        (path.isNull(), "local_path is required for local ingestion"),
        (absolute, "local_path must be repo-relative"),
        (~absolute & _outside(path), "local_path must stay under ignored data/ or samples/ directories"),
        (F.coalesce(c("parser_hint"), F.lit("")) != PARSER_HINT,
         f"parser_hint must be {PARSER_HINT} for the current local pipeline"),
        (missing(c("language")), "language is required"),
    ]


def field_blockers() -> Column:
    return messages(_field_rules())


def file_blockers(actual: Column) -> Column:
    """Blockers of the local file, from its joined checksum (NULL when there is no file)."""
    path = blank_to_null(F.col("local_path"))
    return messages([
        (path.isNull(), "local_path is required for checksum verification"),
        (path.isNotNull() & actual.isNull(), "local_path file does not exist for checksum verification"),
        (path.isNotNull() & actual.isNotNull() & (actual != F.coalesce("checksum", F.lit(""))),
         "local file checksum does not match source manifest"),
    ])


def _with_files(manifests: DataFrame, files: DataFrame | None) -> DataFrame:
    if files is None:
        return manifests.withColumn("_file", F.array().cast("array<string>")).withColumn("_verified", F.lit(False))
    sums = files.select(F.col("path").alias("local_path"), F.col("checksum").alias("_actual"))
    joined = manifests.join(sums, "local_path", "left").withColumn("_file", file_blockers(F.col("_actual")))
    return joined.withColumn("_verified", F.size("_file") == 0).drop("_actual")


def manifest_blockers(manifests: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Manifest rows with blockers and verdict; ``files(path, checksum)`` adds file checks."""
    return (
        _with_files(manifests, files)
        .withColumn("blockers", F.concat(field_blockers(), F.col("_file")))
        .withColumn("checksum_verified", F.col("_verified"))
        .withColumn("valid_for_ingestion", F.size("blockers") == 0)
        .drop("_file", "_verified")
    )


def _checklist() -> Column:
    c = F.col
    path = blank_to_null(c("local_path"))
    stays = path.isNotNull() & ~is_absolute(path) & F.coalesce(first_segment(path).isin(*LOCAL_ROOTS), F.lit(False))
    items = [
        ("official_source_uri", "Official source URI is recorded", ~missing(c("source_uri"))),
        ("source_label", "Human-readable source label is recorded", ~missing(c("source_label"))),
        ("local_path", "Local PDF path stays under ignored data/ or samples/", F.coalesce(stays, F.lit(False))),
        ("checksum", "Manifest checksum uses sha256:<64 lowercase hex>", is_checksum(c("checksum"))),
        ("checksum_verified", "Local PDF checksum matches manifest", c("_verified")),
        ("parser_hint", f"Current parser hint is {PARSER_HINT}",
         F.coalesce(c("parser_hint") == PARSER_HINT, F.lit(False))),
        ("language", "Roll language is recorded", ~missing(c("language"))),
        ("human_review", "Human source review has marked reviewed true", F.coalesce(c("reviewed"), F.lit(False))),
    ]
    return F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(text).alias("label"), passed.alias("passed"))
        for i, text, passed in items
    ])


def manifest_review(manifests: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Review rows: blockers other than the missing review itself, and an eight-item checklist."""
    reviewed = F.coalesce(F.col("reviewed"), F.lit(False))
    clear = F.size("blockers") == 0
    return (
        _with_files(manifests, files)
        .withColumn("blockers", F.concat(messages(_field_rules()[1:]), F.col("_file")))
        .withColumn("checklist", _checklist())
        .withColumn("checksum_verified", F.col("_verified"))
        .withColumn("ready_for_human_review", clear & ~reviewed)
        .withColumn("valid_for_ingestion", clear & reviewed)
        .withColumn("review_required", ~reviewed)
        .drop("_file", "_verified")
    )


def draft_manifests(requests: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafted, rejected) entries: the checksum is computed, ``reviewed`` is always false."""
    c = F.col
    path = blank_to_null(c("local_path"))
    sums = files.select(c("path").alias("local_path"), c("checksum"))
    joined = requests.join(sums, "local_path", "left")
    outside = first_segment(path).isNull() | ~first_segment(path).isin(*LOCAL_ROOTS)
    error = F.coalesce(
        F.when(is_absolute(path), "local_path must be repo-relative"),
        F.when(F.coalesce(outside, F.lit(True)),
               "local_path must stay under ignored data/ or samples/ directories"),
        F.when(c("checksum").isNull(), "local_path file does not exist for manifest drafting"),
    )
    note = "TODO: human source review required before ingestion"
    drafted = joined.withColumn("_error", error)
    good = drafted.where(c("_error").isNull()).select(
        "source_id", "state_id", "roll_year", "roll_kind", "source_label", "source_uri", "local_path",
        F.coalesce("parser_hint", F.lit(PARSER_HINT)).alias("parser_hint"), "language", "checksum",
        F.lit(False).alias("reviewed"),
        F.coalesce(blank_to_null(c("notes")), F.lit(note)).alias("notes"),
    )
    return good, drafted.where(c("_error").isNotNull()).select(*requests.columns, c("_error").alias("error"))


def onboarding_blockers(requests: DataFrame, states: DataFrame, manifests: DataFrame) -> DataFrame:
    """``requests(state_id, ac_number, part_number, pdf_path, test_name_env, manifest_path,
    source_id)`` with every reason it may not be onboarded, manifest blockers included."""
    c = F.col
    known = states.select("state_id", F.lit(True).alias("_state"))
    fields = ("state_id", "local_path")
    entry = manifests.withColumn("_blockers", field_blockers()).select(
        "source_id", *[c(f).alias(f"_m_{f}") for f in fields], "_blockers", F.lit(True).alias("_entry")
    )
    joined = requests.join(known, "state_id", "left").join(entry, "source_id", "left")
    path, env = c("pdf_path"), F.coalesce("test_name_env", F.lit(""))
    asked = c("manifest_path").isNotNull() & c("source_id").isNotNull()
    matched = asked & c("_entry").isNotNull()
    own = messages([
        (c("_state").isNull(), F.concat(F.lit("unknown state_id: "), c("state_id"))),
        (c("ac_number") <= 0, "ac_number must be positive"),
        (c("part_number") <= 0, "part_number must be positive"),
        (~env.rlike(ENV_NAME), "test name env var must be alphanumeric with underscores"),
        (is_absolute(path), "pdf path must be repo-relative so raw local paths are not printed"),
        (is_absolute(path) | _outside(path), "pdf path should stay under ignored data/ or samples/ directories"),
        (~asked, "source manifest and source id are required before onboarding"),
        (asked & c("_entry").isNull(), F.concat(F.lit("unknown source_id: "), c("source_id"))),
        (matched & (c("_m_state_id") != c("state_id")), "source manifest state_id must match workflow state"),
        (matched & ~c("_m_local_path").eqNullSafe(path),
         "source manifest local_path must match workflow PDF"),
    ])
    return joined.withColumn(
        "blockers", F.concat(own, F.when(matched, c("_blockers")).otherwise(F.array().cast("array<string>")))
    ).select(*requests.columns, "blockers")
