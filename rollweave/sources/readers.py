"""Scans: page text, registries, file checksums, relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollweave import schemas
from rollweave.functions.text import blank_to_null
from rollweave.operators.lines import last_per_key
from rollweave.session import stage


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """``page_text(doc_id, page_no, text)`` rows stored as JSON lines or Parquet."""
    reader = spark.read.schema(schemas.PAGE_TEXT)
    return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)


def manifest_entries(documents: DataFrame) -> DataFrame:
    """Entries of manifest documents ``(sources, file)``; a later duplicate id wins."""
    rows = documents.select("file", F.posexplode("sources").alias("pos", "s")).select("file", "pos", "s.*")
    filled = rows.withColumns({
        "checksum": F.coalesce("checksum", F.lit("")),
        "reviewed": F.coalesce("reviewed", F.lit(False)),
        "notes": F.coalesce("notes", F.lit("")),
        "local_path": blank_to_null(F.col("local_path")),
    })
    return last_per_key(filled, ["source_id"], ["file", "pos"]).drop("file", "pos")


def malformed_manifests(documents: DataFrame) -> DataFrame:
    """``file, error`` of the documents that ``manifest_entries`` gets no entries from."""
    return documents.where("sources IS NULL").select("file", F.lit("sources is missing or not a list").alias("error"))


def read_documents(spark: SparkSession, path: str, schema: str, glob: str = "*") -> DataFrame:
    """JSON documents, one a file, with ``file`` and ``corrupt``: the text of a document that is damaged or of other types.

    Read once to a staged table, as good and damaged documents are told apart in later steps.
    """
    docs = (
        spark.read.schema(f"{schema}, corrupt string").option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    )
    return stage(docs.withColumn("file", F.col("_metadata.file_path")), "json-documents")


def damaged_documents(documents: DataFrame, needed: Column, says: str) -> DataFrame:
    """``file, error`` of documents that are no JSON, are of other types, or lack what is ``needed``."""
    broken = F.try_parse_json("corrupt").isNull()
    error = F.coalesce(
        F.when(F.col("corrupt").isNotNull() & broken, "document is not valid JSON"), F.when(~F.coalesce(needed, F.lit(False)), says),
        F.when(F.col("corrupt").isNotNull(), "document has fields of other types"))
    return documents.withColumn("error", error).where("error IS NOT NULL").select("file", "error")


def _sound(documents: DataFrame, errors: DataFrame) -> DataFrame:
    return documents.join(errors.select("file"), "file", "left_anti").drop("corrupt")


def read_checked_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of manifest documents; a damaged document is an error row and keeps no other from being read."""
    docs = read_documents(spark, path, schemas.MANIFEST_DOCUMENT)
    errors = damaged_documents(docs, F.col("sources").isNotNull(), "sources is missing or not a list")
    return manifest_entries(_sound(docs, errors)), errors


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(schemas.MANIFEST_DOCUMENT).option("multiLine", True).json(path)
    return manifest_entries(docs.withColumn("file", F.col("_metadata.file_path")))


def typed_states(documents: DataFrame) -> DataFrame:
    """State documents with ISO texts turned into dates; empty text is no date."""
    day = lambda c: F.to_date(blank_to_null(c))
    schedule = F.struct(
        F.col("sir_schedule.phase").alias("phase"),
        *[day(F.col(f"sir_schedule.{d}")).alias(d) for d in schemas.SCHEDULE_DATES],
        F.col("sir_schedule.status").alias("status"),
    )
    sources = F.transform(
        "official_sources",
        lambda s: F.struct(
            s["label"].alias("label"), s["url"].alias("url"), s["source_type"].alias("source_type"),
            day(s["last_verified"]).alias("last_verified"),
            F.coalesce(s["notes"], F.lit("")).alias("notes"),
        ),
    )
    return documents.withColumn("sir_schedule", schedule).withColumn("official_sources", sources)


def read_states(spark: SparkSession, directory: str) -> DataFrame:
    """All state documents of a directory; for a repeated id the last file name wins."""
    docs = (
        spark.read.schema(schemas.STATE_DOCUMENT).option("multiLine", True)
        .option("pathGlobFilter", "*.json").json(directory)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    return typed_states(last_per_key(docs, ["state_id"], ["_file"]).drop("_file"))


def read_checked_states(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(states, errors) of the state documents below a directory; for a repeated id the last file name wins."""
    docs = read_documents(spark, directory, schemas.STATE_DOCUMENT)
    errors = damaged_documents(docs, F.col("state_id") != "", "state_id is missing")
    return typed_states(last_per_key(_sound(docs, errors), ["state_id"], ["file"]).drop("file")), errors


def catalogue_rows(documents: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(forms, document categories) of catalogue documents, one row per map entry."""
    forms = documents.select(*keep, F.explode("forms").alias("form_id", "f")).select(*keep, "form_id", "f.*")
    kinds = documents.select(*keep, F.explode("common_documents").alias("category", "documents"))
    return forms.orderBy(*keep, "form_id"), kinds.orderBy(*keep, "category")


def read_forms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(forms, documents) of a forms catalogue, each sorted by its key."""
    return catalogue_rows(spark.read.schema(schemas.FORMS_DOCUMENT).option("multiLine", True).json(path))


def read_checked_forms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forms, documents, errors) of forms catalogues, rows with the ``file`` they come from."""
    docs = read_documents(spark, path, schemas.FORMS_DOCUMENT)
    errors = damaged_documents(docs, F.col("forms").isNotNull() & F.col("common_documents").isNotNull(), "forms or common_documents is missing or not a map")
    return (*catalogue_rows(_sound(docs, errors), "file"), errors)


def read_search_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SEARCH_RECORD).option("multiLine", True).json(path)


def checksums(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``path, source_uri, checksum, bytes`` of files. One file is one row of one task."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive).load(path)
    )
    local = F.regexp_replace("path", "^file:/*", "/")
    return files.select(
        "path",
        F.concat(F.lit("local://"), local).alias("source_uri"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"),
        F.col("length").alias("bytes"),
    )


def read_file_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of every file below a folder, for the sensitive-text scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = "^(?:file:)?/*" + path.strip("/").replace(".", "\\.") + "/"
    return files.select(F.regexp_replace("path", root, "").alias("path"), "content")


def read_tables(
    spark: SparkSession, root: str, names: tuple[str, ...] = tuple(schemas.TABLES)
) -> dict[str, DataFrame]:
    """The relational tables from Parquet folders named after them."""
    return {n: spark.read.schema(schemas.TABLES[n]).parquet(f"{root}/{n}") for n in names}


def read_jdbc_tables(
    spark: SparkSession, url: str, properties: dict[str, str],
    names: tuple[str, ...] = tuple(schemas.TABLES), partitions: int = 64,
) -> dict[str, DataFrame]:
    """The same tables from a database. Records are read in parallel slices of the key hash
    the database computes, the other tables in one piece."""
    out = {}
    for name in names:
        key = schemas.KEYS[name]
        if name == "voter_records":
            slices = [f"mod(abs(hashtext({key})::bigint), {partitions}) = {i}" for i in range(partitions)]
            out[name] = spark.read.jdbc(url, name, predicates=slices, properties=properties)
        else:
            out[name] = spark.read.jdbc(url, name, properties=properties)
    return out
