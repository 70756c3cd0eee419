"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that ends a word: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

# Rows and bytes of a batch handed to Python: bounds a worker's memory whatever the texts' lengths.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; the warehouse where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: worked out once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a missing text as NULL; other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Each batch as Python lists of the named columns."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# Ids that are broadcast to a scan of the documents: 16 MB of longs.
MOST_BROADCAST = 2_000_000


def _sized(ids: DataFrame) -> DataFrame:
    """The saved ids, to be broadcast if there are few, so that rows of other documents are not shuffled; beyond, the join shuffles."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def only_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ids (a saved table)."""
    return df.join(_sized(ids), "doc_id", "left_semi")


def without_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ids (a saved table)."""
    return df.join(_sized(ids), "doc_id", "left_anti")
