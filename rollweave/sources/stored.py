"""Stored layouts of record tables, so that a lookup opens few files.

By identifier: a table in buckets of the identifier's hash. A lookup of one identifier reads one bucket, a
table of identifiers is joined without moving the stored records. By scope: folders of state and
constituency range (``crossroll.write_partitioned``); a search inside a constituency opens one folder.

Defined results: records without an identifier cannot be looked up by one and are left out of the first layout; a
scope without a state or a constituency holds nothing, as NULL equals nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollweave.operators.crossroll import ac_range
from rollweave.session import scratch_path

ROWS_A_BUCKET = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 100_000  # Spark's own limit


def bucket_count(rows: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, rows // ROWS_A_BUCKET))


def store_by_id(voters: DataFrame, name: str | None = None, key: str = "epic_hash", buckets: int | None = None) -> str:
    """Writes the records that have a key as a bucketed table in the shared folder; returns the table's name.

    The number of buckets follows the number of records unless it is given. An identifier that very many
    records share is split between several files of its bucket.
    """
    spark = voters.sparkSession
    buckets = buckets or bucket_count(voters.count())
    name = name or f"records_by_id_{uuid.uuid4().hex}"
    rows = voters.where(F.col(key).isNotNull()).hint("rebalance", buckets, key)
    writer = rows.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, name))
    writer.saveAsTable(name, format="parquet")
    return name


def in_scope(stored: DataFrame, state_id: str | None, ac_number: int | None) -> DataFrame:
    """The records of one constituency of a table written by state and constituency range."""
    number = F.lit(ac_number).cast("int")
    return stored.where(
        (F.col("state_id") == F.lit(state_id)) & (F.col("ac_range") == ac_range(number)) & (F.col("ac_number") == number))


def read_by_scope(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table written by ``crossroll.write_partitioned``; ``schema`` is the one of the records, so no folder name's type is guessed."""
    return spark.read.schema(schema).parquet(path)
