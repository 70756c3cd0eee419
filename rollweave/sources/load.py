"""Loads of roll tables: Parquet folders by slice, changed by Spark's own dynamic partition overwrite."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rollweave import schemas
from rollweave.operators import ingest
from rollweave.operators.upsert import latest, loadable, merge_rows
from rollweave.session import stage

SLICES = 256


def _found(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The rows of a folder, or None where there is none."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class RollTables:
    """The relational tables below a folder, each split by ``slice``, a hash range, so that a load rewrites only the slices its
    rows fall into. The number of slices is kept with the tables: a folder that exists goes on with its own.

    One load at a time changes a folder. A load that fails half-way is repeated under its batch number: every step gives the
    same rows again, and the summary that marks a batch as done is written last.
    """

    def __init__(self, spark: SparkSession, root: str, slices: int = SLICES):
        self.spark, self.root = spark, root.rstrip("/")
        kept = _found(spark, f"{self.root}/_slices", "slices int")
        if kept is None:
            kept = spark.createDataFrame([(slices,)], "slices int")
            kept.write.parquet(f"{self.root}/_slices")
        self.slices = kept.first()["slices"]

    def table(self, name: str) -> DataFrame:
        return self._rows(name).drop("slice")

    def _rows(self, name: str) -> DataFrame:
        schema = f"{schemas.TABLES[name]}, slice int"
        rows = _found(self.spark, f"{self.root}/{name}", schema)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def slice_of(self, df: DataFrame, name: str) -> DataFrame:
        """Rows with their slice. Records and stations go by constituency, so one roll touches
        one slice; the other tables go by their key."""
        by = "ac_id" if name in ("voter_records", "polling_stations") else schemas.KEYS[name]
        return df.withColumn("slice", F.pmod(F.xxhash64(by), F.lit(self.slices)).cast("int"))

    def upsert(self, name: str, updates: DataFrame) -> int:
        """Insert or replace by key; the number of rows written from ``updates``, counted in the write itself."""
        key = [schemas.KEYS[name]]
        written = Observation(name)
        counted = latest(updates, key).observe(written, F.count(F.lit(1)).alias("rows"))
        new = stage(self.slice_of(counted, name), f"load-{name}")
        touched = [r["slice"] for r in new.select("slice").distinct().collect()]  # at most the number of slices
        if touched:
            old = self._rows(name).where(F.col("slice").isin(touched)).drop("slice")
            merged = merge_rows(old, new.drop("slice"), key)
            if "created_at" in merged.columns:
                merged = merged.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
            # Written apart first: the folders that it was read from are replaced by it.
            whole = stage(self.slice_of(merged, name), f"merged-{name}")
            whole.hint("rebalance", "slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(
                f"{self.root}/{name}")
        return written.get["rows"]

    def load(self, number: int, documents: DataFrame, voters: DataFrame, salt: str) -> DataFrame:
        """``table, row_count``: what a batch of described documents and their records wrote.

        Documents that don't reconcile, or whose state is not in the table ``states``, are kept with their messages
        (``rejected``). A batch number that was loaded before changes nothing.
        """
        done = _found(self.spark, f"{self.root}/_loads/batch={number}")
        if done is not None:
            return done
        accepted, rejected = ingest.split_reconciled(ingest.reconcile(documents, voters))
        accepted = stage(accepted, "accepted")
        known = loadable(accepted, self.table("states"), "state_id", "state_id")
        homeless = accepted.join(known.select("doc_id"), "doc_id", "left_anti").withColumn(
            "blockers", F.array(F.concat(F.lit("state row must exist before loading rolls: "), F.coalesce("state_id", F.lit("None")))))
        rejected.unionByName(homeless).write.mode("overwrite").parquet(f"{self.root}/_rejected/batch={number}")
        batch = ingest.fan_out(known, voters, salt)
        counts = [(name, self.upsert(name, batch[name])) for name in schemas.LOAD_ORDER]
        self.spark.createDataFrame(counts, "table string, row_count long").write.mode("overwrite").parquet(
            f"{self.root}/_loads/batch={number}")
        return _found(self.spark, f"{self.root}/_loads/batch={number}")

    def loads(self) -> DataFrame:
        """``batch, table, row_count`` of all loads."""
        return self.spark.read.parquet(f"{self.root}/_loads")

    def rejected(self) -> DataFrame:
        """Documents that loads turned away, with their messages and the number of the batch."""
        return self.spark.read.parquet(f"{self.root}/_rejected")
