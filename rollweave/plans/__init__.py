"""Registered queries: every operator over the test tables, with equivalent SQL.

The tables of the driver stand in for roll tables. Stand-in expressions are written once as
SQL text both engines accept, so both sides read the same derived data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Name -> (Spark job, SQL or None)."""

    def __init__(self):
        self.jobs: dict[str, Job] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(job: Job) -> Job:
            self.jobs[name] = job
            if sql is not None:
                self.sql[name] = sql
            return job

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def full_catalog() -> Catalog:
    from rollweave.plans import crossroll, extraction, files, loaded, matching, registries, scalars, searching, spelling, stored, streams

    catalog = Catalog()
    for module in (scalars, extraction, loaded, searching, registries, streams, crossroll, matching, spelling, files, stored):
        module.register(catalog)
    return catalog
