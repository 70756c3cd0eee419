"""Queries over stored layouts: written from the whole table, read back by lookup or scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollweave.functions.text import fingerprint
from rollweave.operators import crossroll
from rollweave.plans import Catalog, table
from rollweave.session import scratch_path
from rollweave.sources import stored

SALT = "stored-layout"
# A seventh of the orders have no identifier; four orders or so share one.
_ID = "CASE WHEN o_orderkey % 7 > 0 THEN concat('MT/07/', lpad(concat('', o_custkey % 1000), 3, '0'), '/', lpad(concat('', o_custkey), 7, '0')) END"
_STATE, _AC = "concat('S', o_custkey % 9)", "CAST(o_orderkey % 288 + 1 AS INT)"


def _by_id(spark, folder) -> str:
    raw = table(spark, folder, "orders").selectExpr("o_orderkey", f"{_ID} AS own")
    return stored.store_by_id(raw.withColumn("epic_hash", fingerprint(F.col("own"), F.lit(SALT))["hash"]))


def by_scope(spark, folder):
    """The orders as records, written by state and constituency range and read back."""
    rows = table(spark, folder, "orders").selectExpr("o_orderkey", f"{_STATE} AS state_id", f"{_AC} AS ac_number")
    path = scratch_path(spark, "records-by-scope")
    crossroll.write_partitioned(rows, path)
    return stored.read_by_scope(spark, path, rows.withColumn("ac_range", crossroll.ac_range(F.col("ac_number"))).schema)


def register(catalog: Catalog) -> None:
    @catalog.add("stored_id_lookup", f"""
        SELECT o_orderkey, {_ID} AS identifier FROM orders WHERE {_ID} = 'MT/07/077/0000077'""")
    def stored_id_lookup(spark, folder):
        records = spark.table(_by_id(spark, folder))
        return crossroll.id_lookup(records, " mt/07/077/ 0000077", SALT).select("o_orderkey", F.col("own").alias("identifier"))

    @catalog.add("stored_id_lookup_batch", f"""
        WITH w AS (SELECT DISTINCT concat('MT/07/', lpad(concat('', c_custkey % 1000), 3, '0'), '/', lpad(concat('', c_custkey), 7, '0')) AS identifier FROM customer)
        SELECT o_orderkey, identifier FROM w JOIN orders ON identifier = {_ID}""")
    def stored_id_lookup_batch(spark, folder):
        asked = table(spark, folder, "customer").selectExpr(
            "concat('MT/07/', lpad(concat('', c_custkey % 1000), 3, '0'), '/', lpad(concat('', c_custkey), 7, '0')) AS identifier")
        return crossroll.id_lookup_batch(spark.table(_by_id(spark, folder)), asked, SALT).select("o_orderkey", "identifier")

    @catalog.add("stored_scope", f"""
        SELECT o_orderkey, {_STATE} AS state_id, {_AC} AS ac_number FROM orders WHERE {_STATE} = 'S4' AND {_AC} = 46""")
    def stored_scope(spark, folder):
        return stored.in_scope(by_scope(spark, folder), "S4", 46).select("o_orderkey", "state_id", "ac_number")

    @catalog.add("stored_folders", f"""
        SELECT {_STATE} AS state_id, CAST({_AC} // 25 AS INT) AS ac_range, count(*) AS records, count(DISTINCT {_AC}) AS acs,
         CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1, 2""")
    def stored_folders(spark, folder):
        return by_scope(spark, folder).groupBy("state_id", "ac_range").agg(
            F.count("*").alias("records"), F.countDistinct("ac_number").alias("acs"), F.sum("o_orderkey").alias("key_sum"))
