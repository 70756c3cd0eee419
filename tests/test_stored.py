"""Stored layouts: what is read back, and that the plans open one bucket or one folder."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from rollweave.operators import crossroll
from rollweave.session import scratch_path
from rollweave.sources import stored

RECORDS = "voter_record_id long, state_id string, ac_number int, epic_hash string"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def records(spark, n=2000):
    # A third of the records share one identifier, a third have none.
    ids = [None if k % 3 == 0 else "hot" if k % 3 == 1 else f"id{k // 9}" for k in range(n)]
    return spark.createDataFrame([(k, f"S{k % 4}", k % 288 + 1, e) for k, e in enumerate(ids)], RECORDS)


def test_one_identifier_reads_one_bucket(spark):
    table = spark.table(stored.store_by_id(records(spark), buckets=16))
    want = {r.voter_record_id for r in records(spark).where("epic_hash = 'id7'").collect()}
    found = table.where("epic_hash = 'id7'")
    assert want and {r.voter_record_id for r in found.collect()} == want
    assert found.rdd.getNumPartitions() == 1 < table.rdd.getNumPartitions()
    # Spark names the buckets in the plan only if it also keeps their order.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 16" in plan(table.where("epic_hash = 'id7'"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert table.count() == records(spark).where("epic_hash IS NOT NULL").count()
    assert table.where("epic_hash = 'hot'").count() == 667


def test_many_identifiers_are_joined_without_moving_the_records(spark):
    table = spark.table(stored.store_by_id(records(spark), buckets=16))
    asked = spark.createDataFrame([("id7",), ("id9",), ("id9",), ("none",), (None,)], "epic_hash string").distinct()
    joined = asked.hint("merge").join(table, "epic_hash")
    text = plan(joined)
    # Both shuffles are those of the identifiers asked for.
    assert "Bucketed: true" in text and text.count("hashpartitioning(epic_hash") == text.count("Exchange\nInput [1]: [epic_hash") == 2
    want = records(spark).where("epic_hash IN ('id7', 'id9')")
    assert {r.voter_record_id for r in joined.collect()} == {r.voter_record_id for r in want.collect()}


def test_buckets_follow_the_records():
    assert [stored.bucket_count(n) for n in (0, 5_000_000, 97_000_000, 10**13)] == [16, 16, 97, 100_000]


def test_a_scope_opens_one_folder(spark):
    rows = records(spark)
    path = scratch_path(spark, "scope")
    crossroll.write_partitioned(rows, path)
    schema = rows.withColumn("ac_range", crossroll.ac_range(F.col("ac_number"))).schema
    table = stored.read_by_scope(spark, path, schema)
    assert sorted(table.select(*rows.columns).collect(), key=str) == sorted(rows.collect(), key=str)
    found = stored.in_scope(table, "S1", 46)
    assert {r.voter_record_id for r in found.collect()} == {k for k in range(2000) if k % 4 == 1 and k % 288 + 1 == 46}
    assert "PartitionFilters" in plan(found) and len({r[0].rsplit("/", 1)[0] for r in found.select(F.input_file_name()).collect()}) == 1
    assert stored.in_scope(table, None, 46).collect() == stored.in_scope(table, "S1", None).collect() == []


def test_empty_tables(spark):
    none = records(spark).limit(0)
    assert spark.table(stored.store_by_id(none, buckets=4)).collect() == []
    path = scratch_path(spark, "scope")
    crossroll.write_partitioned(none, path)
    schema = none.withColumn("ac_range", crossroll.ac_range(F.col("ac_number"))).schema
    assert stored.in_scope(stored.read_by_scope(spark, path, schema), "S1", 46).collect() == []
