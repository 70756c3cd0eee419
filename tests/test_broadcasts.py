"""Broadcasts are decided by measured sizes, not by those of compressed files."""

from pyspark.sql import functions as F

from rollweave.operators import cover


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cover_pages_are_never_broadcast(spark, tmp_path):
    rows = [(d, p, f"{d}-{p}") for d in range(5) for p in (3, 1, 2)] + [(9, 4, "only"), (8, 1, "a"), (8, 1, "a"), (8, 6, None)]
    spark.createDataFrame(rows, "doc_id long, page_no int, text string").write.parquet(f"{tmp_path}/pages")
    got = cover.document_pages(spark.read.parquet(f"{tmp_path}/pages"))
    assert "BroadcastExchange" not in plan(got)
    want = {d: (f"{d}-1", f"{d}-2", f"{d}-3") for d in range(5)} | {9: ("only", None, "only"), 8: ("a", None, None)}
    assert {r.doc_id: (r.cover, r.second, r.summary) for r in got.collect()} == want


def test_rows_cut_from_a_compressed_file_are_not_broadcast(spark, tmp_path):
    """A few MB of files may be many times that in rows."""
    spark.range(400_000).select("id", F.xxhash64("id").alias("x")).coalesce(1).write.parquet(f"{tmp_path}/t")
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert 2 << 20 < size < 8 << 20
    t = spark.read.parquet(f"{tmp_path}/t")
    joined = t.join(t.select("id", F.repeat(F.col("x").cast("string"), 100).alias("text")), "id")
    assert "BroadcastExchange" not in plan(joined)
