"""The pages of a stream's batch are worked out once."""

from pyspark.sql import functions as F

from rollweave.sources.load import RollTables
from rollweave.streaming.jobs import stream_load


def test_pages_of_a_stream_are_worked_out_once(spark, tmp_path):
    lines = "cover\n12 H1 A {É B {ÉÖ 40\n13 H2 C {É D {ÉÖ 41"
    spark.createDataFrame([(d, p, lines) for d in (1, 2) for p in (1, 2, 3)], "doc_id long, page_no int, text string").write.parquet(f"{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    def describe(batch):
        return batch.select("doc_id").distinct().selectExpr(
            "doc_id", "'ST-0' AS state_id", "2002 AS revision_year", "'S0' AS state_code", "1 AS ac_number", "CAST(doc_id AS INT) AS part_number",
            "0 AS total_voters", "'' AS ac_name_encoded", "'' AS ac_reservation_encoded", "'School' AS polling_station_name_encoded",
            "concat('sha256:', doc_id) AS checksum", "concat('local://', doc_id) AS source_uri")

    pages = spark.readStream.schema("doc_id long, page_no int, text string").parquet(f"{tmp_path}/in").withColumn("text", read("text"))
    tables = RollTables(spark, f"{tmp_path}/tables", slices=2)
    tables.upsert("states", spark.createDataFrame([("ST-0", "S0", "S")], "state_id string, eci_state_code string, name string"))
    stream_load(pages, describe, tables, "salt", f"{tmp_path}/progress").awaitTermination()
    assert tables.table("voter_records").count() == 4
    assert seen.value == 6
