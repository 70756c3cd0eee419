"""Rate-limit decisions over the event log, and a streaming load of roll-like pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollweave.operators import limiter
from rollweave.plans import Catalog, table
from rollweave.plans.extraction import IDS_SQL, RECONCILED_SQL, SALT, _sid, documents
from rollweave.plans.standins import DOC, PAGE, PAGE_TEXT
from rollweave.session import scratch_path
from rollweave.sources.load import RollTables
from rollweave.streaming.jobs import rate_limit_stream, stream_load

MAX_REQUESTS, WINDOW_SECONDS = 3, 86_400
_W = WINDOW_SECONDS * 1_000_000
# One step per request of a user, the log carried as a list.
LIMIT_SQL = f"""
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT user_id, event_id, rn, [t] AS log, true AS allowed, {MAX_REQUESTS - 1} AS remaining, 0 AS retry FROM e WHERE rn = 1
      UNION ALL
      SELECT user_id, event_id, rn, CASE WHEN len(live) < {MAX_REQUESTS} THEN list_append(live, t) ELSE live END, len(live) < {MAX_REQUESTS},
        CAST(greatest({MAX_REQUESTS} - len(live) - 1, 0) AS INT),
        CASE WHEN len(live) < {MAX_REQUESTS} THEN 0 ELSE CAST(greatest(1, round_even((live[1] + {_W} - t) / 1e6, 0)) AS INT) END
      FROM (SELECT e.user_id, e.event_id, e.rn, e.t, list_filter(r.log, lambda x: x > e.t - {_W}) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
    SELECT user_id, event_id, allowed, remaining, retry AS retry_after_seconds FROM r"""


def register(catalog: Catalog) -> None:
    @catalog.add("rate_limit", LIMIT_SQL)
    def rate_limit(spark, folder):
        return limiter.rate_limit(table(spark, folder, "events"), "user_id", "ts", "event_id", MAX_REQUESTS, WINDOW_SECONDS)

    nobody = LIMIT_SQL.replace("FROM events", "FROM (SELECT CASE WHEN event_id % 101 = 0 THEN -1 ELSE user_id END AS user_id, event_id, ts FROM events WHERE event_id % 7 <> 0)")

    @catalog.add("limiter_null_keys", f"""
        SELECT nullif(user_id, -1) AS user_id, event_id, allowed, remaining, retry_after_seconds FROM ({nobody})
        UNION ALL SELECT CASE WHEN event_id % 101 = 0 THEN NULL ELSE user_id END, event_id, false, 0, NULL FROM events WHERE event_id % 7 = 0""")
    def limiter_null_keys(spark, folder):
        log = table(spark, folder, "events").selectExpr(
            "event_id", "CASE WHEN event_id % 101 <> 0 THEN user_id END AS user_id", "CASE WHEN event_id % 7 <> 0 THEN ts END AS ts")
        return limiter.rate_limit(log, "user_id", "ts", "event_id", MAX_REQUESTS, WINDOW_SECONDS)

    @catalog.add("rate_limit_stream", LIMIT_SQL)
    def rate_limit_streaming(spark, folder):
        schema = table(spark, folder, "events").schema
        log = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
        out = scratch_path(spark, "decisions")
        decided = rate_limit_stream(log, "user_id", "ts", "event_id", MAX_REQUESTS, WINDOW_SECONDS)
        query = (
            decided.writeStream.format("parquet").option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return spark.read.parquet(f"{out}/rows")

    def loaded_tables(spark, folder, states):
        """The tables after a stream of all pages, with the given states seeded."""
        schema = table(spark, folder, "orders").schema
        pages = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(folder).selectExpr(
            f"{DOC} AS doc_id", f"{PAGE} AS page_no", f"{PAGE_TEXT} AS text")
        root = scratch_path(spark, "store")
        tables = RollTables(spark, f"{root}/tables", slices=8)
        tables.upsert("states", spark.createDataFrame([(s, s, s) for s in states], "state_id string, eci_state_code string, name string"))

        def describe(batch):
            return documents(spark, folder).join(batch.select("doc_id").distinct(), "doc_id", "left_semi")

        stream_load(pages, describe, tables, SALT, f"{root}/progress").awaitTermination()
        return tables

    every_state = ("ST-0", "ST-1", "ST-2")

    @catalog.add("stream_load", f"""
        WITH {IDS_SQL}
        SELECT {_sid('voter', 'roll_version_id', 'ac_number', 'part_number', 'serial_number')} AS voter_record_id, roll_version_id, ac_id, serial_number, age, gender, data_quality
        FROM firsts v JOIN ids i ON v.doc_id = i.doc_id""")
    def stream_loading(spark, folder):
        return loaded_tables(spark, folder, every_state).table("voter_records").select(
            "voter_record_id", "roll_version_id", "ac_id", "serial_number", "age", "gender", "data_quality")

    @catalog.add("stream_load_rejected", f"""
        WITH {RECONCILED_SQL}
        SELECT doc_id, array_to_string(blockers, '; ') AS blockers FROM rec WHERE len(blockers) > 0
        UNION ALL SELECT doc_id, 'state row must exist before loading rolls: ' || state_id FROM acc WHERE state_id = 'ST-2'""")
    def stream_load_rejected(spark, folder):
        told = loaded_tables(spark, folder, every_state[:2]).rejected()
        return told.select("doc_id", F.array_join("blockers", "; ").alias("blockers"))

    # Rows of each table as counted in its write; constituencies and stations repeat over documents.
    keys = {"assembly_constituencies": "ac_id", "polling_stations": "polling_station_id", "roll_versions": "roll_version_id",
            "source_documents": "source_document_id", "extraction_runs": _sid("extract", "source_document_id", "'parse_2002'", "parsed_records")}
    counted = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(DISTINCT {k}) AS row_count FROM ids" for t, k in keys.items())

    @catalog.add("load_counts", f"""
        WITH {IDS_SQL} {counted}
        UNION ALL SELECT 'voter_records', count(DISTINCT {_sid('voter', 'roll_version_id', 'ac_number', 'part_number', 'serial_number')}) FROM firsts v JOIN ids i ON v.doc_id = i.doc_id""")
    def load_counts(spark, folder):
        return loaded_tables(spark, folder, every_state).loads().select("table", "row_count")

    @catalog.add("rate_limit_summary", f"SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE allowed) AS allowed_requests FROM ({LIMIT_SQL}) GROUP BY user_id")
    def rate_limit_summary(spark, folder):
        decided = limiter.rate_limit(table(spark, folder, "events"), "user_id", "ts", "event_id", MAX_REQUESTS, WINDOW_SECONDS)
        return decided.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed_requests"))
