"""Streams of requests and of page text."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollweave.functions.layout import LEGACY_2002, RollLayout
from rollweave.operators import lines
from rollweave.operators.limiter import MAX_REQUESTS, WINDOW_SECONDS, Decider
from rollweave.session import stage
from rollweave.sources.load import RollTables

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rate_limit_stream(
    log: DataFrame, key: str, ts: str, request_id: str, max_requests: int = MAX_REQUESTS,
    window_seconds: int = WINDOW_SECONDS, idle_seconds: int | None = None,
) -> DataFrame:
    """Decisions on a stream of requests, per key in order of arrival.

    Inside a micro-batch a key's requests are taken by time, then id; a request that arrives
    in a later batch is decided then. State is a key's log of at most ``max_requests``
    times. ``idle_seconds`` drops the state of keys that stay silent that long on the clock,
    which is right for live traffic; leave it out when replaying history.
    """
    window = int(window_seconds * 1_000_000)
    rows = log.select(
        F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"),
        F.col(request_id).alias("_id"),
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = ["_key", "_id", "allowed", "remaining", "retry_after_seconds"]

    def decide(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        decider = Decider(max_requests, window, state.get[0] if state.exists else ())
        todo = pd.concat(list(chunks)).sort_values(["_t", "_id"])
        out = [(group[0], i, *decider.decide(t)) for t, i in zip(todo["_t"], todo["_id"])]
        state.update((list(decider.log),))
        if idle_seconds:
            state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout
    decided = rows.groupBy("_key").applyInPandasWithState(
        decide,
        f"_key {types['_key']}, _id {types['_id']}, allowed boolean, remaining int, retry_after_seconds int",
        "log array<bigint>", "append", timeout,
    )
    return decided.withColumnsRenamed({"_key": key, "_id": request_id})


def stream_load(
    pages: DataFrame, describe: Callable[[DataFrame], DataFrame], tables: RollTables, salt: str,
    checkpoint: str, layout: RollLayout = LEGACY_2002,
) -> StreamingQuery:
    """Loads every document that arrives; repeated documents replace themselves.

    A document must arrive whole, as one file does. ``describe`` turns the pages of a
    micro-batch into its ``roll_documents`` rows. The number of the micro-batch is the load's
    number, so a batch that is run again after a failure is not loaded twice. Its pages are
    staged first, in even parts: a micro-batch is worked out anew, with all its columns, for
    every step that reads it. Extracted records are written once below the tables and read back by the steps
    that need them.
    """

    def load(arrived: DataFrame, number: int) -> None:
        batch = stage(arrived.repartition("doc_id", "page_no"), "pages")
        records = f"{tables.root}/_extracted/{number:09d}"
        lines.extract_voters(lines.page_lines(batch), layout, staged=True).write.mode("overwrite").parquet(records)
        tables.load(number, describe(batch), batch.sparkSession.read.parquet(records), salt)

    return (
        pages.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
