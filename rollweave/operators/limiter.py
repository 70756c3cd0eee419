"""Rate-limit decisions over a request log.

A request is allowed when fewer than ``max_requests`` *allowed* requests of its key lie in
the window before it; refused requests are not remembered. The rule feeds on its own
output, so a key's requests have to be decided in order - but only where the limit is in
play. A request whose whole window holds no doubtful request has a known log, whatever
happened earlier, and a key's history can be cut there.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

# The per-row helper travels inside the task, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_REQUESTS = 30
WINDOW_SECONDS = 60
# Time blocks are this many windows long; a key is ordered only inside a block.
WINDOWS_PER_BLOCK = 64


class Decider:
    """The log of one key: times, in microseconds, of allowed requests still in the window."""

    def __init__(self, max_requests: int, window: int, log=()):
        self.max_requests, self.window, self.log = max_requests, window, deque(log)

    def decide(self, now: int) -> tuple[bool, int, int]:
        """(allowed, remaining, retry_after_seconds) of a request at ``now``."""
        while self.log and self.log[0] <= now - self.window:
            self.log.popleft()
        if len(self.log) >= self.max_requests:
            wait = (self.log[0] + self.window - now) / 1e6
            return False, 0, max(1, int(round(wait)))
        self.log.append(now)
        return True, self.max_requests - len(self.log), 0


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _replicate(log: DataFrame, length: int, window: int) -> DataFrame:
    """Rows in their time block, and once more ahead of the next block when they fall into
    the two windows before it."""
    # An exact quotient, also for times before 1970.
    home = ((F.col("_t") - F.pmod("_t", F.lit(length))) / length).cast("bigint")
    near = (F.col("_t") >= (home + 1) * length - 2 * window)
    blocks = F.array_compact(F.array(home, F.when(near, home + 1)))
    return log.select("*", F.explode(blocks).alias("_block"), home.alias("_home"))


def _cut(rows: DataFrame, max_requests: int, window: int) -> DataFrame:
    """Marks the first request of every block whose log is known: every request in the
    window before it is certain, i.e. had at most ``max_requests`` arrivals in its window."""
    order = Window.partitionBy("_key", "_block").orderBy("_t", "_id")
    nth = F.lag("_t", max_requests).over(order)
    doubtful = F.coalesce(nth > F.col("_t") - window, F.lit(False))
    flagged = rows.withColumn("_doubt", F.when(doubtful, F.col("_t")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last_doubt = F.max("_doubt").over(before)
    own = F.col("_block") == F.col("_home")
    known = own & F.col("_doubt").isNull() & F.coalesce(last_doubt <= F.col("_t") - window, F.lit(True))
    marked = flagged.withColumn("_at", F.when(known, F.struct("_t", "_id")))
    whole = Window.partitionBy("_key", "_block")
    return marked.withColumn("_cut", F.min("_at").over(whole)).drop("_doubt", "_at")


def _segments(cut: DataFrame, window: int) -> DataFrame:
    """Each request's segment - the latest block start whose cut precedes it - and, once
    more, the certain requests a segment starts from (``_seed``)."""
    own = F.col("_block") == F.col("_home")
    blocks = cut.where(own).groupBy("_key", "_block").agg(
        F.max(F.col("_cut").isNotNull()).alias("_has")
    )
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "_key", "_block",
        F.coalesce(F.last(F.when(F.col("_has"), F.col("_block")), ignorenulls=True).over(earlier),
                   F.lit(-(2**62))).alias("_carried"),
    )
    at = F.struct("_t", "_id")
    past = F.coalesce(at >= F.col("_cut"), F.lit(False))
    seed = ~past & (F.col("_t") > F.col("_cut._t") - window) & F.col("_cut").isNotNull()
    mine, known = cut.alias("c"), carried.alias("k")  # NULL is a key like any other
    joined = mine.join(known, F.expr("c._key <=> k._key AND c._block = k._block")).select("c.*", "k._carried")
    role = F.array_compact(F.array(
        F.when(own, F.struct(F.when(past, F.col("_block")).otherwise(F.col("_carried")).alias("_segment"),
                             F.lit(False).alias("_seed"))),
        F.when(seed, F.struct(F.col("_block").alias("_segment"), F.lit(True).alias("_seed"))),
    ))
    return joined.select("_key", "_t", "_id", F.explode(role).alias("_r")).select(
        "_key", "_t", "_id", "_r._segment", "_r._seed"
    )


def _decide(max_requests: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by segment and time; only the open segment's log is held.
        current, decider = None, None
        for pdf in batches:
            out = []
            keys = pdf["_key"].astype(object).where(pdf["_key"].notna(), None)  # NaN is not equal to itself
            for key, seg, t, i, seed in zip(keys, pdf["_segment"], pdf["_t"], pdf["_id"], pdf["_seed"]):
                if (key, seg) != current:
                    current, decider = (key, seg), Decider(max_requests, window)
                if seed:
                    decider.log.append(t)
                else:
                    out.append((key, i, t, *decider.decide(t)))
            yield pd.DataFrame(out, columns=["_key", "_id", "_t", "allowed", "remaining", "retry_after_seconds"])

    return run


def rate_limit(
    log: DataFrame, key: str, ts: str, request_id: str, max_requests: int = MAX_REQUESTS,
    window_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    """Decision per request: ``key, request_id, allowed, remaining, retry_after_seconds``.

    Requests of a key count in order of time, then id. Only these three columns travel.
    Ordering happens per (key, time block), so a hot key is many tasks; the final in-order
    pass runs per segment between cuts with a log of at most ``max_requests`` times in
    memory. Only a key that stays over its limit without a break is one sequential pass.
    Requests without a key count together; one without a time is refused (retry NULL).
    """
    window = int(window_seconds * 1_000_000)
    rows = log.select(F.col(key).alias("_key"), _micros(F.col(ts)).alias("_t"), F.col(request_id).alias("_id"))
    parted = _replicate(rows.where("_t IS NOT NULL"), WINDOWS_PER_BLOCK * window, window)
    # The block window and the join below share this partitioning.
    segments = _segments(_cut(parted, max_requests, window), window)
    ordered = segments.repartition("_key", "_segment").sortWithinPartitions(
        "_key", "_segment", F.col("_seed").desc(), "_t", "_id"
    )
    types = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    decided = ordered.mapInPandas(
        _decide(max_requests, window),
        f"_key {types['_key']}, _id {types['_id']}, _t bigint, allowed boolean, remaining int, retry_after_seconds int",
    )
    untimed = rows.where("_t IS NULL").select(
        "_key", "_id", F.lit(False).alias("allowed"), F.lit(0).alias("remaining"), F.lit(None).cast("int").alias("retry_after_seconds"))
    return decided.drop("_t").unionByName(untimed).select(
        F.col("_key").alias(key), F.col("_id").alias(request_id), "allowed", "remaining", "retry_after_seconds"
    )
