"""Each event worked on once: a lease while it is in work, a longer mark when it is done, and its release when the work fails.

Attempts and outcomes are one stream, keyed by the event. An attempt is admitted where neither a lease nor a mark stands;
a lease ends by itself, so what a crash left in work is admitted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How long an event is held while in work, and how long it counts as done.
WORK_SECONDS, DONE_SECONDS = 300, 86_400
ATTEMPT, PROCESSED, FAILED = "event", "processed", "failed"
DECISION = T.StructType([
    T.StructField("event_key", T.StringType()), T.StructField("place", T.LongType()), T.StructField("decision", T.StringType()),
    T.StructField("payload", T.StringType()),
])
_LEASE = T.StructType([T.StructField("state", T.StringType()), T.StructField("until_ms", T.LongType())])


class LeaseProcessor(StatefulProcessor):
    """The lease of one event. Decisions on attempts are ``admitted`` and ``duplicate``; outcomes change the lease alone."""

    def __init__(self, work_seconds: float = WORK_SECONDS, done_seconds: float = DONE_SECONDS) -> None:
        self.work_ms, self.done_ms = int(work_seconds * 1000), int(done_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", _LEASE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        batches = [b for b in rows if len(b)]
        if not batches:
            return
        before = self.lease.get() if self.lease.exists() else None
        held = before[1] if before is not None and before[1] > now else None
        state = before[0] if held is not None else None
        out = []
        for row in pd.concat(batches).sort_values("place", kind="stable").itertuples(index=False):
            if row.kind == ATTEMPT:
                out.append((str(key[0]), row.place, "duplicate" if held is not None else "admitted", row.payload))
                if held is None:
                    state, held = "processing", now + self.work_ms
            elif row.kind == PROCESSED:
                state, held = PROCESSED, now + self.done_ms
            elif row.kind == FAILED:
                state = held = None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held is None:
            self.lease.clear()
        else:
            self.lease.update((state, held))
            self.handle.registerTimer(held)
        if out:
            yield pd.DataFrame(out, columns=DECISION.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lease.exists() and self.lease.get()[1] <= timerValues.getCurrentProcessingTimeInMs():
            self.lease.clear()
        return iter(())

    def close(self) -> None:
        pass


def decisions(rows: DataFrame, work_seconds: float = WORK_SECONDS, done_seconds: float = DONE_SECONDS) -> DataFrame:
    """``event_key, place, decision, payload`` of each attempt in a stream ``rows(event_key, kind, place, payload)``.

    ``kind`` is ``event`` for an attempt, ``processed`` or ``failed`` for what became of one; ``place`` orders the rows of a key
    within a micro-batch. Rows without a key are left out. Needs the RocksDB state store, which ``sessions.state_store`` sets.
    """
    read = rows.where("event_key is not null").select(
        F.col("event_key").cast("string").alias("event_key"), "kind", F.col("place").cast("long").alias("place"), F.col("payload").cast("string").alias("payload")
    )
    return read.groupBy("event_key").transformWithStateInPandas(LeaseProcessor(work_seconds, done_seconds), outputStructType=DECISION, outputMode="Append", timeMode="ProcessingTime")


def work_once(work: Callable[[DataFrame, int], None], outcomes: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``work`` on what is admitted, then its outcome, as JSON below ``outcomes``, a folder that the stream reads as well.

    The outcome of a batch replaces that of an earlier attempt at the same batch. If the work fails, its events are released
    before the error goes on, so that the next attempt at them is admitted, unless the failed batch itself is repeated.
    """

    def write(admitted: DataFrame, number: int, kind: str) -> None:
        row = F.to_json(F.struct("event_key", F.lit(kind).alias("kind"), "place", F.lit(None).cast("string").alias("payload")))
        admitted.select(row.alias("value")).write.mode("overwrite").text(f"{outcomes}/batch={number}")

    def run(batch: DataFrame, number: int) -> None:
        admitted = batch.where("decision = 'admitted'").persist()
        try:
            if admitted.isEmpty():
                return
            try:
                work(admitted, number)
            except Exception:
                write(admitted, number, FAILED)
                raise
            write(admitted, number, PROCESSED)
        finally:
            admitted.unpersist()

    return run
