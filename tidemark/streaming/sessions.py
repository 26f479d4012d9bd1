"""Streams of audit events: deduplication, counters, and sessions that close by logout, silence or age.

Sessions in processing time need timers of their own and are a stateful processor; everything else
is a built-in windowed aggregate. Scores and rules are the same column expressions as in batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.params import SessionParams
from ..functions.text import event_key, python_key

CLOSED = T.StructType([
    T.StructField("insured_id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("events", T.LongType()), T.StructField("kos", T.LongType()),
    T.StructField("first_action", T.StringType()), T.StructField("last_action", T.StringType()), T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()),
])
_STATE = T.StructType([
    T.StructField("events", T.LongType()), T.StructField("kos", T.LongType()), T.StructField("first_action", T.StringType()), T.StructField("last_action", T.StringType()),
    T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("ingested_ms", T.LongType()), T.StructField("closed_ms", T.LongType()),
])


def deduplicated(events: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """Each event once, by id or else by content, within the watermark of ``created_at``."""
    key = event_key(F.col("id"), F.col("insured_id"), F.col("session_id"), F.unix_micros("created_at"), F.col("action"))
    return events.withColumn("_key", key).withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def counters(events: DataFrame, size: str = "1 minute", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Events, failures and downloads of tumbling or sliding windows."""
    w = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    return events.withWatermark("created_at", watermark).groupBy(w).agg(
        F.count("*").alias("events"), F.count_if(F.upper("status") == "KO").alias("kos"), F.count_if(F.col("is_download_action") == 1).alias("downloads")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events", "kos", "downloads")


def event_time_sessions(events: DataFrame, gap_seconds: int = SessionParams.gap_seconds, watermark: str = "1 hour") -> DataFrame:
    """Sessions of users by pauses in event time; they close when the watermark has passed them."""
    w = F.session_window("created_at", f"{gap_seconds} seconds")
    out = events.withWatermark("created_at", watermark).groupBy("insured_id", w).agg(
        F.count("*").alias("events"), F.count_if(F.upper("status") == "KO").alias("kos"), F.max("created_at").alias("end_time")
    )
    return out.select("insured_id", F.col("session_window.start").alias("start_time"), "end_time", "events", "kos")


class SessionProcessor(StatefulProcessor):
    """One session's state: a running summary, when it was last heard of, when it closed.

    Emits a ``closed`` row on an end action, after ``gap_seconds`` without events, or at ``max_duration_seconds`` of
    age when idle for a while; a closed session is remembered for ``grace_seconds``, in which events are
    reported as ``late`` and, unless ``drop_late``, open the session anew.
    """

    def __init__(self, p: SessionParams = SessionParams(), drop_late: bool = False) -> None:
        self.p, self.drop_late = p, drop_late
        self.ends = {python_key(a) for a in p.end_actions}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE)

    def _row(self, key, kind: str, reason: str | None, s: tuple) -> pd.DataFrame:
        return pd.DataFrame([(str(key[0]), str(key[1]), kind, reason, *s[:6])], columns=CLOSED.names)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        batches = [b for b in rows if len(b)]
        if not batches:
            return
        events = pd.concat(batches).sort_values(["created_us", "id"], na_position="last", kind="stable")
        s = self.state.get() if self.state.exists() else None
        if s is not None and s[7] is not None:
            yield self._row(key, "late", None, (len(events), 0, *[None] * 4))
            if self.drop_late:
                return
            s = None
        labels = [python_key(a) if isinstance(a, str) else "" for a in events["action"]]
        ends = [k for k, label in enumerate(labels) if label in self.ends]
        at = 0
        for end in [*ends, None]:
            stretch = events.iloc[at : len(events) if end is None else end + 1]
            at += len(stretch)
            if not len(stretch):
                continue
            if s is not None and s[7] is not None:
                # what follows an end in the same batch is as late as what follows it in the next one
                yield self._row(key, "late", None, (len(stretch), 0, *[None] * 4))
                if self.drop_late:
                    break
                s = None
            s = self._merged(s, stretch, now)
            if end is not None:
                yield self._row(key, "closed", "explicit_sso_disconnect" if "sso disconnect" in labels[end] else "explicit_logout", s)
                s = (*s[:7], now)
        self.state.update(s)
        self._wake(now, s)

    @staticmethod
    def _merged(s: tuple | None, events: pd.DataFrame, now: int) -> tuple:
        """The state after more events, in order of time: counts add up, the earliest and the latest event are kept."""
        n, kos = len(events), int((events["status"].astype(str).str.upper() == "KO").sum())
        timed = events[events["created_us"].notna()]
        text = lambda a: a if isinstance(a, str) else None
        if len(timed):
            first, last = timed.iloc[0], timed.iloc[-1]
            edges = (text(first["action"]), text(last["action"]), int(first["created_us"]), int(last["created_us"]))
        else:
            edges = (text(events["action"].iloc[0]), text(events["action"].iloc[-1]), None, None)
        if s is None:
            return (n, kos, *edges, now, None)
        first = edges[2] is not None and (s[4] is None or edges[2] < s[4]) or s[4] is None and edges[2] is None
        last = edges[3] is not None and (s[5] is None or edges[3] >= s[5]) or s[5] is None and edges[3] is None
        return (s[0] + n, s[1] + kos, edges[0] if first else s[2], edges[1] if last else s[3], edges[2] if first else s[4], edges[3] if last else s[5], now, None)

    def _wake(self, now: int, s: tuple) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s[7] is not None:
            self.handle.registerTimer(s[7] + self.p.grace_seconds * 1000)
            return
        times = [s[6] + self.p.gap_seconds * 1000]
        if s[4] is not None:
            times.append(max(s[4] // 1000 + self.p.max_duration_seconds * 1000, s[6] + self.p.min_idle_seconds * 1000))
        self.handle.registerTimer(max(now + 1, min(times)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        now, s = timerValues.getCurrentProcessingTimeInMs(), self.state.get()
        if s[7] is not None:
            if now >= s[7] + self.p.grace_seconds * 1000:
                self.state.clear()
            return
        idle = now - s[6]
        if idle >= self.p.gap_seconds * 1000:
            reason = "inactivity_timeout"
        elif s[4] is not None and now - s[4] // 1000 >= self.p.max_duration_seconds * 1000 and idle >= self.p.min_idle_seconds * 1000:
            reason = "max_open_duration"
        else:
            self._wake(now, s)
            return
        yield self._row(key, "closed", reason, s)
        s = (*s[:7], now)
        self.state.update(s)
        self._wake(now, s)

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, p: SessionParams = SessionParams(), drop_late: bool = False) -> DataFrame:
    """Closed sessions and late events of a stream of events (``insured_id, session_id, id, action, status, created_at``).

    Needs the RocksDB state store, which ``state_store`` sets.
    """
    rows = events.select("insured_id", "session_id", "id", "action", "status", F.unix_micros("created_at").alias("created_us"))
    return rows.groupBy("insured_id", "session_id").transformWithStateInPandas(
        SessionProcessor(p, drop_late), outputStructType=CLOSED, outputMode="Append", timeMode="ProcessingTime"
    )


def state_store(spark) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def trailing_downloads(events: DataFrame, seconds: int = 120, late: str = "10 minutes") -> DataFrame:
    """For each event of a stream, downloads of its session in the ``seconds`` up to it, in whole seconds as in batch: up to a second less one more.

    Of events at one time, those with a smaller id come before.

    An interval join of the stream with its own downloads; both sides' state ends with the watermark, so it does not grow.
    ``events``: id, insured_id, session_id, created_at, is_download_action.
    """
    left = events.select("id", "insured_id", "session_id", "created_at").withWatermark("created_at", late)
    right = events.where("is_download_action = 1").select(
        F.col("insured_id").alias("_user"), F.col("session_id").alias("_session"), F.col("created_at").alias("_at"), F.col("id").alias("_id")
    ).withWatermark("_at", late)
    near = (F.col("insured_id") == F.col("_user")) & (F.col("session_id") == F.col("_session"))
    near &= (F.col("_at") <= F.col("created_at")) & (F.col("_at") > F.col("created_at") - F.expr(f"interval {seconds + 1} seconds"))
    near &= (F.col("_at") < F.col("created_at")) | (F.col("_id") <= F.col("id"))
    joined = left.join(right, near, "left_outer")
    return joined.groupBy(F.window("created_at", "1 second"), "id", "session_id").agg(F.count("_id").alias("downloads_recent")).drop("window")
