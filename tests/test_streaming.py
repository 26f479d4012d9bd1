"""Streams replayed from files give what batch gives."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.params import SessionParams
from tidemark.streaming import sessions, sinks

SCHEMA = "insured_id string, session_id string, id string, action string, status string, created_at timestamp, is_download_action int"
T0 = datetime(2025, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows):
        source = tmp_path / "in"
        source.mkdir(exist_ok=True)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        (source / "a.json").write_text("\n".join(json.dumps(dict(zip(names, r)), default=lambda t: t.isoformat() + "Z") for r in rows))
        return spark.readStream.schema(SCHEMA).json(str(source))

    return make


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert q.exception() is None
    return df.sparkSession.table(name)


def rows():
    at = lambda s: T0 + timedelta(seconds=s)
    return [
        ("u", "s", "1", "Connexion", "OK", at(0), 0), ("u", "s", "2", "Profil", "KO", at(5), 1), ("u", "s", "3", "DÃ©connexion", "OK", at(9), 0),
        ("v", "t", "4", "Connexion", "OK", at(70), 0), ("v", "t", "4", "Connexion", "OK", at(70), 0),
    ]


def test_duplicates_go(stream, tmp_path):
    assert run(sessions.deduplicated(stream(rows())), "dedup", tmp_path).count() == 4


def test_counters(stream, tmp_path):
    got = run(sessions.counters(stream(rows())), "counted", tmp_path, "complete").orderBy("start").collect()
    assert [(r.events, r.kos, r.downloads) for r in got] == [(3, 1, 1), (2, 0, 0)]


def test_event_time_sessions(stream, tmp_path):
    got = run(sessions.event_time_sessions(stream(rows())), "sessions", tmp_path, "complete").collect()
    assert sorted((r.insured_id, r.events, r.kos) for r in got) == [("u", 3, 1), ("v", 2, 0)]


def test_logout_and_silence_close_sessions(spark, stream, tmp_path):
    sessions.state_store(spark)
    # the silence of no seconds has passed by the next batch
    df = sessions.closed_sessions(stream(rows()), SessionParams(gap_seconds=0, max_duration_seconds=10**9))
    q = df.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(30):
            if q.awaitTermination(2) or spark.table("closed").count() >= 2:
                break
        got = sorted((r.session_id, r.reason, r.events, r.kos, r.first_action) for r in spark.table("closed").where("kind = 'closed'").collect())
    finally:
        q.stop()
    assert got == [("s", "explicit_logout", 3, 1, "Connexion"), ("t", "inactivity_timeout", 2, 0, "Connexion")]


def test_batches_written_twice_count_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    write = sinks.append_once(str(tmp_path / "out"))
    write(df, 0), write(df, 0), write(df.withColumn("n", F.col("n") + 1), 1)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 4
    assert sorted((r.k, r.n) for r in sinks.latest(out, ["k"], "n").collect()) == [("a", 2), ("b", 3)]


def test_sliding_counters(stream, tmp_path):
    """An event at 70 s lies in the windows that start at 0:30 and 1:00."""
    got = run(sessions.counters(stream(rows()), "1 minute", "30 seconds"), "slid", tmp_path, "complete").collect()
    assert sorted(((r.start - T0).total_seconds(), r.events) for r in got) == [(-30.0, 3), (0.0, 3), (30.0, 2), (60.0, 2)]


def test_trailing_downloads_of_a_stream(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    source = tmp_path / "in"
    source.mkdir()
    put = lambda name, rs: (source / name).write_text("\n".join(json.dumps(dict(zip(names, r)), default=lambda t: t.isoformat() + "Z") for r in rs))
    df = sessions.trailing_downloads(spark.readStream.schema(SCHEMA).json(str(source)), late="1 minute")
    put("0.json", [("u", "s", str(k), "x", "OK", at(t), d) for k, (t, d) in enumerate([(0, 1), (60, 1), (120, 0), (121, 0), (300, 0)])] + [("v", "t", "9", "x", "OK", at(61), 0)])
    q = df.writeStream.format("memory").queryName("trailing").outputMode("append").option("checkpointLocation", str(tmp_path / "trailing")).start()
    q.processAllAvailable()
    # later events move the watermarks of the join and of the counts past the first ones
    for k in range(4):
        put(f"{k + 1}.json", [("z", "z", str(100 + k), "x", "OK", at(3600 * (k + 1)), 1)])
        q.processAllAvailable()
    q.stop()
    got = {r.id: r.downloads_recent for r in spark.table("trailing").collect()}
    assert {k: v for k, v in got.items() if int(k) < 100} == {"0": 1, "1": 2, "2": 2, "3": 1, "4": 0, "9": 0}


class Handle:
    """What a stateful processor asks of Spark, in plain Python, with a clock of its own."""

    def __init__(self):
        self.value, self.timers, self.now = None, set(), 1_000_000

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def heard(processor, handle, *actions):
    frame = pd.DataFrame([(str(k), a, "OK", handle.now * 1000) for k, a in enumerate(actions)], columns=["id", "action", "status", "created_us"])
    return [tuple(r[["kind", "reason", "events"]].iloc[0]) for r in processor.handleInputRows(("u", "s"), iter([frame]), handle)]


def woken(processor, handle):
    handle.now = min(handle.timers)
    handle.timers.discard(handle.now)
    return [tuple(r[["kind", "reason", "events"]].iloc[0]) for r in processor.handleExpiredTimer(("u", "s"), handle, None)]


@pytest.mark.parametrize("drop", [False, True])
def test_late_events_within_grace(drop):
    """After a logout a session is remembered for a minute: what comes then is late, and opens it anew unless late events are dropped."""
    handle, p = Handle(), sessions.SessionProcessor(SessionParams(grace_seconds=60), drop)
    p.init(handle)
    assert heard(p, handle, "Connexion", "Déconnexion") == [("closed", "explicit_logout", 2)]
    handle.now += 30_000
    assert heard(p, handle, "Profil") == [("late", None, 1)]
    if drop:
        assert woken(p, handle) == [] and not handle.exists()
        assert heard(p, handle, "Profil") == []
    else:
        assert handle.get()[0] == 1 and handle.get()[7] is None


def test_silence_and_age_close_sessions():
    handle, p = Handle(), sessions.SessionProcessor(SessionParams(gap_seconds=100, max_duration_seconds=250, min_idle_seconds=30, grace_seconds=10))
    p.init(handle)
    assert heard(p, handle, "Connexion") == [] and woken(p, handle) == [("closed", "inactivity_timeout", 1)] and handle.now == 1_100_000
    assert woken(p, handle) == [] and not handle.exists()
    start = handle.now
    heard(p, handle, "Connexion")
    for _ in range(3):
        handle.now += 80_000
        heard(p, handle, "Profil")
    assert woken(p, handle) == [("closed", "max_open_duration", 4)] and handle.now == start + 270_000


def test_trailing_downloads_by_whole_seconds(spark, tmp_path):
    """As in batch, 120.9 s count as 120 and 121 do not; of events at one time the smaller ids come before."""
    schema = "id string, insured_id string, session_id string, created_at timestamp, is_download_action int"
    names = [x.split()[0] for x in schema.split(", ")]
    at = lambda s: T0 + timedelta(milliseconds=int(s * 1000))
    put = lambda name, rs: (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(names, r)), default=lambda t: t.isoformat() + "Z") for r in rs))
    (tmp_path / "in").mkdir()
    df = sessions.trailing_downloads(spark.readStream.schema(schema).json(str(tmp_path / "in")), late="1 minute")
    put("0.json", [(i, "u", "s", at(t), d) for i, t, d in [("a", 0, 1), ("b", 120.9, 0), ("c", 121, 0), ("d", 200, 1), ("e", 200, 1), ("f", 200, 0)]])
    q = df.writeStream.format("memory").queryName("whole_seconds").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    for k in range(4):
        put(f"{k + 1}.json", [(f"z{k}", "z", "z", at(3600 * (k + 1)), 1)])
        q.processAllAvailable()
    q.stop()
    got = {r.id: r.downloads_recent for r in spark.table("whole_seconds").collect() if r.session_id == "s"}
    assert got == {"a": 1, "b": 1, "c": 0, "d": 1, "e": 2, "f": 2}
