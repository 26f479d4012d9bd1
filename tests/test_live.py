"""Live session summaries: worked out by hand, batch against stream in any order; payload shapes."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import live
from tidemark.sources import payloads
from tidemark.streaming import live as live_stream
from tidemark.streaming import sessions

SCHEMA = (
    "insured_id string, session_id string, id string, created_at timestamp, sequence_in_session int, action string, page string, route string, status string, ip string, device string, "
    "ip_country string, country_code string, anomaly_type string, is_anomaly int, is_weekend int, hour_of_day int, is_download_action int, time_delta_since_last_action long, "
    "unique_ips_in_session int, unique_devices_in_session int, is_ip_changed int, is_device_changed int, downloads_last_2_minutes int, ping_pong_count int, cumulative_kos int, "
    "longest_ko_streak int, session_risk_score double, request_data_size_bytes long, response_data_size_bytes long"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
T0 = datetime(2025, 1, 3, 23, 59, 30)  # a Friday
KEYS = ["insured_id", "session_id"]


def event(user, session, id_, at, **more):
    return {**dict.fromkeys(NAMES), "insured_id": user, "session_id": session, "id": id_, "created_at": None if at is None else T0 + timedelta(seconds=at), **more}


EVENTS = [
    event("u", "s", "b", 0, sequence_in_session=2, action="Profil", page="p2", route="/b", status="KO", ip="1", device="d", ip_country=" ", country_code="FR", is_weekend=0, unique_ips_in_session=1,
          unique_devices_in_session=1, cumulative_kos=1, longest_ko_streak=1, session_risk_score=40.0, time_delta_since_last_action=0, request_data_size_bytes=5, anomaly_type="Normal"),
    event("u", "s", "a", 0, sequence_in_session=1, action="Connexion", page="p1", route=" ", status="ok", ip="1", device="d", ip_country="BE", country_code="FR", is_weekend=0,
          unique_ips_in_session=1, unique_devices_in_session=1, session_risk_score=10.0, time_delta_since_last_action=0),
    event("u", "s", "c", 90, sequence_in_session=3, action="Profil", route="/b", status="PENDING", ip="", device=None, is_weekend=1, unique_ips_in_session=9, unique_devices_in_session=9,
          is_ip_changed=1, is_download_action=1, downloads_last_2_minutes=1, ping_pong_count=2, cumulative_kos=1, time_delta_since_last_action=90, is_anomaly=1, anomaly_type="geo_jump",
          response_data_size_bytes=7, hour_of_day=9),
    event("u", "s", "d", 60, sequence_in_session=4, action=None, route="/a", status="KO", ip="2", device="e", unique_ips_in_session=2, unique_devices_in_session=2, is_device_changed=1,
          longest_ko_streak=1, cumulative_kos=2, session_risk_score=None, anomaly_type="skip_login"),
    event("u", "t", "e", 5, action="Deconnexion", status="OK"), event("u", "t", "f", 7, action="x"), event("u", "t", "g", 9, action="y"),
    event("v", "s", "h", None, action="timeless", status="KO", session_risk_score=99.0),
]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA)


def by_session(df):
    return {(r.insured_id, r.session_id): {k: v for k, v in r.asDict(recursive=True).items() if k not in KEYS} for r in df.collect()}


WANT = {
    "country_code": "BE", "session_start": T0, "session_end": T0 + timedelta(seconds=90), "start_hour": 23, "end_hour": 0, "day_of_week": 4, "is_weekend": 1, "first_action": "Connexion",
    "last_action": "Profil", "first_route": "/b", "last_route": "/a", "total_events": 4, "total_duration_seconds": 90, "avg_inter_action_seconds": 30.0, "min_inter_action_seconds": 0.0,
    "max_inter_action_seconds": 0.0, "unique_actions": 3, "unique_routes": 2, "unique_ips_used": 2, "unique_devices_used": 2, "total_kos": 2, "total_oks": 1, "longest_ko_streak": 1, "has_login": 1,
    "has_logout": 0, "ip_changed": 1, "device_changed": 1, "total_download_actions": 1, "max_downloads_in_2_minutes": 1, "ping_pong_count": 2, "risk_score_max": 40.0, "risk_score_avg": 25.0,
    "ended_abruptly": 1, "anomaly_event_count": 1, "action_sequence_signature": "Connexion > Profil > Profil > ", "route_sequence_signature": "/b > /a", "primary_anomaly_type": "geo_jump",
    "anomaly_types": ["geo_jump", "skip_login"], "campaign_ids": [], "action_sequence": ["Connexion", "Profil", "Profil", ""], "route_sequence": ["/b", "/a"],
    "action_counts": {"Connexion": 1, "Profil": 2, "": 1},
}


def test_live_summary_by_hand(spark):
    got = by_session(live.live_summaries(frame(spark, EVENTS)))
    assert got["u", "s"] == WANT
    assert (got["u", "t"]["ended_abruptly"], got["u", "t"]["has_logout"], got["u", "t"]["first_route"], got["u", "t"]["primary_anomaly_type"]) == (0, 1, "", "normal")
    empty = got["v", "s"]
    assert {k for k, v in empty.items() if v is not None} == {"primary_anomaly_type", "anomaly_types", "campaign_ids", "action_sequence", "route_sequence", "action_counts"}
    assert empty["primary_anomaly_type"] == "normal" and not any(empty[k] for k in ("anomaly_types", "action_sequence", "action_counts"))


def test_live_summary_of_totals_and_of_few_events(spark):
    alone = by_session(live.live_summaries(frame(spark, EVENTS), recent=0))["u", "s"]
    changed = {k for k in WANT if alone[k] != WANT[k]}
    assert changed == {"first_route", "last_route", "unique_actions", "unique_routes", "primary_anomaly_type", "anomaly_types", "action_sequence", "route_sequence", "action_counts",
                       "action_sequence_signature", "route_sequence_signature"}
    assert (alone["action_sequence"], alone["unique_actions"], alone["first_route"], alone["action_counts"]) == (["Connexion", "Profil"], 1, None, {"Connexion": 1, "Profil": 1})
    two = by_session(live.live_summaries(frame(spark, EVENTS), recent=2))["u", "s"]
    assert (two["action_sequence"], two["route_sequence"], two["total_events"]) == (["Profil", ""], ["/b", "/a"], 4)
    assert live.live_summaries(frame(spark, [])).count() == 0


def test_live_summary_shuffles_once(spark):
    plan = live.live_summaries(frame(spark, EVENTS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_in_any_order_equals_batch(spark, tmp_path, parts):
    sessions.state_store(spark)
    r = random.Random(parts)
    more = [event(f"u{k % 3}", "s", f"e{k:03}", r.randrange(5000), sequence_in_session=r.choice([None, k]), action=r.choice("abc"), route=r.choice(["/x", "/y", None]), status=r.choice(["OK", "KO"]),
                  session_risk_score=float(r.randrange(99)), time_delta_since_last_action=r.randrange(9), anomaly_type=r.choice(["normal", "t1", "t2"])) for k in range(240)]
    rows = EVENTS + more
    r.shuffle(rows)
    source = tmp_path / "in"
    source.mkdir()
    for k in range(parts):
        (source / f"{k}.json").write_text("\n".join(json.dumps(x, default=lambda t: t.isoformat() + "Z") for x in rows[k::parts]))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    last = {}

    def keep(batch, number):
        last.update(by_session(batch))

    q = live_stream.live_summaries(stream, recent=7, keep_seconds=None).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    assert last == by_session(live.live_summaries(frame(spark, rows), recent=7))


FIELDS = {"name": ("$.name", "string"), "score": ("$.risk.score", "double")}


def test_payloads_of_every_shape(spark):
    rows = [
        (1, '[{"name":"a","risk":{"score":1.5}}, {"name":"b"}, null]'), (2, '{"items":[{"name":"c","risk":{"score":2}}], "data":[{"name":"no"}]}'), (3, '{"data":[{"name":"d"}], "items":7}'),
        (4, '{"name":"e","risk":{"score":"3.5"}}'), (5, '{"name": broken'), (6, "  "), (7, None), (8, "[]"), (9, '{"items":[]}'), (10, '"text"'), (11, "null"), (12, "[1, {}]"),
        (13, "{}"), (14, '{"items":{"name":"inner"},"name":"outer"}'), (15, '[[{"name":"deep"}]]'), (16, '[{"name":5,"risk":[1]}] '),
    ]
    df = spark.createDataFrame(rows, "k int, payload string").withColumns({"shape": F.lit("x"), "item": F.lit(1)})
    got = [(r.k, r.shape, r.place, r.name, r.score) for r in payloads.list_items(df, "payload", FIELDS).orderBy("k", "place").collect()]
    assert got == [
        (1, "array", 0, "a", 1.5), (1, "array", 1, "b", None), (1, "array", 2, None, None), (2, "items", 0, "c", 2.0), (3, "data", 0, "d", None), (4, "object", 0, "e", 3.5),
        (13, "object", 0, None, None), (14, "object", 0, "outer", None), (16, "array", 0, "5", None),
    ]
    one = {r.k: (r.name, r.score) for r in payloads.one_object(df, "payload", FIELDS).collect()}
    assert len(one) == 16 and {k for k, v in one.items() if v != (None, None)} == {4, 14}
    assert payloads.list_items(df.limit(0), "payload").count() == 0


def test_payloads_are_parsed_once(spark):
    df = payloads.list_items(spark.createDataFrame([(1, "[{}]")], "k int, payload string"), "payload", FIELDS)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 2


def test_running_states_end_in_the_session_states(spark):
    df = frame(spark, EVENTS)
    ends = by_session(live.session_states(df))
    rows = live.running_states(df)
    last = {(r.insured_id, r.session_id): r.asDict(recursive=True) for r in rows.orderBy("events").collect()}
    for key, want in ends.items():
        assert {k: last[key][k] for k in want if k != "recent"} == {k: v for k, v in want.items() if k != "recent"}
    steps = [(r.id, r.events, r.failures_in_a_row, r.most_failures_in_a_row, r.first["action"]) for r in rows.where("session_id = 's' and insured_id = 'u'").orderBy("events").collect()]
    assert steps == [("a", 1, 0, 0, "Connexion"), ("b", 2, 1, 1, "Connexion"), ("c", 3, 0, 1, "Connexion"), ("d", 4, 1, 1, "Connexion")]
