"""Small functions and readers, each against values worked out by hand."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores, text
from tidemark.operators import views
from tidemark.sources import audit


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_families_of_routes(spark):
    rows = [(x,) for x in ("login", " LogOut ", "documents", "refunds", "home", "bankinginformation", "Address", "file", "/login", "", None)]
    assert values(spark, rows, "r string", text.route_family(F.col("r"))) == ["auth", "auth", "documents", "insured", "home", "bankinginformation", "insured", "documents", None, None, None]


def test_hashes_and_summaries_of_evidence(spark):
    rows = [(1, "a", 2.5, None), (1, "a", 2.5, None), (2, None, None, "x")]
    df = spark.createDataFrame(rows, "i int, s string, d double, f string")
    got = [r[0] for r in df.select(text.evidence_hash(F.struct("i", "s", "d"))).collect()]
    assert got[0] == got[1] == hashlib.sha256(b'{"i":1,"s":"a","d":2.5}').hexdigest() and got[2] == hashlib.sha256(b'{"i":2}').hexdigest()
    shown = [r[0] for r in df.select(text.evidence_summary(F.col("d"), F.col("s"), F.col("i"), F.col("f"))).collect()]
    assert shown[0] == "risk=2.5; level=a; type=1; fallback=null" and shown[2] == "risk=null; level=null; type=2; fallback=x"


def test_family_of_a_path(spark):
    rows = [(x,) for x in ("/api_template", "/v1/Bank-Data/7?q", "/v2/v1/Users", "plain", "/", "?x", None)]
    assert values(spark, rows, "p string", text.path_family(F.col("p")))[1:4] == ["bank_data", "users", "plain"]


def test_scalers(spark):
    rows = [(5.0,), (-100.0,), (100.0,), (None,), (float("nan"),), (float("inf"),)]
    clipped = values(spark, rows, "x double", scores.clip_scaled(F.col("x"), -10.0, 10.0, 1.0, 2.0))
    assert clipped[:3] == [2.0, -5.5, 4.5]
    assert values(spark, rows, "x double", scores.clip_scaled(F.col("x"), -10.0, 10.0, 1.0, 0.0))[:3] == [4.0, -11.0, 9.0]
    standard = values(spark, rows, "x double", scores.standardized(F.col("x"), 1.0, 2.0))
    assert standard[:3] == [2.0, -50.5, 49.5] and all(v == 0.0 for v in standard[3:])


def test_csv_with_sessions_that_fill_gaps(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,sessionId,insuredId,createdAt,action,country_code,is_anomaly\n1,s,u,2025-01-01T10:00:00Z,view,FR,1\n2,s,u,2025-01-01T10:00:05Z,click,,\n3,t,u,bad,x,,\n")
    (tmp_path / "s.csv").write_text("session_id,country_code,device\ns,BE,phone\ns,DE,other\n,ES,none\n")
    rows = {r.id: r for r in audit.read_csv(spark, str(tmp_path / "e.csv"), str(tmp_path / "s.csv")).collect()}
    assert (rows["1"].country_code, rows["1"].is_anomaly, rows["1"].created_at.hour, rows["1"].insured_id) == ("FR", 1, 10, "u")
    assert rows["2"].country_code == "BE" and rows["2"].device == "phone" and rows["3"].country_code is None and rows["3"].created_at is None and len(rows) == 3
    assert audit.read_csv(spark, str(tmp_path / "e.csv")).count() == 3


def test_fields_fall_back(spark):
    row = {"insured_id": "u", "session_id": "s", "action": " ", "action_value": None, "frontend_action_name": "DÃ©connexion", "route": None, "page": "", "api_template": "/t", "action_type": " T ",
           "country_code": "", "ip_country": "FR", "session_action_seq": 7}
    good, dead = audit.parse_json(spark.createDataFrame([(json.dumps(row),), ("{",), (" ",), (None,)], "value string"))
    r = audit.with_fallbacks(good).first()
    assert (r.action, r.route, r.type, r.country_code, r.sequence_in_session) == ("Déconnexion", "/t", "T", "FR", 7)
    assert [(x.reason, x.value) for x in dead.collect()] == [("invalid_json", "{")]


def test_user_view_of_one_side_alone(spark):
    sessions = spark.createDataFrame([("u", "s", None)], "insured_id string, session_id string, end_time timestamp")
    odd = spark.createDataFrame([("v", "e", None, "critical", True), (None, "x", None, "critical", True)], "insured_id string, event_id string, event_time timestamp, anomaly_tier string, anomaly_flag boolean")
    got = {r.insured_id: r for r in views.user_view(sessions, odd).collect()}
    u, v = got["u"], got["v"]
    assert set(got) == {"u", "v"} and (u.churn_risk_level, u.churn_probability, u.average_risk, u.alert_count, u.latest_session) == ("UNKNOWN", 0.0, None, 0, "s")
    assert (v.alert_count, v.critical_alert_count, v.latest_session, v.usual_active_hours, v.top_api_families, len(v.risk_timeline), v.recent_sessions) == (1, 1, None, [], [], 1, [])
    many = spark.range(500).select(F.lit("u").alias("insured_id"), F.col("id").cast("string").alias("session_id"), F.timestamp_seconds("id").alias("end_time"))
    (r,) = views.user_view(many, odd.limit(0)).collect()
    assert [x.session_id for x in r.recent_sessions] == [str(499 - k) for k in range(10)]
    plan = views.user_view(many, odd)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_history_of_forecasts(spark):
    days = spark.createDataFrame([("2025-01-01", 4, 1), ("2025-01-02", 0, 0), ("2025-01-08", 5, None)], "d string, total_events int, alerts int").withColumn("ds", F.to_date("d"))
    at = lambda today: views.forecast_history(days, today).first()
    r = at("2025-01-08")
    assert [(str(x.date), x.value) for x in r.total_events] == [("2025-01-01", 4)] and [x.value for x in r.anomaly_rate] == [0.25] and r.warning == "forecast_history_partial"
    assert at("2025-02-08").warning == "forecast_history_unavailable" and [x.value for x in at("2025-01-09").anomaly_rate] == [0.0]
    full = spark.range(7).select(F.date_add(F.lit("2025-03-01").cast("date"), F.col("id").cast("int")).alias("ds"), F.lit(2).alias("total_events"), F.lit(1).alias("alerts"))
    assert views.forecast_history(full, "2025-03-08").first().warning is None and math.isclose(views.forecast_history(full, "2025-03-08").first().anomaly_rate[0].value, 0.5)


def test_settings_of_a_configuration():
    from tidemark.functions.params import GENERATED, Params, params_of

    got = params_of({"sessions": {"gap_seconds": 600, "end_actions": ["x"]}, "fusion": {"alert": 50}})
    assert (got.sessions.gap_seconds, got.sessions.end_actions, got.fusion.alert, got.sessions.grace_seconds, got.rules) == (600, ("x",), 50.0, 60, Params().rules)
    assert params_of({}, GENERATED) == GENERATED and params_of({"profile": {"anomaly_at": 1.5}}, GENERATED).features == GENERATED.features
    for bad in ({"session": {}}, {"sessions": {"gap": 1}}, {"sessions": {"gap_seconds": "600"}}, {"fusion": {"renormalize": 1}}):
        with pytest.raises(ValueError):
            params_of(bad)


def test_labels_are_repaired_with_replacement_characters(spark):
    """Worked out by hand: UTF-8 read as Latin-1 once and twice, lone lead bytes, what Latin-1 lacks, blanks that a repair brings to an end."""
    twice = "déjà".encode().decode("latin-1").encode().decode("latin-1")
    want = {
        "Ã©tÃ©": "été", twice: "déjà", "Ã": "?", "aÃb": "a?b", "Ã©€": "é?", "\ufffd": "?", "\t ok\n": "ok", "plain €": "plain €", "": "",
    }
    df = spark.createDataFrame([(k, v) for k, v in want.items()] + [(None, None)], "t string, v string")
    got = df.select("t", "v", text.normalize_label(F.col("t")).alias("g"), text.comparison_key(F.col("t")).alias("k")).collect()
    assert [r.g for r in got] == [r.v for r in got]
    assert [r.k for r in got] == [text.python_key(r.t) for r in got]
