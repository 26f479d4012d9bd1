"""Lists, details, features and models with results worked out by hand."""

import json
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import counters, details, models, profiles, sequences, sessions, summary
from tidemark.streaming import sinks

T0 = datetime(2025, 1, 1, 10)
EVENT = "insured_id string, session_id string, sequence_in_session int, id string, created_at timestamp, action string, type string, status string, ip string, device string, country_code string, route string, is_download_action int, anomaly_type string, is_anomaly int"


def test_keys_fold_letters_of_any_language(spark):
    words = ["Šárka", "ŽELEZO", "Erdő", "ā̄b", "Ćwikła", "Ñandú", "Άλφα", "Йод", "L’été", " Ấm ", "DÃ©connexion", None, "日本", "straße"]
    got = [r.k for r in spark.createDataFrame([(w,) for w in words], "x string").select(text.comparison_key(F.col("x")).alias("k")).collect()]
    assert got == ["sarka", "zelezo", "erdo", "ab", "cwikła", "nandu", "αλφα", "иод", "l'ete", "am", "deconnexion", "", "日本", "straße"]
    assert got == [text.python_key(w) for w in words]
    plan = spark.range(1).select(text.comparison_key(F.lit("é")).alias("k"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 6 * sum(len(x) for x in text.FOLDS) + 4_000


def test_templates_of_requests(spark):
    known = [("GET", "/users"), ("GET", "/users/{id}"), ("GET", "/a.b/*"), ("POST", "/users")]
    rows = [("GET", "/users", "/users"), ("get", "/users?x=1", "/users"), ("GET", "/users/7?x", "/users/{id}"), ("GET", "/users/7/8", "UNTRACKED"), ("GET", "/a.b/c/d", "UNTRACKED"), ("GET", "/a.b/c", "/a.b/*"), ("GET", "/axb/c", "UNTRACKED"), ("DELETE", "/users", "UNTRACKED"), ("POST", None, "UNTRACKED")]
    df = spark.createDataFrame([r[:2] for r in rows], "m string, p string")
    assert [r.t for r in df.select(text.template_of(F.col("m"), F.col("p"), known).alias("t")).collect()] == [r[2] for r in rows]


def test_payloads_of_other_events_are_never_shown(spark):
    own = lambda **x: json.dumps(x)
    at = lambda h: T0 + timedelta(hours=h)
    rows = [
        ("e1", "u", "s", at(0), own(eventId="e1", eventMetadata={"recordId": "e1"})), ("e2", "u", "s", at(0), own(eventId="e1")), ("e3", "u", "s", at(0), own(eventId="e3", data={"eventId": "e9"})),
        ("e4", "u", "s", at(0), None), ("e5", "u", "t", at(0), " "), ("e6", "u", "s", at(0), "no json"), ("e7", "x", "y", at(0), None), ("e1", "u", "s", at(-1), own(eventId="e8")), (None, "u", "s", at(0), own(eventId="e1")),
    ]
    analyses = [("u", "s", at(1), own(contextEventId="e4")), ("u", "s", at(0), own(eventId="e7")), ("u", "t", at(0), own(eventId="e4"))]
    got = details.alert_details(
        spark.createDataFrame(rows, "event_id string, insured_id string, session_id string, detected_at timestamp, payload string"),
        spark.createDataFrame(analyses, "insured_id string, session_id string, created_at timestamp, payload string"),
    )
    out = {r.event_id: (r.source, r.warning, r.shown_payload) for r in got.collect()}
    assert {k: v[:2] for k, v in out.items()} == {
        "e1": ("sql-payload", None), "e2": ("sql", "sql_payload_event_mismatch"), "e3": ("sql", "sql_payload_event_mismatch"), "e4": ("sql-payload", None),
        "e5": ("sql", "sql_payload_event_mismatch"), "e6": ("sql", "sql_payload_event_mismatch"), "e7": ("sql", "exact_event_payload_unavailable"),
    }
    assert out["e1"][2] == rows[0][4] and out["e4"][2] == analyses[0][3] and out["e2"][2] is None and got.limit(0).count() == 0


def test_pages_know_how_many_alerts_there_are(spark):
    rows = spark.createDataFrame([(k, T0 + timedelta(minutes=k), T0) for k in range(7)], "event_id long, timestamp timestamp, created_at timestamp")
    got = [details.page_of(rows, 3, at).collect() for at in (0, 3, 6, 9)]
    assert [[r.event_id for r in g] for g in got] == [[6, 5, 4], [3, 2, 1], [0], []] and [g[0].has_more for g in got[:3]] == [True, True, False] and got[0][0].total == 7
    assert [r.event_id for r in details.trimmed(rows, "event_id", 7, 2).collect()].__len__() == 7
    assert sorted(r.event_id for r in details.trimmed(rows, "event_id", 6, 2).collect()) == [5, 6]


def test_buffer_keeps_one_event_without_id(spark):
    rows = [("u", "s", None, 3), ("u", "s", None, 1), ("u", "s", "a", 2), ("u", "s", "a", 4), ("u", "t", None, 5)]
    got = details.buffered(spark.createDataFrame(rows, "insured_id string, session_id string, id string, at int"), "at").collect()
    assert sorted((r.session_id, r.id or "", r["at"]) for r in got) == [("s", "", 1), ("s", "a", 2), ("t", "", 5)]


def test_security_overview_of_a_day(spark):
    """Four events and two alerts that day give a rate of 0.5, whatever the sessions' scores are."""
    at = lambda h: datetime(2025, 1, 2) + timedelta(hours=h)
    events = spark.createDataFrame([(at(h),) for h in (-1, 0, 1, 2, 23, 24)], "created_at timestamp")
    anomalies = spark.createDataFrame([(at(1), "b"), (at(2), " "), (at(-1), "c"), (at(24), "c")], "detected_at timestamp, anomaly_type string")
    rows = [("s1", "u", at(1), 85.0, ["R", "Q"]), ("s2", "u", at(2), 60.0, ["R"]), ("s3", "v", at(0), 10.0, []), ("s4", "w", at(3), None, ["Q", "R"])]
    df = spark.createDataFrame(rows, "session_id string, insured_id string, end_time timestamp, final_risk_score double, rule_codes array<string>")
    r = counters.security_overview(df, events, anomalies, "2025-01-02").first()
    assert (r.total_events, r.alerts, r.anomaly_rate, r.sessions, r.critical, r.high, r.active_users) == (4, 2, 0.5, 4, 1, 1, 3)
    assert abs(r.avg_risk - 155 / 3) < 1e-9 and r.top_types == ["b"] and r.top_rules == ["R", "Q"]
    assert counters.security_overview(df, events, anomalies, "2025-01-02", latest=1).first().active_users == 1
    none = counters.security_overview(df.limit(0), events.limit(0), anomalies.limit(0), "2025-01-02").first()
    assert (none.total_events, none.anomaly_rate, none.avg_risk, none.top_rules) == (0, 0.0, 0.0, [])


def test_churn_dashboard_of_the_latest_sessions(spark):
    rows = [(f"s{k:02d}", f"u{k % 20}", T0 + timedelta(hours=k), p) for k, p in enumerate([0.9] * 5 + [None] + [0.7, 0.3, 0.29] + [0.5] * 50)]
    df = spark.createDataFrame(rows, "session_id string, insured_id string, end_time timestamp, churn_probability double")
    r = profiles.churn_dashboard(df).first()
    assert (r.high, r.medium, r.low, r.avg_probability) == (0, 50, 0, 0.5) and r.top_sessions == [f"s{k:02d}" for k in range(9, 19)]
    r = profiles.churn_dashboard(df, latest=59).first()
    assert (r.high, r.medium, r.low) == (6, 51, 1) and r.top_sessions[:6] == ["s00", "s01", "s02", "s03", "s04", "s06"]
    assert [x.insured_id for x in profiles.top_churn_users(df, 3).collect()] == ["u0", "u1", "u10"]


def test_churn_features_of_a_session(spark):
    rows = [
        ("u", "s", k, str(k), T0 + timedelta(seconds=20 * k), "Profil", kind, status, "1", device, country, "/a", 0, "x" if k == 3 else "normal", int(k == 3))
        for k, (kind, status, device, country) in enumerate([("BANKING_ACTIONS", "OK", "Mobile Phone", "FR"), ("open_x", "KO", "Desktop", "fr "), ("Logging", "KO", "desktop", None), (None, "OK", "MOBILE phone", "BE")])
    ]
    e = sessions.enrich(spark.createDataFrame(rows, EVENT))
    r = profiles.churn_session_features(e, summary.summarize(e)).first().asDict()
    assert len(r) == 2 + 32
    assert (r["total_actions"], r["failure_rate"], r["pct_banking_actions"], r["pct_open_actions"], r["pct_logging_actions"], r["pct_contact_actions"]) == (4, 0.5, 0.25, 0.25, 0.25, 0.0)
    assert (r["mobile_ratio"], r["desktop_ratio"], r["fr_events_ratio"], r["business_hours_ratio"], r["anomaly_ratio"]) == (0.5, 0.5, 0.5, 1.0, 0.25)
    # two of each: the first seen
    assert (r["primary_device"], r["primary_browser"], r["avg_inter_action_ms"], r["avg_session_duration_ms"]) == ("mobile-phone", None, 20_000.0, 60_000.0)


def test_coverage_lists_five_unknown_values(spark):
    rows = [(v,) for v in "aabbbccddeeffg"] + [("ok",)] * 3 + [(None,)]
    r = counters.field_coverage(spark.createDataFrame(rows, "f string"), {"f": ["ok"]}).first()
    assert (r.known, r.unknown, r.warn) == (3, 15, True) and r.most_frequent_unknown == ["b", "a", "c", "d", "e"]
    t = counters.tabular_coverage(spark.createDataFrame([("1",), ("x",), (None,), ("Infinity",), ("0",)], "n string"), {"n": 0}).first()
    assert (t["values"], t.missing, t.mismatched, t.non_finite, t.defaulted, t.at_default) == (5, 1, 1, 1, 3, 1)


def test_time_since_previous_and_supplied_values(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("u", "s", 1, "a", at(0), 0), ("u", "s", 2, "b", at(3), 3500), ("u", "s", 3, "c", at(2), 5000), ("u", "s", 4, "d", None, 700), ("u", "s", 5, "e", at(9), None)]
    df = spark.createDataFrame(rows, "insured_id string, session_id string, sequence_in_session int, id string, created_at timestamp, given long")
    got = [(r.ms_since_previous, r.ms_mismatch) for r in sequences.time_since_previous(df, "given").orderBy("id").collect()]
    assert got == [(0, False), (3000, False), (0, True), (700, False), (0, False)]


def test_recent_events_and_live_summary(spark):
    rows = [("u", "s", k, str(k), T0 + timedelta(seconds=k), f"a{k % 3}", "t", "KO" if k < 5 else "OK", "1" if k < 59 else "2", "d", "FR", "/a", k % 2, "normal", 0) for k in range(60)]
    e = sessions.enrich(spark.createDataFrame(rows, EVENT))
    assert sorted(int(r.id) for r in summary.recent_events(e).collect()) == list(range(10, 60))
    r = summary.live_summary(e).first()
    assert (r.events, r.kos, r.recent_events, r.recent_kos, r.recent_actions, r.recent_ips, r.recent_downloads, r.first_action, r.last_action, r.avg_pause) == (60, 5, 50, 0, 3, 2, 0, "a0", "a2", 1.0)


def test_trained_trees_tell_classes_apart(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    rows = [(float(a), None if k % 50 == 0 else float(b), int(a > 0.5), int(3 * a)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, y int, z int")
    train, test = df.limit(400), df.offset(400)
    got = models.predict_with(models.train_classifier(train, ["a", "b"], "y", maxIter=5), test, ["a", "b"])
    assert got.where("prediction = y").count() > 190 and got.where("score > 50").count() == got.where("prediction = 1").count()
    several = models.predict_with(models.train_classifier(train, ["a", "b"], "z", "forest", numTrees=10), test, ["a", "b"])
    assert several.where("prediction = z").count() > 185
    assert models.impute_medians(df, df.where("b is null"), ["b"]).where("b between 0.4 and 0.6").count() == 12


def test_dead_letters_go_to_their_own_table(spark, tmp_path):
    batch = spark.createDataFrame([("good",), ("bad",), ("good",)], "value string")
    write = sinks.split_dead_letters(str(tmp_path / "good"), str(tmp_path / "dead"), lambda b: (b.where("value = 'good'"), b.where("value <> 'good'")))
    write(batch, 1), write(batch, 1), write(batch.limit(1), 2)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert [r.value for r in dead] == ["bad"] and dead[0].processed_at is not None


def test_lag_of_sources():
    progress = {"sources": [{"endOffset": '{"t":{"0":10,"1":5}}', "latestOffset": {"t": {"0": 14, "1": 3}}}, {"endOffset": None, "latestOffset": None}]}
    assert sinks.source_lag(progress) == 4 and sinks.source_lag({}) == 0
