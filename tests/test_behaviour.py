"""Small fixtures for the rules that the generated events do not reach: nulls, blanks, ties, order, boundaries."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import scores, text
from tidemark.functions.params import FeatureParams, FusionParams, ProfileParams, RuleParams
from tidemark.operators import alerts, counters, forecast, fusion, models, profiles, rules, sequences, sessions, summary
from tidemark.sources import audit

EVENT = "insured_id string, session_id string, sequence_in_session int, id string, created_at timestamp, action string, type string, status string, ip string, device string, country_code string, route string, anomaly_type string, is_anomaly int, is_download_action int"
T0 = datetime(2025, 1, 1, 3, 0, 0)


def event(i, seconds, action, status="OK", ip="1.1.1.1", device="WEB", seq=None, session="s", country="FR", type_="LOGGING_ACTIONS", kind=None):
    at = None if seconds is None else T0 + timedelta(seconds=seconds)
    return ("u", session, seq, str(i), at, action, type_, status, ip, device, country, "/r", kind, 0, None)


def enriched(spark, rows, p=FeatureParams()):
    return sessions.enrich(spark.createDataFrame(rows, EVENT), p)


def test_enrichment_of_three_events(spark):
    rows = [
        event(1, 0, "Connexion", seq=1), event(2, 5, "Ouverture d'un document contractuel", "KO", seq=2),
        event(3, 9, "Connexion", ip="2.2.2.2", device="MOBILE_ANDROID", seq=3),
    ]
    got = enriched(spark, rows).orderBy("id").collect()
    assert [r.prev_action for r in got] == ["", "Connexion", rows[1][5]]
    assert [r.time_delta_since_last_action for r in got] == [0, 5, 4]
    assert [(r.is_ip_changed, r.is_device_changed) for r in got] == [(0, 0), (0, 0), (1, 1)]
    assert [r.is_download_action for r in got] == [0, 1, 0]
    assert [r.has_logged_in for r in got] == [0, 1, 1]
    assert [r.ping_pong_count for r in got] == [0, 0, 1]
    assert [r.session_risk_score for r in got] == [15.0, 40.0, 85.0]


def by_hand(rows):
    """The features of one session by a plain loop over its ordered events."""
    rows = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[4] is None, r[4] or T0, r[3]))
    out, downs, ips, devs, kos, run, best, pongs, logged = {}, [], set(), set(), 0, 0, 0, 0, 0
    acts = [text.python_key(r[5]) for r in rows]
    for k, r in enumerate(rows):
        if r[8] and r[8].strip():
            ips.add(r[8])
        if r[9] and r[9].strip():
            devs.add(r[9])
        ko = (r[7] or "").upper() == "KO"
        kos, run = kos + ko, run + 1 if ko else 0
        best = max(best, run)
        pongs += k >= 2 and acts[k] == acts[k - 2] and acts[k] != acts[k - 1]
        is_down = any(w in acts[k] for w in FeatureParams().download_words)
        if is_down:
            downs.append(r[4])
        recent = 0 if r[4] is None else sum(d is not None and 0 <= (r[4] - d).total_seconds() < 121 for d in downs)
        changed = lambda a, b: int(bool(a and a.strip() and b and b.strip() and a != b))
        out[r[3]] = (kos, best, pongs, max(1, len(ips)), max(1, len(devs)), recent, logged, changed(r[8], rows[0][8]), changed(r[9], rows[0][9]), rows[k - 1][5] or "" if k else "")
        logged |= r[5] in FeatureParams().login_actions
    return out


def test_enrichment_like_a_loop(spark):
    rng, rows = random.Random(3), []
    for s in range(25):
        at = 0
        for k in range(rng.randint(1, 30)):
            at += rng.choice([0, 0, 1, 40, 100, 121, 500])
            rows.append(event(f"{s:02d}{k:03d}", at, rng.choice(["Connexion", "Téléchargement", "Wallet", "Profil", None]), rng.choice(["OK", "KO", "ko", None]), rng.choice(["1", "2", "", None]), rng.choice(["a", "b", " ", None]), session=str(s)))
    got = enriched(spark, rows).collect()
    want = {}
    for s in range(25):
        want |= by_hand([r for r in rows if r[1] == str(s)])
    for r in got:
        assert (
            r.cumulative_kos, r.longest_ko_streak, r.ping_pong_count, r.unique_ips_in_session, r.unique_devices_in_session, r.downloads_last_2_minutes,
            r.has_logged_in, r.is_ip_changed, r.is_device_changed, r.prev_action,
        ) == want[r.id]


def test_download_window_holds_whole_seconds_and_no_later_peers(spark):
    rows = [event(1, 0, "wallet"), event(2, 0, "wallet"), event(3, 120.9, "wallet"), event(4, 121, "wallet")]
    assert [r.downloads_last_2_minutes for r in enriched(spark, rows).orderBy("id").collect()] == [1, 2, 3, 2]


def test_enrichment_shuffles_once(spark):
    plan = enriched(spark, [event(1, 0, "a")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_tables(spark):
    e = enriched(spark, [])
    assert e.count() == 0 and summary.summarize(e).count() == 0 and rules.rule_flags(e).count() == 0
    assert forecast.daily_series(e).count() == 0 and sequences.transitions(e).count() == 0


def test_null_times_stay_in_their_session(spark):
    rows = [event(1, None, "a"), event(2, 0, "b")]
    got = {r.id: r for r in enriched(spark, rows).collect()}
    assert got["2"].time_delta_since_last_action == 0 and got["1"].hour_of_day == 0 and got["1"].prev_action == "b"


def test_summary_counts_and_logout(spark):
    rows = [event(1, 0, "Connexion", kind="geo_jump"), event(2, 60, "Envoi d'un document", kind="data_exfiltration"), event(3, 61, "DÃ©connexion", kind="data_exfiltration")]
    df = spark.createDataFrame(rows, EVENT).withColumn("action", text.normalize_label(F.col("action")))
    got = summary.summarize(sessions.enrich(df)).first()
    assert (got.total_events, got.total_download_actions, got.has_login, got.has_logout, got.ended_abruptly) == (3, 1, 1, 1, 0)
    assert got.primary_anomaly_type == "data_exfiltration" and got.action_counts["Connexion"] == 1 and got.last_action == "Déconnexion"


def test_sessions_split_at_the_gap(spark):
    rows = [event(k, s, "a", session=None) for k, s in enumerate([0, 1199, 2399, 3598])]
    got = sessions.assign_sessions(spark.createDataFrame(rows, EVENT).drop("session_id")).orderBy("id").collect()
    assert [r.session_id for r in got] == ["u-0", "u-0", "u-1", "u-1"]


def test_rules_of_a_session(spark):
    rows = [event(k, k, "Autre", "KO", country="FR" if k < 2 else "BE") for k in range(3)] + [event(9, 2000, "Autre")]
    f = rules.rule_flags(enriched(spark, rows))
    assert rules.triggered(f).first().triggered_rules == ["unusual_hour", "skip_login", "repeated_fail", "rapid_fire", "geo_jump", "session_timeout"]


def test_rule_codes(spark):
    df = spark.createDataFrame([(r,) for r in ["unusual_hour", "Skip_Login", " ", None, "own_rule"]], "r string")
    assert [x.c for x in df.select(rules.canonical(F.col("r")).alias("c")).collect()] == ["OFF_HOURS_ACCESS", "SKIP_LOGIN", "UNKNOWN_RULE", "UNKNOWN_RULE", "OWN_RULE"]


FUSED = "xgboost_score double, lightgbm_score double, transformer_score double, tcn_score double, rule_score double, business_context_score double, aggregation_boost double"


@pytest.mark.parametrize(
    "row, final, level, mode",
    [
        ((90.0, 80.0, 70.0, 60.0, 50.0, 0.0, 0.0), 74.5, "HIGH", "FULL_HYBRID"),
        ((None, None, None, None, 65.0, 0.0, 5.0), 70.0, "HIGH", "RULES_ONLY"),
        ((0.0, 0.0, 99.59, None, 35.0, 0.0, 0.0), 99.59 * (0.2 + 0.1 * 0.2 / 0.75) + 5.25, "LOW", "PARTIAL_HYBRID"),
        ((50.0, None, None, None, 0.0, 0.0, 0.0), 42.5, "MEDIUM", "TABULAR_RULES"),
        ((None, None, 50.0, None, 0.0, 0.0, 0.0), 42.5, "MEDIUM", "SEQUENCE_RULES"),
        ((None, None, None, None, None, None, None), 0.0, "LOW", "RULES_ONLY"),
    ],
)
def test_fusion(spark, row, final, level, mode):
    got = fusion.fuse(spark.createDataFrame([row], FUSED)).first()
    assert got.final_risk_score == pytest.approx(final) and (got.risk_level, got.fallback_mode) == (level, mode)


def test_levels_at_their_borders(spark):
    df = spark.createDataFrame([(x,) for x in [34.99, 35.0, 59.99, 60.0, 79.99, 80.0, -1.0, 120.0]], "x double")
    assert [r.l for r in df.select(scores.risk_level(F.col("x")).alias("l")).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "LOW", "CRITICAL"]


def test_labels_and_keys(spark):
    df = spark.createDataFrame([(x,) for x in ["DÃ©connexion", " Déconnexion ", "deconnexion", None, "", "l’été", "Ã", "日本 Ã"]], "x string")
    got = [r.k for r in df.select(text.comparison_key(F.col("x")).alias("k")).collect()]
    assert got[:6] == ["deconnexion", "deconnexion", "deconnexion", "", "", "l'ete"] and len(got) == 8


def test_json_split(spark):
    ok = '{"record_id": "1", "insuredId": "u", "session_id": "s", "timestamp": "2025-01-01T00:00:00Z", "actionValue": "x"}'
    df = spark.createDataFrame([(ok, 1), ("{bad", 2), (None, 3), (" ", 4), ('{"id": "2", "insured_id": "u"}', 5)], "value string, offset long")
    good, dead = audit.parse_json(df)
    assert [(r.id, r.insured_id, r.action_value) for r in good.collect()] == [("1", "u", "x")]
    assert good.first().created_at == datetime(2025, 1, 1)
    assert [(r.reason, r.offset) for r in dead.collect()] == [("invalid_json", 2)]


def test_fill_never_overwrites(spark):
    a = spark.createDataFrame([("s", None, "x"), ("t", 1, "y")], "session_id string, n int, v string")
    b = spark.createDataFrame([("s", 5, "z")], "session_id string, n int, v string")
    assert sorted((r.n, r.v) for r in audit.fill_from(a, b, ["session_id"]).collect()) == [(1, "y"), (5, "x")]


def test_richest_alert_and_null_ids(spark):
    df = spark.createDataFrame([("e", None, 0), ("e", "HIGH", 1), ("e", "LOW", 2), (None, "HIGH", 3)], "event_id string, risk_level string, position int")
    assert [(r.event_id, r.position) for r in alerts.keep_richest(df, "position").collect()] == [("e", 1)]


def test_merge_keeps_rows_without_id(spark):
    a = spark.createDataFrame([("e", 1), (None, 2)], "event_id string, n int")
    b = spark.createDataFrame([("e", 3), ("f", 4), (None, 5)], "event_id string, n int")
    assert sorted(r.n for r in alerts.merge_missing(a, b).collect()) == [1, 2, 4, 5]


def test_profile_scale_is_a_parameter(spark):
    row = Row(insured_id="u", session_id="s", end_time=T0, final_risk_score=10.0, anomaly_type="x", session_duration_seconds=None, action_counts={"a": 1})
    df = spark.createDataFrame([row], "insured_id string, session_id string, end_time timestamp, final_risk_score double, anomaly_type string, session_duration_seconds long, action_counts map<string,long>")
    as_of = "2025-01-02 00:00:00"
    assert profiles.risk_profile(df, as_of).first().anomaly_count_30d == 1
    assert profiles.risk_profile(df, as_of, ProfileParams(anomaly_at=35.0)).first().anomaly_count_30d == 0


def test_snapshot_writes_changes_only(spark):
    v = spark.createDataFrame([("a", "k", 1), ("b", "k", 2)], "view_name string, snapshot_key string, n int").select("view_name", "snapshot_key", F.struct("n").alias("payload"))
    first = counters.snapshot(v, spark.createDataFrame([], "view_name string, snapshot_key string, payload_hash string"))
    assert first.count() == 2
    assert counters.snapshot(v, first.where("view_name = 'a'")).first().view_name == "b"


def test_trees_and_vectors():
    xgb = models.xgboost_json(
        '{"learner": {"objective": {"name": "binary:logistic"}, "learner_model_param": {"base_score": "0.5"}, "gradient_booster": {"model": {"trees": ['
        '{"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [1.5, -2.0, 2.0], "default_left": [1, 0, 0]}]}}}}'
    )
    x = np.array([[1.0], [1.5], [np.nan]])
    assert xgb.score(x) == pytest.approx(1 / (1 + np.exp([2.0, -2.0, 2.0])))
    lgbm = models.lightgbm_text("Tree=0\nnum_leaves=2\nsplit_feature=0\nthreshold=1.5\nleft_child=-1\nright_child=-2\nleaf_value=-1 3\n\nTree=1\nnum_leaves=1\nleaf_value=0.5\n", logistic=False)
    assert lgbm.score(np.array([[1.5], [1.6], [np.nan]])).tolist() == [-0.5, 3.5, -0.5]
    forest = models.forest_json('{"trees": [{"feature": [0, 0, 0], "threshold": [0, 0, 0], "children_left": [1, -1, -1], "children_right": [2, -1, -1], "value": [0, 0.2, 0.8]}, {"feature": [0], "threshold": [0], "children_left": [-1], "children_right": [-1], "value": [0.4]}]}')
    assert forest.score(np.array([[0.0], [1.0]])) == pytest.approx([0.3, 0.6])
    svm = models.OneClassSvm(np.array([[0.0]]), np.array([1.0]), -0.5, 1.0)
    assert svm.score(np.array([[0.0], [9.0]])) == pytest.approx([100 / (1 + np.exp(0.5)), 100 / (1 + np.exp(-0.5))])


def test_score_udf_and_missing_model(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    svm = models.OneClassSvm(np.array([[1.0]]), np.array([1.0]), 0.0, 1.0)
    assert df.select(models.score_with(svm, ["x"]).alias("s")).first().s == pytest.approx(100 / (1 + np.e))
    assert df.select(models.score_with(None, ["x"]).alias("s")).first().s is None


def test_clusters(spark):
    df = spark.createDataFrame([(float(x), 0.0) for x in [0, 1, 2, 100, 101, 102]], "a double, b double")
    got = models.clusters(df, ["a", "b"], k=2)
    assert models.cluster_means(got, ["a"]).orderBy("mean_a").first().mean_a == pytest.approx(1.0)


def test_sequence_surprise(spark):
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    c = sequences.sequence_surprise({"h": a(2, 0)}, {"h": F.lit(0)}, {"h": 2.0}, {"h": 0.5}, a(0, 0, 0), a(1, 2, 3))
    assert spark.range(1).select(c.alias("c")).first().c == pytest.approx(np.log(np.e**2 + 1) - 2 + 2.0)


def test_explicit_ends(spark):
    df = spark.createDataFrame([("DÃ©connexion",), ("sso disconnect",), ("Profil",), (None,)], "action string")
    assert [(r.ends_session, r.end_reason) for r in sessions.explicit_ends(df).collect()] == [(True, "explicit_logout"), (True, "explicit_sso_disconnect"), (False, None), (False, None)]


def test_alert_reasons(spark):
    p = FusionParams()
    rows = [(40.0, 0.0, True, ["A"]), (40.0, 0.0, True, []), (10.0, 70.0, False, ["A"]), (10.0, 70.0, False, []), (10.0, 0.0, False, ["A"])]
    df = spark.createDataFrame(rows, "final_risk_score double, ai_risk_score double, is_anomaly boolean, rule_codes array<string>")
    assert [r.alert_reason for r in fusion.decide_alerts(df, p).collect()] == ["RULE_AND_RISK", "ANOMALY_THRESHOLD", "RULE_TRIGGER", "UNKNOWN", "BELOW_THRESHOLD"]


def test_rule_params_change_rules(spark):
    rows = [event(k, 10 * k, "Connexion") for k in range(3)]
    e = enriched(spark, rows)
    assert not rules.rule_flags(e).first().rapid_fire
    assert rules.rule_flags(e, RuleParams(rapid_window_seconds=20)).first().rapid_fire
