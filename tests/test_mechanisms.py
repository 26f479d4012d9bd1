"""As-of predictions, leases, template tables, coverage, percentiles and alert lists: worked out by hand or against brute force."""

import json
import math
import random
import re
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, counters, details, requests, sequences
from tidemark.streaming import leases, sessions

T0 = datetime(2025, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- predictions -------------------------------------------------------------------------


def as_of(spark, events, made):
    e = spark.createDataFrame(events, "id string, session_id string, created_at timestamp, action string")
    p = spark.createDataFrame(made, "session_id string, context_event_id string, created_at timestamp, prediction string")
    return {r.id: (r.predicted_for, r.prediction) for r in sequences.predictions_as_of(e, p).collect()}, sequences.predictions_as_of(e, p)


def test_predictions_as_of(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    events = [("a", "s", at(0), "x"), ("b", "s", at(10), "x"), ("c", "s", at(20), "x"), ("d", "s", at(20), "x"), ("e", "s", at(90), "x"), ("f", "t", at(50), "x"), ("g", "s", None, "x"), ("h", None, at(99), "x"),
              ("i", "w", at(9), "x")]
    made = [
        ("s", "a", at(5), "pa"), ("s", "b", at(10), "pb at once"), ("s", "c", at(20), "pc"), ("s", "c", at(25), "pc again"), ("s", "e", at(80), "pe early"), ("s", "e", at(85), "pe"),
        ("t", "z", at(51), "too late"), ("s", "y", None, "no time"), (None, "y", at(0), "no session"), ("w", "i", at(1), "own alone"),
    ]
    got, df = as_of(spark, events, made)
    assert got == {
        "a": (None, None), "b": ("a", "pa"),  # the prediction of b's own context stood at once, and is passed over
        "c": ("b", "pb at once"), "d": ("c", "pc"), "e": ("c", "pc again"), "f": (None, None), "g": (None, None), "h": (None, None), "i": (None, None),
    }
    assert plan_of(df).count("Exchange hashpartitioning") == 1
    assert as_of(spark, [], made)[0] == {} and set(as_of(spark, events, [])[0].values()) == {(None, None)}


def test_predictions_as_of_against_brute_force(spark):
    r = random.Random(5)
    at = lambda: T0 + timedelta(seconds=r.randrange(60))
    events = [(f"e{k:03}", f"s{r.randrange(3)}", at(), "x") for k in range(120)]
    made = list({(s, c, t): (s, c, t, f"{c}/{t}") for s, c, t in ((f"s{r.randrange(3)}", f"e{r.randrange(120):03}", at()) for _ in range(200))}.values())
    want = {}
    for i, s, t, _ in events:
        before = [m for m in made if m[0] == s and m[2] <= t and m[1] != i]
        last = max(before, key=lambda m: (m[2], m[1]), default=None)
        want[i] = (last[1], last[3]) if last else (None, None)
    assert as_of(spark, events, made)[0] == want


def test_deviations_of_heads(spark):
    pair = lambda *x: [(v, p) for v, p in x]
    rows = [
        (1, {"page": pair(("p", 0.6), ("q", 0.3)), "status": pair(("OK", 0.9))}, "p", "KO"), (2, {"page": pair(("p", 0.0))}, "p", "OK"), (3, {"page": []}, "p", "OK"), (4, {}, None, None), (5, None, "p", "OK"),
        (6, {"page": pair(("q", 0.5), ("r", 0.2)), "status": pair(("KO", 0.5))}, "z", None),
    ]
    df = spark.createDataFrame(rows, "k int, heads map<string, array<struct<value:string, probability:double>>>, page string, status string")
    got = {r.k: r.d for r in df.select("k", sequences.head_deviations(F.col("heads"), {"page": F.col("page"), "status": F.col("status")}).alias("d")).collect()}
    assert (got[1].matched, got[1].probability) == ({"page": True, "status": False}, {"page": 0.6, "status": pytest.approx(0.09)}) and got[1].score == pytest.approx((0.4 + 0.91) / 2)
    assert got[2].matched == {"page": True} and got[2].score == pytest.approx(0.999)
    assert got[3].score == got[4].score == 1.0 and got[5] is None and got[6].score == pytest.approx(1 - 0.02)


def test_statuses_are_encoded_by_their_outcome(spark):
    df = spark.createDataFrame([(x,) for x in ("SUCCEEDED", "200", " success ", "FAILED", "Error", "failure", "OK", "ko", "PENDING", None)], "status string")
    ids = lambda words: [r.status_id for r in sequences.encode(df, {"status": words}).collect()]
    assert ids(["OK", "KO"]) == [1, 1, 1, 2, 2, 2, 1, 2, 0, 0] and ids(["ko", "ok"]) == [2, 2, 2, 1, 1, 1, 2, 1, 0, 0]
    # a vocabulary that knows another spelling is not asked for it
    assert ids(["SUCCESS", "FAILURE"]) == [0, 0, 1, 0, 0, 2, 0, 0, 0, 0]
    repaired = spark.createDataFrame([(" DÃ©connexion",), ("déconnexion",)], "action string")
    assert [r.action_id for r in sequences.encode(repaired, {"action": ["Déconnexion"]}).collect()] == [1, 0]


# --- leases ------------------------------------------------------------------------------


class Clock:
    def __init__(self):
        self.now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Handle:
    """One key's state in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema, ttlDurationMs=None):
        return self

    exists, get = lambda self: self.value is not None, lambda self: self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return set(self.timers)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


def leased(steps):
    """Decisions of one key's rows; a step is seconds, then kinds."""
    clock, handle, p = Clock(), Handle(), leases.LeaseProcessor()
    p.init(handle)
    out = []
    for seconds, *kinds in steps:
        clock.now = int(seconds * 1000)
        for t in [t for t in handle.timers if t <= clock.now]:
            handle.timers.discard(t)
            assert not list(p.handleExpiredTimer(("k",), clock, None))
        frame = pd.DataFrame([(kind, n, None) for n, kind in enumerate(kinds)], columns=["kind", "place", "payload"])
        out.append([d for f in p.handleInputRows(("k",), iter([frame]), clock) for d in f["decision"]])
    return out, handle


def test_leases():
    a, d, done, failed = "admitted", "duplicate", leases.PROCESSED, leases.FAILED
    e = leases.ATTEMPT
    assert leased([(0, e, e), (299, e)])[0] == [[a, d], [d]]  # in work
    assert leased([(0, e), (300, e), (599, e)])[0] == [[a], [a], [d]]  # a crash left it in work: the lease ends
    assert leased([(0, e), (1, failed), (2, e)])[0] == [[a], [], [a]]  # released
    assert leased([(0, e), (10, done), (86_409, e), (86_410, e)])[0] == [[a], [], [d], [a]]  # done for a day
    assert leased([(0, e), (400, done), (500, e)])[0] == [[a], [], [d]]  # done after its lease ended
    assert leased([(0, e, failed, e, done, e)])[0] == [[a, a, d]]
    rows, handle = leased([(0, e), (301,)])
    assert handle.value is None and not handle.timers  # nothing is kept of it


def test_failed_work_is_released_and_repeated(spark, tmp_path):
    """A stream reads attempts and its own outcomes; work that fails once is done at the next attempt, and only once."""
    sessions.state_store(spark)
    source, outcomes, kept = tmp_path / "in", tmp_path / "outcomes", tmp_path / "kept"
    for folder in (source, outcomes / "batch=none"):
        folder.mkdir(parents=True)
    schema = "event_key string, kind string, place long, payload string"
    write = lambda name, keys: (source / name).write_text("\n".join(json.dumps({"event_key": k, "kind": "event", "place": 1, "payload": name}) for k in keys))
    both = spark.readStream.schema(schema).json(str(source)).unionByName(spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(outcomes)))
    done, failing = [], [True]

    def work(batch, number):
        keys = sorted(r.event_key for r in batch.collect())
        if failing and "bad" in keys:
            raise ValueError("no")
        done.extend(keys)

    def start():
        return leases.decisions(both, work_seconds=3600).writeStream.foreachBatch(leases.work_once(work, str(outcomes))).option("checkpointLocation", str(kept)).start()

    def until(query, want):
        end = datetime.now() + timedelta(seconds=60)
        while sorted(done) != want and query.isActive and datetime.now() < end:
            query.awaitTermination(1)

    write("1.json", ["a", "b", "a"])
    q = start()
    try:
        until(q, ["a", "b"])
        write("2.json", ["bad", "b"])
        assert "ValueError" in str(pytest.raises(Exception, q.awaitTermination, 60).value)
        # the batch that failed is repeated as it was; then what was released comes as another attempt
        failing.clear()
        q = start()
        until(q, ["a", "b", "bad"])
        write("3.json", ["a", "b", "bad", "c"])
        until(q, ["a", "b", "bad", "c"])
    finally:
        q.stop()
    assert sorted(done) == ["a", "b", "bad", "c"]


# --- templates ---------------------------------------------------------------------------


def first_template(method, path, templates):
    """The rule, one template after another."""
    if method is None or path is None:
        return "UNTRACKED"
    bare = path.split("?", 1)[0]
    own = [t for _, m, t in sorted(templates) if m.upper() == method.upper()]
    for p in (path, bare):
        if p in own:
            return p
    for t in own:
        pattern = "".join("[^/]+" if k % 2 else re.escape(x) for k, x in enumerate(re.split(r"(\*|\{[^}]+\})", t)))
        if re.search(r"\*|\{[^}]+\}", t) and re.fullmatch(pattern, bare, re.S):
            return t
    return "UNTRACKED"


def test_template_tables(spark):
    templates = [
        (5, "GET", "/users/{id}"), (1, "get", "/users/{id}/{x}.pdf"), (2, "GET", "/users/*/a*b"), (3, "GET", "/users/{id}/{y}"), (4, "POST", "/users"), (6, "GET", "/users/me"), (7, "GET", "/a.b/[c]"),
        (8, "GET", "/a.b/{q}/"), (9, "GET", "/users?x=1"), (10, "GET", "*"), (11, "GET", "/{a}-{b}/c"), (0, None, "/none"),
    ]
    paths = ["/users", "/users/me", "/users/7", "/users/7?x=/y", "/users/", "/users//b", "/users/7/x.pdf", "/users/7/axb", "/users/7/ab", "/users/7/.pdf", "/users/7/8/9", "/a.b/[c]", "/axb/[c]", "/a.b/c/", "/a.b//",
             "/users?x=1", "/users?x=2", "word", "", "/a-b-c/c", "/-/c", "/a\nb/c", "/none", None]
    asked = [(m, p) for m in ("GET", "Post", "DELETE", None) for p in paths] + [("GET", "/users/7")] * 3
    got = requests.match_templates(spark.createDataFrame(asked, "method string, path string"), spark.createDataFrame(templates, "position long, method string, template string"))
    known = [t for t in templates if t[1]]
    assert sorted(map(repr, ((r.method, r.path, r.template) for r in got.collect()))) == sorted(repr((m, p, first_template(m, p, known))) for m, p in asked)


def test_a_hundred_thousand_templates(spark):
    table = spark.range(100_000).select(F.col("id").alias("position"), F.lit("GET").alias("method"), F.concat(F.lit("/api/v"), F.col("id") % 7, F.lit("/r"), F.col("id"), F.lit("/{id}/x")).alias("template"))
    asked = spark.range(20_000).select("id", F.lit("get").alias("method"), F.concat(F.lit("/api/v"), F.col("id") % 7, F.lit("/r"), F.col("id"), F.lit("/77/x?q")).alias("path"))
    got = requests.match_templates(asked, table)
    assert got.where(F.col("template") == F.concat(F.lit("/api/v"), F.col("id") % 7, F.lit("/r"), F.col("id"), F.lit("/{id}/x"))).count() == 20_000
    assert not re.search("NestedLoop|Cartesian", plan_of(got))


# --- counters ----------------------------------------------------------------------------


def test_field_coverage_ranks_no_more_than_it_shows(spark):
    rows = [("view",)] * 5 + [("a",)] * 3 + [("b",)] * 3 + [("c",)] * 4 + [("d",)] + [(None,)] * 9
    df = spark.createDataFrame(rows, "action string")
    (r,) = counters.field_coverage(df, {"action": ["view"]}, top_unknown=3).collect()
    assert (r.known, r.unknown, r.most_frequent_unknown, r.unknown_ratio, r.warn) == (5, 20, ["c", "a", "b"], 0.8, True)
    assert counters.field_coverage(df.limit(0), {"action": ["view"]}).count() == 0
    assert "WindowGroupLimit" in plan_of(counters.field_coverage(df, {"action": ["view"]}))


@pytest.mark.parametrize("kind", ["normal", "few", "steep", "one", "signs"])
def test_nearest_rank_by_rounds(spark, kind):
    r = random.Random(kind)
    make = {"normal": lambda: r.gauss(0, 1), "few": lambda: float(r.randrange(3)), "steep": lambda: math.exp(r.uniform(-300, 300)), "one": lambda: 7.0, "signs": lambda: r.choice([-1.7e308, 1.7e308, 0.0, 5e-324])}[kind]
    x = [make() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "x double").repartition(4)
    percents = (1, 50, 95, 99, 100)
    assert counters.nearest_rank_by_rounds(df, "x", percents, buckets=32) == {p: sorted(x)[math.ceil(p / 100 * len(x)) - 1] for p in percents}


def test_percentiles_of_the_latest(spark):
    df = spark.range(5000).select(F.col("id").alias("at"), ((F.col("id") * 7919) % 1009).alias("ms"))
    last = sorted(k * 7919 % 1009 for k in range(4000, 5000))
    assert tuple(counters.latest_percentiles(df, "ms", ["at"]).first()) == (last[499], last[949], last[-1], 1000)
    assert tuple(counters.latest_percentiles(df.limit(0), "ms", ["at"]).first()) == (0, 0, 0, 0)
    assert counters.nearest_rank_by_rounds(df.limit(0), "ms", (50,)) == {50: None}
    assert "TakeOrderedAndProject" in plan_of(counters.latest_percentiles(df, "ms", ["at"]))


def test_vector_coverage(spark):
    rows = [
        (["missing_tabular_feature:a", "missing_tabular_feature:b", "x:non_finite"], 12, 12, 2, 5), (["defaulted_tabular_feature:c_non_finite", "feature_contract_mismatch"], 12, 11, -3, 5), (None, None, None, None, None),
        ([], 12, None, 1, 0),
    ]
    df = spark.createDataFrame(rows, "warnings array<string>, expected_length int, actual_length int, unknown_categoricals int, categorical_values int")
    want = {"missing_features": 2, "defaulted_features": 1, "non_finite_replacements": 2, "contract_mismatches": 1, "length_mismatches": 2, "unknown_categorical_ratio": 0.3}
    assert counters.vector_coverage(df).first().asDict() == want
    assert counters.vector_coverage(df.limit(0)).first().asDict() == dict.fromkeys(want, 0)


# --- alert lists -------------------------------------------------------------------------


def test_lists_are_filtered_leniently_and_hydrated(spark):
    schema = "event_id string, timestamp timestamp, created_at timestamp, risk_level string, anomaly_type string, insured_id string, session_id string, device string, position int"
    row = lambda i, at, level, device=None, user="U1", n=0: (i, None if at is None else T0 + timedelta(hours=at), T0, level, "t", user, "S", device, n)
    live = spark.createDataFrame([row("a", 5, "HIGH"), row("b", None, "high"), row("c", 1, "HIGH"), row("d", 9, "LOW"), row("a", 5, "HIGH", "own", n=1)], schema)
    stored = spark.createDataFrame([row("a", 7, "HIGH"), row("e", 6, "High", user="u1"), row("f", 8, "HIGH", user="v")], schema)
    events = spark.createDataFrame([("b", T0, "old"), ("b", T0 + timedelta(hours=1), "new"), ("a", T0, "no")], "event_id string, detected_at timestamp, device string")
    got = details.live_list(live, stored, 10, 0, events, ["device"], level="high", insured="u1", kind=" ", since="2025-01-01 02:00:00").collect()
    assert [(r.event_id, r.device, r.total) for r in got] == [("e", None, 3), ("a", "own", 3), ("b", "new", 3)]
    assert [r.event_id for r in details.first_filled(live.limit(0), stored, live).orderBy("event_id").collect()] == ["a", "e", "f"]
    assert details.first_filled(live.limit(0), stored.limit(0)).count() == 0 and details.first_filled(live, stored).count() == 5
    assert alerts.lenient_filter(live, session="s", until="2025-01-01 01:00:00").count() == 2


def test_details_name_their_source(spark):
    rows = [("e1", "u", "s", T0, '{"eventId":"e1","source":"cache"}'), ("e2", "u", "s", T0, '{"eventId":"e2","source":" "}'), ("e3", "u", "n", T0, None), ("e4", "u", "p", T0, None)]
    analyses = [("u", "p", T0, None)]
    got = details.alert_details(
        spark.createDataFrame(rows, "event_id string, insured_id string, session_id string, detected_at timestamp, payload string"),
        spark.createDataFrame(analyses, "insured_id string, session_id string, created_at timestamp, payload string"),
    )
    assert {r.event_id: (r.source, r.warning) for r in got.collect()} == {"e1": ("cache", None), "e2": ("sql-payload", None), "e3": ("sql", "exact_event_payload_unavailable"), "e4": ("sql", None)}
