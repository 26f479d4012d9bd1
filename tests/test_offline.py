"""Isolation forests, seasonal forecasts, shedding by lag and tables kept up by streams."""

import json
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import isolation, models, seasonal
from tidemark.streaming import lag, sinks

DAY0 = date(2022, 1, 1)


def test_planted_outliers_are_isolated_first(spark):
    r = np.random.default_rng(1)
    inner = r.normal(size=(3000, 4))
    planted = r.choice([-1, 1], size=(12, 4)) * r.uniform(6, 9, size=(12, 4))
    rows = [(k, *map(float, x)) for k, x in enumerate(np.vstack([inner, planted]))] + [(5000, None, float("nan"), float("inf"), 0.0)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    forest = isolation.fit_isolation_forest(df.where("k < 5000"), names, trees=60, sample=48)
    assert len(forest.roots) == 60 and len(forest.feature) < 2 * 3000
    scored = df.withColumn("score", models.score_with(forest, names))
    assert {r.k for r in scored.orderBy(F.desc("score")).limit(12).collect()} == set(range(3000, 3012))
    # the middle of the table is unlike nobody
    by = {r.k: r.score for r in scored.collect()}
    assert all(0 < s < 1 for s in by.values()) and by[5000] < np.quantile([by[k] for k in range(3000)], 0.5)
    share = isolation.share_of(df.withColumn("bad", (F.col("k") >= 3000).cast("int")), "bad")
    assert share == isolation.LEAST_SHARE
    at = isolation.threshold_of(scored.where("k < 3000"), "score", share)
    assert at == pytest.approx(np.quantile([by[k] for k in range(3000)], 1 - share), abs=1e-12)
    assert scored.where(isolation.is_anomalous(F.col("score"), at) == 1).where("k >= 3000").count() == 12


def test_path_lengths_by_hand():
    """Two rows: one split, paths of 1, usual path 1, score 2^-1; rows all alike: a leaf with the usual path."""
    for x in (np.array([[0.0], [1.0]]), np.array([[5.0], [5.0]])):
        nodes = isolation._grown(x, np.random.default_rng(0))
        f, t, left, right, length = map(np.array, zip(*nodes))
        forest = isolation.IsolationForest(np.array([0]), f, t, left, right, length, isolation.usual_length(2))
        assert forest.score(x).tolist() == [0.5, 0.5] and len(nodes) == (3 if x[0, 0] < x[1, 0] else 1)
    assert isolation.usual_length(1) == 0 and isolation.usual_length(256) == pytest.approx(10.2448, abs=1e-3)


def test_forests_of_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "a double")
    assert isolation.fit_isolation_forest(df.limit(0), ["a"]) is None and isolation.threshold_of(df.limit(0), "a", 0.1) is None
    forest = isolation.fit_isolation_forest(df, ["a"])
    assert len(forest.roots) == 1 and forest.score(np.array([[9.0], [np.nan]])).shape == (2,)


def known(k, multiplicative=True):
    trend = 1000 + 0.8 * k + (2.0 * (k - 400) if k > 400 else 0)
    wave = 0.2 * math.sin(2 * math.pi * (DAY0 + timedelta(days=k)).toordinal() / 7) + 0.1 * math.cos(2 * math.pi * k / 365.25)
    return trend * (1 + wave) if multiplicative else trend + 500 * wave


@pytest.mark.parametrize("multiplicative", [True, False])
def test_a_known_series_is_recovered(spark, multiplicative):
    rows = [(DAY0 + timedelta(days=k), known(k, multiplicative)) for k in range(900) if k % 50 != 7]
    df = spark.createDataFrame(rows, "ds date, y double").repartition(6)
    model = seasonal.fit_seasonal(df, "y", multiplicative=multiplicative)
    ahead = seasonal.forecast_with(model, seasonal.future_days(df, 30)).orderBy("ds").collect()
    assert [r.ds for r in ahead] == [DAY0 + timedelta(days=900 + k) for k in range(30)]
    assert max(abs(r.yhat / known(900 + k, multiplicative) - 1) for k, r in enumerate(ahead)) < 0.02
    inside = seasonal.forecast_with(model, df).select(F.max(F.abs(F.col("yhat") / F.col("y") - 1))).first()[0]
    assert inside < 0.02
    found = seasonal.tried(df, "y", multiplicative=multiplicative)
    assert found["horizon"] == 30 and found["mae"] < 60 and found["mae"] <= found["rmse"]


def test_short_series_have_no_forecast(spark):
    df = spark.createDataFrame([(DAY0 + timedelta(days=k), float(k)) for k in range(44)], "ds date, y double")
    assert seasonal.fit_seasonal(df, "y") is None and seasonal.tried(df, "y") is None and seasonal.tried(df.limit(0), "y") is None
    assert [seasonal.horizon_of(n) for n in (10, 45, 100, 900)] == [7, 9, 20, 30]
    flat = spark.createDataFrame([(DAY0 + timedelta(days=k), 0.0) for k in range(60)], "ds date, y double")
    assert seasonal.forecast_with(seasonal.fit_seasonal(flat, "y"), flat).where("abs(yhat) > 1e-6").count() == 0


def test_a_stream_that_lags_changes_its_mode_and_returns(spark, tmp_path):
    """The lag at the end of each micro-batch is that of a topic whose backlog grows and shrinks."""
    backlog = iter([100, 6_000, 25_000, 300])
    modes = []
    listener = lag.LagListener(lambda progress: next(backlog) if progress["numInputRows"] else listener.lag("lagging"))
    spark.streams.addListener(listener)
    (tmp_path / "in").mkdir()
    df = spark.readStream.schema("k long").json(str(tmp_path / "in"))

    def score(batch, number):
        modes.append([r.scoring_mode for r in batch.select("scoring_mode").distinct().collect()])

    q = df.writeStream.queryName("lagging").foreachBatch(lag.shed_by_lag(score, listener, "lagging")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, after in enumerate((100, 6_000, 25_000, 300)):
            (tmp_path / "in" / f"{k}.json").write_text('{"k":1}')
            q.processAllAvailable()
            for _ in range(100):
                if listener.lag("lagging") == after:
                    break
                q.awaitTermination(0.1)
        (tmp_path / "in" / "9.json").write_text('{"k":1}')
        backlog = iter([0])
        q.processAllAvailable()
    finally:
        q.stop()
        spark.streams.removeListener(listener)
    assert modes == [["TRANSFORMER"], ["TRANSFORMER"], ["TCN"], ["RULES_ONLY"], ["TRANSFORMER"]]


def test_lags_of_kafka_offsets():
    listener = lag.LagListener()
    source = {"endOffset": json.dumps({"t": {"0": 5, "1": 9}}), "latestOffset": {"t": {"0": 12, "1": 8}}}
    listener.note({"name": None, "id": "q1", "sources": [source, source]})
    assert listener.lag("q1") == 14 and listener.lag("other") == 0


def rows_of(table, spark):
    found = table.read(spark)
    return None if found is None else sorted((r.k, r.n, r.at) for r in found.collect())


def test_replayed_batches_leave_the_table_as_it_is(spark, tmp_path):
    table = sinks.LatestTable(str(tmp_path / "t"), ["k"], "at", buckets=4)
    frame = lambda *rows: spark.createDataFrame(rows, "k string, n int, at int")
    assert rows_of(table, spark) is None and table.vacuum(spark) == 0
    table.write(frame(), 0)
    first, second = frame(("a", 1, 5), ("b", 1, 5), ("a", 2, 4)), frame(("a", 3, 5), ("c", 3, 1), ("b", 3, 2))
    table.write(first, 1), table.write(first, 1)
    assert rows_of(table, spark) == [("a", 1, 5), ("b", 1, 5)]
    table.write(second, 2)
    want = [("a", 3, 5), ("b", 1, 5), ("c", 3, 1)]
    assert rows_of(table, spark) == want
    table.write(second, 2)
    assert rows_of(table, spark) == want
    # a batch that died before its list was written is not there, and is replaced
    frame(("a", 9, 9)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "t/rows/batch=3"))
    assert rows_of(table, spark) == want
    table.write(frame(("d", 4, 0)), 3)
    assert rows_of(table, spark) == [*want, ("d", 4, 0)]


def test_streams_keep_up_a_table(spark, tmp_path):
    r = random.Random(2)
    (tmp_path / "in").mkdir()
    table, last = sinks.LatestTable(str(tmp_path / "t"), ["k"], "at", buckets=3), {}
    for part in range(5):
        rows = [{"k": f"k{r.randrange(9)}", "n": part, "at": part * 100 + j} for j in range(8)]
        last |= {x["k"]: (x["k"], x["n"], x["at"]) for x in rows}
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(map(json.dumps, rows)))
        df = spark.readStream.schema("k string, n int, at int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = df.writeStream.foreachBatch(table.write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    assert rows_of(table, spark) == sorted(last.values())
    gone = table.vacuum(spark)
    assert gone >= 1 and rows_of(table, spark) == sorted(last.values())


def test_queries_without_sql(spark):
    from tests.conftest import SMALL
    from tidemark.plans import catalogue

    scores = catalogue.isolated_sessions(spark, SMALL).collect()
    assert len(scores) == catalogue.queries()["session_summary"](spark, SMALL).count() and all(0 < r.isolation_score < 1 for r in scores)
    assert catalogue.seasonal_forecast(spark, SMALL).columns == ["ds", "yhat"]


def test_one_hot_leaves_no_value_out_unsaid(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("c"))
    assert len(models.one_hot(df, df, "c").columns) == 31
    with pytest.raises(ValueError):
        models.one_hot(df, df, "c", most=29)


def test_long_sessions_are_cut_anew(spark):
    from datetime import datetime

    from tidemark.operators import sessions

    r = random.Random(3)
    t0 = datetime(2025, 1, 1)
    rows = [(f"u{k % 3}", "s", k, None if r.random() < 0.05 else t0 + timedelta(seconds=r.randrange(4000)), "x") for k in range(600)]
    want = {}
    for user in ("u0", "u1", "u2"):
        start, part = None, -1
        for at, k in sorted((x[3], x[2]) for x in rows if x[0] == user and x[3]):
            if start is None or (at - start).total_seconds() >= 100:
                start, part = at, part + 1
            want[k] = part
    df = spark.createDataFrame(rows, "insured_id string, session_id string, id long, created_at timestamp, part string").repartition(5)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "37")
    try:
        got = {x.id: x.part for x in sessions.cut_long_sessions(df, 100).collect()}
    finally:
        spark.conf.set(conf, before)
    assert got == {k: want.get(k) for k in range(600)}
