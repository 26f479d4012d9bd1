"""Counters, live statistics, dashboards and data quality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_minute(events: DataFrame) -> DataFrame:
    """Events, failures and downloads of each minute."""
    return _counted(events, F.date_trunc("minute", "created_at").alias("minute"))


def per_day(events: DataFrame) -> DataFrame:
    return _counted(events, F.to_date("created_at").alias("day"))


def _counted(events: DataFrame, by: Column) -> DataFrame:
    return events.where("created_at is not null").groupBy(by).agg(
        F.count("*").alias("events"), F.count_if(F.upper("status") == "KO").alias("kos"), F.count_if(F.col("is_download_action") == 1).alias("downloads")
    )


def per_minute_and(events: DataFrame, column: str) -> DataFrame:
    """Events of each minute and value; no value counts as UNKNOWN."""
    return events.where("created_at is not null").groupBy(F.date_trunc("minute", "created_at").alias("minute"), F.coalesce(column, F.lit("UNKNOWN")).alias(column)).agg(
        F.count("*").alias("events")
    )


def top(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; of equals the first in order."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def global_level(alerts: Column, anomaly_rate: Column, ko_rate: Column) -> Column:
    return (
        F.when((alerts >= 3) | (anomaly_rate >= 0.20) | (ko_rate >= 0.20), "HIGH")
        .when((alerts >= 1) | (anomaly_rate >= 0.05) | (ko_rate >= 0.10), "MEDIUM").otherwise("LOW")
    )


def live_snapshot(events: DataFrame, alerts: DataFrame, as_of: str, short: int = 15, long: int = 60) -> DataFrame:
    """One row about the minutes before ``as_of``: events of the last one, rates over ``short`` and ``long``, top actions and countries."""
    now = F.lit(as_of).cast("timestamp")

    def within(df: DataFrame, c: str, minutes: int) -> DataFrame:
        return df.where((F.col(c) > now - F.expr(f"interval {minutes} minutes")) & (F.col(c) <= now))

    recent = within(events, "created_at", short)
    minute = F.col("created_at") > now - F.expr("interval 1 minutes")
    counts = within(events, "created_at", long).agg(
        F.count_if(minute).alias("events_last_minute"), F.count("*").alias("events_long"),
        F.count_if(F.col("created_at") > now - F.expr(f"interval {short} minutes")).alias("events_short"),
        F.count_if((F.col("created_at") > now - F.expr(f"interval {short} minutes")) & (F.upper("status") == "KO")).alias("kos_short"),
    )
    raised = within(alerts, "timestamp", long).agg(F.count("*").alias("alerts"))

    def ranked(column: str, n: int) -> DataFrame:
        return top(recent, column, n).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))).alias("l")).select(
            F.array_join(F.transform("l", lambda x: x.v), ",").alias(f"top_{column}")
        )

    one = counts.withColumn("_one", F.lit(1))
    for part in (raised, ranked("action", 5), ranked("country_code", 3)):  # one row each
        one = one.join(part.withColumn("_one", F.lit(1)), "_one")
    rate = F.when(F.col("events_long") > 0, F.col("alerts") / F.col("events_long")).otherwise(0.0)
    ko = F.when(F.col("events_short") > 0, F.col("kos_short") / F.col("events_short")).otherwise(0.0)
    out = one.withColumns({"alert_rate": rate, "ko_rate": ko}).drop("_one")
    return out.withColumn("global_risk_level", global_level(F.col("alerts"), F.col("alert_rate"), F.col("ko_rate")))


def security_overview(sessions: DataFrame, events: DataFrame, anomalies: DataFrame, day: str, latest: int = 50) -> DataFrame:
    """One row about ``day``: its events, alerts and their rate, its ten most frequent types; of the ``latest`` sessions
    the critical and high ones, the average risk, the users and the five most frequent rules.

    ``sessions``: end_time, session_id, insured_id, final_risk_score, rule_codes; ``events``: created_at; ``anomalies``: detected_at, anomaly_type.
    """
    start = F.lit(day).cast("timestamp")
    of_day = lambda df, c: df.where((F.col(c) >= start) & (F.col(c) < start + F.expr("interval 1 day")))
    rows = sessions.orderBy(F.col("end_time").desc_nulls_last(), F.col("session_id").desc()).limit(latest)
    s = F.col("final_risk_score")
    raised = of_day(anomalies, "detected_at")
    parts = [
        of_day(events, "created_at").agg(F.count("*").alias("total_events")),
        raised.agg(F.count("*").alias("alerts")),
        rows.agg(
            F.count("*").alias("sessions"), F.count_if(s >= 80).alias("critical"), F.count_if((s >= 60) & (s < 80)).alias("high"),
            F.coalesce(F.avg(s), F.lit(0.0)).alias("avg_risk"), F.count_distinct("insured_id").alias("active_users"),
        ),
        _listed(top(raised.where(F.trim("anomaly_type") != ""), "anomaly_type", 10), "anomaly_type", "top_types"),
        _listed(rule_histogram(rows, 5), "rule", "top_rules"),
    ]
    one = None
    for part in parts:  # one row each
        part = part.withColumn("_one", F.lit(1))
        one = part if one is None else one.join(F.broadcast(part), "_one")
    rate = F.when(F.col("total_events") > 0, F.col("alerts") / F.col("total_events")).otherwise(0.0)
    return one.withColumn("anomaly_rate", rate).drop("_one")


def _listed(few: DataFrame, column: str, name: str) -> DataFrame:
    """The values of a short ``top`` in one row, most frequent first."""
    values = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))))
    return few.agg(values.alias("l")).select(F.transform("l", lambda x: x.v).alias(name))


def rule_histogram(sessions: DataFrame, n: int = 5, column: str = "rule_codes") -> DataFrame:
    return top(sessions.select(F.explode(column).alias("rule")), "rule", n)


def type_counts(rows: DataFrame, column: str = "anomaly_type") -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Count and share of each value that is not null."""
    # one row a value is left by now
    return type_counts(rows, column).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def nearest_rank(df: DataFrame, column: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p/100 n)."""
    return df.agg(*(F.expr(f"percentile_disc({p / 100}) within group (order by {column})").cast(df.schema[column].dataType).alias(f"p{p}") for p in percents), F.count(column).alias("n"))


def latest_percentiles(df: DataFrame, column: str, order: list[str], n: int = 1_000, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Nearest-rank percentiles, ``greatest`` and number of the last ``n`` values that are not null, by ``order``; 0 without any.

    A task keeps no more than ``n`` rows, and so does the one that merges them.
    """
    last = df.where(F.col(column).isNotNull()).orderBy(*(F.col(c).desc_nulls_last() for c in order)).limit(n).select(F.col(column).alias("x"))
    rows = last.agg(F.sort_array(F.collect_list("x")).alias("v")).withColumn("n", F.size("v"))
    place = lambda p: F.greatest(F.lit(1), F.ceil(p * F.col("n") / 100)).cast("int")
    of = lambda c: F.when(F.col("n") > 0, c).otherwise(0)
    return rows.select(*(of(F.try_element_at("v", place(p))).alias(f"p{p}") for p in percents), of(F.try_element_at("v", F.lit(-1))).alias("greatest"), F.col("n").cast("long").alias("n"))


def values_at(df: DataFrame, column: str, places: Iterable[int], buckets: int = 1_024) -> dict[int, float]:
    """The values that stand at the given places, from 1, when a number column of any size is sorted; without a sort.

    Each round counts the values left in ``buckets`` equal parts of each wanted place's interval, with the least and the greatest value of each part,
    and goes on within the part that holds the place, until that part holds one value. A round is one pass with
    partial sums; the driver sees the parts, never values. Only finite numbers count; places beyond them have no value.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("abs(x) < double('infinity')")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    # wanted place to interval and to the place within it
    left = {p: (low, high, p) for p in places if 1 <= p <= n}
    done: dict[int, float] = {}
    while True:
        done |= {p: a for p, (a, b, _) in left.items() if a == b}
        left = {p: v for p, v in left.items() if p not in done}
        if not left:
            return done
        spans = sorted({(a, b) for a, b, _ in left.values()})
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(spans))))
        # the least value is a part of its own, so that each round leaves fewer
        part = F.least(F.lit(buckets - 1), F.floor(F.try_divide(F.col("x") / 2 - F.col("a") / 2, F.col("b") / 2 - F.col("a") / 2) * buckets))
        part = F.when(F.col("x") <= F.col("a"), -1).otherwise(part)
        rows = x.select("x", each.alias("s")).select("x", "s.*").where("x between a and b").groupBy("k", part.alias("part"))
        found = rows.agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("k", "part").collect()
        for p, (a, b, place) in left.items():
            for r in (r for r in found if spans[r.k] == (a, b)):
                if place <= r.n:
                    left[p] = (r.a, r.b, place)
                    break
                place -= r.n


def nearest_rank_by_rounds(df: DataFrame, column: str, percents: tuple[int, ...] = (50, 95, 99), buckets: int = 1_024) -> dict[int, float | None]:
    """Exact nearest-rank percentiles of a number column of any size: the value at place ceil(p/100 n). Without finite numbers all are None."""
    n = df.where(F.abs(F.col(column).cast("double")) < float("inf")).count()
    place = {p: max(1, -(-p * n // 100)) for p in percents}
    found = values_at(df, column, set(place.values()), buckets)
    return {p: found.get(place[p]) for p in percents}


def field_coverage(df: DataFrame, known: dict[str, list[str]], warn_above: float = 0.30, top_unknown: int = 5) -> DataFrame:
    """For each field: values known to its vocabulary, unknown ones, their share, the most frequent of these.

    Values are counted with partial sums. Of a field's unknown values each task passes on no more than the
    ``top_unknown`` most frequent of its own, so a field with very many values is no heavier than others.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in known)))
    rows = df.select(pairs.alias("x")).select("x.field", "x.value").groupBy("field", "value").agg(F.count("*").alias("n"))
    ok = F.lit(False)
    for f, values in known.items():
        ok = ok | ((F.col("field") == f) & F.col("value").isin(*values))
    counts = rows.withColumn("known", F.coalesce(ok, F.lit(False)))
    number = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    totals = counts.groupBy("field").agg(number(F.col("known")).alias("known"), number(~F.col("known")).alias("unknown"))
    by_n = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    worst = counts.where(~F.col("known") & F.col("value").isNotNull()).withColumn("rank", F.row_number().over(by_n)).where(F.col("rank") <= top_unknown)
    named = worst.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x.value).alias("most_frequent_unknown"))
    out = totals.join(named, "field", "left").withColumn("most_frequent_unknown", F.coalesce("most_frequent_unknown", F.array().cast("array<string>")))
    return out.withColumn("unknown_ratio", F.col("unknown") / (F.col("known") + F.col("unknown"))).withColumn("warn", F.col("unknown_ratio") > warn_above)


def vector_coverage(vectors: DataFrame) -> DataFrame:
    """How well feature vectors were filled: one row of counters.

    ``vectors``: ``warnings`` (array of text), expected_length, actual_length, unknown_categoricals, categorical_values; nulls count as
    nothing, lengths that differ in being null as a mismatch.
    """
    warned = lambda test: F.coalesce(F.sum(F.coalesce(F.size(F.filter("warnings", test)), F.lit(0))), F.lit(0))
    some = lambda c: F.coalesce(F.sum(F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))), F.lit(0))
    sums = vectors.agg(
        warned(lambda w: w.startswith("missing_tabular_feature")).alias("missing_features"), warned(lambda w: w.startswith("defaulted_tabular_feature")).alias("defaulted_features"),
        some("unknown_categoricals").alias("unknown"), some("categorical_values").alias("values"), warned(lambda w: F.contains(w, F.lit("non_finite"))).alias("non_finite_replacements"),
        warned(lambda w: F.contains(w, F.lit("feature_contract_mismatch"))).alias("contract_mismatches"),
        F.count_if(~F.col("expected_length").eqNullSafe(F.col("actual_length"))).alias("length_mismatches"),
    )
    return sums.withColumn("unknown_categorical_ratio", F.when(F.col("values") > 0, F.col("unknown") / F.col("values")).otherwise(0.0)).drop("unknown", "values")


def tabular_coverage(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """For each feature, given as text: values missing, of no number, not finite, and equal to the default that stands in for them."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"), F.lit(float(d)).alias("default")) for f, d in defaults.items())))
    x = df.select(pairs.alias("x")).select("x.*").withColumn("number", F.expr("try_cast(value as double)"))
    missing = F.coalesce(F.trim("value"), F.lit("")) == ""
    no_number = ~missing & F.col("number").isNull()
    endless = F.coalesce(F.isnan("number") | F.col("number").isin(float("inf"), float("-inf")), F.lit(False))
    return x.groupBy("feature").agg(
        F.count("*").alias("values"), F.count_if(missing).alias("missing"), F.count_if(no_number).alias("mismatched"), F.count_if(endless).alias("non_finite"),
        F.count_if(missing | no_number | endless).alias("defaulted"), F.count_if(F.coalesce(F.col("number") == F.col("default"), F.lit(False))).alias("at_default"),
    )


def snapshot(views: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``views(view_name, snapshot_key, payload)`` whose content differs from what is stored, with their hash."""
    hashed = views.withColumn("payload_json", F.to_json("payload")).withColumn("payload_hash", F.sha2("payload_json", 256)).drop("payload")
    return hashed.join(stored.select("view_name", "snapshot_key", "payload_hash"), ["view_name", "snapshot_key", "payload_hash"], "left_anti")


def traffic_anomaly(actual: Column, hours: Column, forecast: Column, bound: float = 1.35) -> Column:
    """Whether a day's projected events exceed the forecast; too early a day with few events is not judged."""
    projected = actual / F.greatest(F.lit(1), hours) * 24
    early = (hours < 4) & (actual < forecast * bound / 2)
    return F.when(early, False).otherwise(projected > forecast * bound)


def run_lengths(df: DataFrame, keys: list[str], order: list[str], test: Column) -> DataFrame:
    """Adds ``run``: how many rows up to this one meet the test without a break."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = df.withColumn("_n", F.row_number().over(w)).withColumn("_t", F.coalesce(test, F.lit(False)))
    last = F.coalesce(F.max(F.when(~F.col("_t"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return n.withColumn("run", F.when(F.col("_t"), F.col("_n") - last).otherwise(0)).drop("_n", "_t")
