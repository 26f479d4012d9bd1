"""Composed views: all that is shown of a user, and the recent history beside a forecast.

A user's latest sessions and anomalies are cut to a few before anything is gathered, so a row of the view is made of short
arrays, by expressions, whatever the tables' size: one shuffle of each side, and one join by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import api_family, blank_to_null, route_family

# How many sessions and anomalies are looked at, and how many hours and families are shown.
RECENT, HOURS, FAMILIES = 10, 3, 5
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
_SESSION = {
    "session_id": "string", "start_time": "timestamp", "end_time": "timestamp", "country_code": "string", "churn_probability": "double", "churn_risk_level": "string", "final_risk_score": "double",
    "routes": "array<string>", "llm_payload": "string", "payload": "string", "type_evidence": "string",
}
_ANOMALY = {
    "event_id": "string", "event_time": "timestamp", "final_risk_score": "double", "risk_level": "string", "anomaly_tier": "string", "anomaly_flag": "boolean", "event_json": "string", "payload": "string",
    "llm_payload": "string",
}


def _latest(df: DataFrame, fields: dict[str, str], time: str, id_: str, name: str) -> DataFrame:
    """Each user's latest rows as one array, newest first; fields that the table lacks are null."""
    have = set(df.columns)
    w = Window.partitionBy("insured_id").orderBy(F.col(time).desc_nulls_last(), F.col(id_).desc_nulls_last())
    rows = df.where("insured_id is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= RECENT)
    of = F.struct("_n", *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields.items()))
    return rows.groupBy("insured_id").agg(F.array_sort(F.collect_list(of)).alias(name))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def most_frequent(values: Column, n: int) -> Column:
    """The ``n`` most frequent values of a short array, nulls aside; of equals the one seen first."""
    known = F.array_compact(values)
    ranked = F.transform(F.array_distinct(known), lambda v, i: F.struct((-F.size(F.filter(known, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda x: x.v)


def _metadata_family(payload: Column) -> Column:
    where = ("$.eventMetadata.", "$.anomalyTypeAttribution.evidence.")
    return F.coalesce(*(F.get_json_object(payload, f"{w}{name}") for w in where for name in ("apiFamily", "apiTemplate")))


def _own_family(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$.apiFamily"), F.get_json_object(json, "$.apiTemplate"))


def derived_level(level: Column, score: Column) -> Column:
    """A known level in upper case, else the one of the score."""
    by_score = F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 35, "MEDIUM").when(score.isNotNull(), "LOW")
    return F.when(F.upper(level).isin(*LEVELS), F.upper(level)).otherwise(by_score)


def user_view(sessions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row for each user of either table, from the latest sessions by end and the latest anomalies by time.

    ``churn_probability`` and ``churn_risk_level`` are the first known among the sessions (0 and UNKNOWN else); ``average_risk`` is that of the
    sessions, null without any score; ``alert_count`` and ``critical_alert_count`` go by flag and tier of the anomalies; ``usual_country``, ``usual_device`` and
    ``usual_browser`` are the first known; ``usual_active_hours`` are the most frequent hours of starts, ends and anomalies;
    ``top_api_families`` counts one family for each anomaly and session, and each family of a session's routes once. ``recent_sessions`` and
    ``risk_timeline`` list both, newest first. Fields of ``_SESSION`` and ``_ANOMALY`` that a table lacks count as unknown.
    """
    one = _latest(sessions, _SESSION, "end_time", "session_id", "_s").join(_latest(anomalies, _ANOMALY, "event_time", "event_id", "_a"), "insured_id", "full")
    rows = one.withColumns({c: F.coalesce(c, F.array().cast(one.schema[c].dataType)) for c in ("_s", "_a")})
    of = lambda side, f: F.transform(side, f)
    scores = F.array_compact(of("_s", lambda x: x.final_risk_score))
    hours = F.concat(F.flatten(of("_s", lambda x: F.array(F.hour(x.start_time), F.hour(x.end_time)))), of("_a", lambda x: F.hour(x.event_time)))
    by_route = lambda x: F.array_distinct(F.array_compact(F.transform(F.coalesce(x.routes, F.array().cast("array<string>")), lambda r: route_family(r))))
    of_anomaly = lambda x: api_family(F.coalesce(_own_family(x.event_json), _metadata_family(x.payload), _metadata_family(x.llm_payload)))
    of_session = lambda x: api_family(F.coalesce(_metadata_family(x.llm_payload), _metadata_family(x.payload), _own_family(x.type_evidence)))
    families = F.concat(of("_a", of_anomaly), F.flatten(of("_s", lambda x: F.concat(F.array(of_session(x)), by_route(x)))))
    count = lambda test: F.size(F.filter("_a", lambda x: F.coalesce(test(x), F.lit(False))))
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(scores), F.lit(0))
    return rows.select(
        "insured_id", F.coalesce(_first(of("_s", lambda x: x.churn_probability)), F.lit(0.0)).alias("churn_probability"),
        F.coalesce(_first(of("_s", lambda x: blank_to_null(x.churn_risk_level))), F.lit("UNKNOWN")).alias("churn_risk_level"), mean.alias("average_risk"),
        count(lambda x: x.anomaly_flag).alias("alert_count"), count(lambda x: F.upper(x.anomaly_tier) == "CRITICAL").alias("critical_alert_count"),
        _first(of("_s", lambda x: blank_to_null(x.country_code))).alias("usual_country"), _first(of("_a", lambda x: F.get_json_object(x.event_json, "$.device"))).alias("usual_device"),
        _first(of("_a", lambda x: F.get_json_object(x.event_json, "$.browser"))).alias("usual_browser"), most_frequent(hours, HOURS).alias("usual_active_hours"),
        most_frequent(families, FAMILIES).alias("top_api_families"), F.get(of("_s", lambda x: x.session_id), F.lit(0)).alias("latest_session"),
        of("_s", lambda x: F.struct(x.session_id.alias("session_id"), x.end_time.alias("end_time"), x.final_risk_score.alias("final_risk_score"))).alias("recent_sessions"),
        of("_a", lambda x: F.struct(x.event_id.alias("event_id"), x.event_time.alias("timestamp"), x.final_risk_score.alias("final_risk_score"),
                                    derived_level(x.risk_level, x.final_risk_score).alias("risk_level"), x.anomaly_tier.alias("point_type"))).alias("risk_timeline"),
    )


def forecast_history(days: DataFrame, today: str, n: int = 7) -> DataFrame:
    """One row: ``total_events`` and ``anomaly_rate``, lists of (date, value) of the ``n`` days before ``today`` that had events, and ``warning``.

    ``days``: ds, total_events, alerts. The warning is ``forecast_history_unavailable`` without any such day and
    ``forecast_history_partial`` with fewer than ``n``.
    """
    end = F.lit(today).cast("date")
    known = days.where((F.col("ds") < end) & (F.col("ds") >= F.date_sub(end, n)) & (F.col("total_events") > 0))
    # at most ``n`` rows are left
    rows = known.agg(F.array_sort(F.collect_list(F.struct("ds", F.col("total_events").cast("long").alias("n"), F.coalesce("alerts", F.lit(0)).alias("alerts")))).alias("d"))
    at = lambda f: F.transform("d", lambda x: F.struct(x.ds.alias("date"), f(x).alias("value")))
    warning = F.when(F.size("d") == 0, "forecast_history_unavailable").when(F.size("d") < n, "forecast_history_partial")
    return rows.select(at(lambda x: x.n).alias("total_events"), at(lambda x: x.alerts / x.n).alias("anomaly_rate"), warning.alias("warning"))


def best_predictions(users: DataFrame, predictions: DataFrame) -> DataFrame:
    """``insured_id, session_id`` of ``users`` with ``predicted_at``, ``heads`` and ``note``: the prediction shown for each.

    ``predictions``: insured_id, session_id, created_at, heads (map of field to ranked values). The latest of the session stands where it has heads, else
    the latest of the user, noted ``fallback_to_insured_prediction``; where neither has, heads are null and the note is ``next_event_prediction_not_available``.
    """
    made = F.struct("created_at", "heads")

    def latest(key: str, name: str) -> DataFrame:
        known = predictions.where(F.col(key).isNotNull() & F.col("created_at").isNotNull())
        return known.groupBy(key).agg(F.max_by(made, "created_at").alias(name))

    rows = users.select("insured_id", "session_id").join(latest("session_id", "_s"), "session_id", "left").join(latest("insured_id", "_u"), "insured_id", "left")
    filled = lambda c: F.coalesce(F.size(F.col(f"{c}.heads")) > 0, F.lit(False))
    chosen = F.when(filled("_s"), F.col("_s")).when(filled("_u"), F.col("_u"))
    note = F.when(~filled("_s") & filled("_u"), "fallback_to_insured_prediction").when(~filled("_s"), "next_event_prediction_not_available")
    return rows.select("insured_id", "session_id", chosen["created_at"].alias("predicted_at"), chosen["heads"].alias("heads"), note.alias("note"))


def churn_view(sessions: DataFrame, anomalies: DataFrame, latest: int = 50, n: int = 10) -> DataFrame:
    """The ``n`` users most likely to churn among the ``latest`` sessions, each by its deciding session, with the risk of their own latest sessions and anomalies.

    ``sessions``: insured_id, session_id, end_time, created_at, churn_probability, churn_risk_level, final_risk_score, risk_level; ``anomalies`` as for
    ``user_view``. A user's deciding session is that of the latest end, then creation, then the highest probability. Levels are in
    upper case, UNKNOWN where there is none.
    """
    recent = sessions.orderBy(F.col("created_at").desc_nulls_last(), F.col("session_id").desc_nulls_last()).limit(latest).where("churn_probability is not null and insured_id is not null")
    w = Window.partitionBy("insured_id").orderBy(*(F.col(c).desc_nulls_last() for c in ("end_time", "created_at", "churn_probability", "session_id")))
    deciding = recent.withColumn("_n", F.row_number().over(w)).where("_n = 1").orderBy(F.desc("churn_probability"), "insured_id").limit(n)
    few = F.broadcast(deciding.select("insured_id"))  # at most ``n`` rows
    risk = user_view(sessions.join(few, "insured_id", "left_semi"), anomalies.join(few, "insured_id", "left_semi")).select("insured_id", "average_risk", "alert_count", "critical_alert_count")
    level = F.coalesce(F.upper(F.trim(blank_to_null(F.col("churn_risk_level")))), F.lit("UNKNOWN"))
    out = deciding.select("insured_id", "session_id", "churn_probability", level.alias("churn_risk_level"), F.col("final_risk_score").alias("latest_final_risk_score"), F.col("risk_level").alias("latest_risk_level"))
    return out.join(risk, "insured_id", "left")
