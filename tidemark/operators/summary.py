"""One row for each session: what happened in it, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import FeatureParams
from ..functions.text import comparison_key, key_is_one_of
from .sessions import SESSION, in_session


def summarize(enriched: DataFrame, p: FeatureParams = FeatureParams(), abrupt_least: int = 3, also: Sequence[Column] = ()) -> DataFrame:
    """Session summaries of enriched events.

    ``abrupt_least``: events from which a session without a logout ended abruptly (1 as the offline
    derivation has it). Averages over nothing are 0; the primary type is the most frequent one that is
    neither blank nor ``normal``, the first seen among equals, else ``normal``. ``also``: more aggregates of the same
    rows. Sequences are columns of their own: where a query drops them, Spark never collects them.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    number = F.col("number_in_session")
    action = F.coalesce("action", F.lit(""))
    kind = F.when((F.trim("anomaly_type") != "") & (F.lower("anomaly_type") != "normal"), F.col("anomaly_type"))
    gap = F.when(number > 1, F.col("time_delta_since_last_action"))
    edge = F.struct(F.col("created_at").alias("at"), action.alias("action"), F.coalesce(blank("route"), F.lit("")).alias("route"))
    different = lambda c: F.size(F.collect_set(c)).cast("int")

    def in_order(c: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(number.alias("n"), c.alias("x")))))
        return F.transform(rows, lambda r: r.x)

    out = enriched.withColumn("_key", comparison_key(action)).groupBy(*SESSION).agg(
        F.min_by(edge, number).alias("_first"), F.max_by(edge, number).alias("_last"),
        in_order(action).alias("action_sequence"), in_order(blank("route")).alias("route_sequence"), in_order(kind).alias("_kinds"),
        F.count("*").cast("int").alias("total_events"),
        different(action).alias("unique_actions"),
        different(blank("route")).alias("unique_routes"),
        F.greatest(F.lit(1), different(blank("ip"))).alias("unique_ips_used"),
        F.greatest(F.lit(1), different(blank("device"))).alias("unique_devices_used"),
        F.count_if(F.upper("status") == "KO").cast("int").alias("total_kos"),
        F.count_if(F.upper("status") == "OK").cast("int").alias("total_oks"),
        F.max("longest_ko_streak").alias("longest_ko_streak"),
        F.max(key_is_one_of(F.col("_key"), p.login_actions).cast("int")).alias("has_login"),
        F.max(key_is_one_of(F.col("_key"), p.logout_actions).cast("int")).alias("has_logout"),
        F.max("is_ip_changed").alias("ip_changed"),
        F.max("is_device_changed").alias("device_changed"),
        F.sum("is_download_action").cast("int").alias("total_download_actions"),
        F.max("downloads_last_2_minutes").alias("max_downloads_in_2_minutes"),
        F.max("ping_pong_count").alias("ping_pong_count"),
        F.max("session_risk_score").alias("risk_score_max"),
        F.avg("session_risk_score").alias("risk_score_avg"),
        F.count_if(F.col("is_anomaly") == 1).cast("int").alias("anomaly_event_count"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("avg_inter_action_seconds"),
        F.coalesce(F.min(gap).cast("double"), F.lit(0.0)).alias("min_inter_action_seconds"),
        F.coalesce(F.max(gap).cast("double"), F.lit(0.0)).alias("max_inter_action_seconds"),
        *also,
    )
    # the first of the most frequent: counts by first place
    counted = F.transform(F.array_distinct("_kinds"), lambda k: F.struct(
        F.size(F.filter("_kinds", lambda x: x == k)).alias("n"), (-F.array_position("_kinds", k)).alias("first"), k.alias("kind")))
    start, end = F.col("_first.at"), F.col("_last.at")
    return out.withColumns({
        "session_start": start, "session_end": end, "first_action": F.col("_first.action"), "last_action": F.col("_last.action"),
        "first_route": F.col("_first.route"), "last_route": F.col("_last.route"),
        "start_hour": F.coalesce(F.hour(start), F.lit(0)), "end_hour": F.coalesce(F.hour(end), F.lit(0)), "day_of_week": F.coalesce(F.weekday(start), F.lit(3)),
        "total_duration_seconds": F.coalesce(F.greatest(F.lit(0).cast("bigint"), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000)), F.lit(0)),
        "ended_abruptly": ((F.col("has_logout") == 0) & (F.col("total_events") >= abrupt_least)).cast("int"),
        "primary_anomaly_type": F.coalesce(F.array_max(counted)["kind"], F.lit("normal")),
        "anomaly_types": F.array_distinct("_kinds"),
        "action_sequence_signature": F.array_join("action_sequence", " > "),
        "route_sequence_signature": F.array_join("route_sequence", " > "),
        "action_counts": action_histogram(F.col("action_sequence")),
    }).drop("_first", "_last", "_kinds")


def action_histogram(actions):
    """Occurrences of each action, in order of their first one."""
    return F.map_from_entries(F.transform(F.array_distinct(actions), lambda a: F.struct(a, F.size(F.filter(actions, lambda x: x == a)).cast("bigint"))))


def running_summary(enriched: DataFrame) -> DataFrame:
    """After each event, the summary of its session so far: the batch form of the live accumulator.

    As live, the least and greatest pause stay 0 and only their sum and number are kept.
    """
    upto = in_session().rowsBetween(Window.unboundedPreceding, 0)
    pauses = F.count("*").over(upto) - 1
    return enriched.select(
        *SESSION, "id", F.count("*").over(upto).cast("int").alias("events_so_far"), F.first("action").over(upto).alias("first_action"),
        F.col("action").alias("last_action"), F.sum(F.when(F.upper("status") == "KO", 1).otherwise(0)).over(upto).cast("int").alias("kos_so_far"),
        F.when(pauses > 0, F.sum("time_delta_since_last_action").over(upto) / pauses).otherwise(0.0).alias("avg_pause_so_far"),
        F.max("session_risk_score").over(upto).alias("risk_max_so_far"),
    )


def recent_events(events: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` events of each session, with ``from_last``, 1 for the last one."""
    w = Window.partitionBy(*SESSION).orderBy(*(F.col(c).desc_nulls_first() for c in ("sequence_in_session", "created_at", "id")))
    return events.withColumn("from_last", F.row_number().over(w)).where(F.col("from_last") <= n)


def live_summary(enriched: DataFrame, n: int = 50) -> DataFrame:
    """What the live view knows of a session: totals of all its events, and what its last ``n`` show.

    One pass over the session's partitioning; where nothing is recent, the totals alone count.
    """
    w = Window.partitionBy(*SESSION).orderBy(*(F.col(c).desc_nulls_first() for c in ("sequence_in_session", "created_at", "id")))
    rows = enriched.withColumn("_back", F.row_number().over(w))
    recent, later = F.col("_back") <= n, F.col("number_in_session") > 1
    ko = F.upper("status") == "KO"
    return rows.groupBy(*SESSION).agg(
        F.count("*").cast("int").alias("events"), F.count_if(ko).cast("int").alias("kos"), F.max("session_risk_score").alias("risk_max"),
        F.coalesce(F.avg(F.when(later, F.col("time_delta_since_last_action"))), F.lit(0.0)).alias("avg_pause"),
        F.min_by("action", "number_in_session").alias("first_action"), F.max_by("action", "number_in_session").alias("last_action"),
        F.count_if(recent).cast("int").alias("recent_events"), F.count_if(recent & ko).cast("int").alias("recent_kos"),
        F.size(F.collect_set(F.when(recent, F.col("action")))).alias("recent_actions"), F.size(F.collect_set(F.when(recent, F.col("ip")))).alias("recent_ips"),
        F.sum(F.when(recent, F.col("is_download_action"))).cast("int").alias("recent_downloads"), F.max(F.when(recent, F.col("ping_pong_count"))).alias("recent_ping_pongs"),
    )
