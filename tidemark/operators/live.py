"""What is known of a session while it goes on, as a state that merges: from events one at a time, in micro-batches, or all at once.

``contributions`` turns each event into a state of its own. Two states of a session merge by sums, greatest values, and
the earlier first and later last event by (time, sequence number, id), so events may come in any order and
any grouping with one result. ``session_states`` merges in a batch, ``streaming.live`` in a stream; ``live_view``
reads the summary from a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import FeatureParams
from .sessions import SESSION

# The number of events that the live view looks back at.
RECENT = 50
SUMS = {
    "events": "long", "oks": "long", "kos": "long", "request_bytes": "long", "response_bytes": "long", "pause_sum": "long", "pause_count": "long", "business_events": "long",
    "weekend_events": "long", "downloads": "long", "risk_sum": "double", "risk_count": "long", "anomaly_events": "long",
}
MOST = {
    "unique_ips": "int", "unique_devices": "int", "ip_changed": "int", "device_changed": "int", "max_downloads": "int", "ping_pongs": "int", "has_login": "int", "has_logout": "int",
    "cumulative_kos": "int", "longest_ko_streak": "int", "risk_max": "double",
}
#: What is kept of the first and of the last event.
EDGE = ["action", "page", "status", "ip", "device", "country"]
#: What is kept of each recent event.
SEEN = ["action", "route", "anomaly_type"]


def contributions(events: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Each event as the state of a session of that event alone. Features that ``events`` lacks count as unknown."""
    have = set(events.columns)
    of = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    flag = lambda c: F.coalesce(of(c, "int"), F.lit(0))
    filled = lambda c: F.coalesce(F.trim(of(c, "string")) != "", F.lit(False))
    text = lambda c: F.coalesce(of(c, "string"), F.lit(""))
    at, status = of("created_at", "timestamp"), F.upper(of("status", "string"))
    pause, risk = of("time_delta_since_last_action", "long"), of("session_risk_score", "double")
    hour = F.coalesce(of("hour_of_day", "int"), F.hour(at))
    weekend = F.coalesce(of("is_weekend", "int") == 1, F.weekday(at) >= 5, F.lit(False))
    one = lambda test: F.coalesce(test, F.lit(False)).cast("long")
    sums = {
        "events": F.lit(1), "oks": one(status == "OK"), "kos": one(status == "KO"), "request_bytes": F.coalesce(of("request_data_size_bytes", "long"), F.lit(0)),
        "response_bytes": F.coalesce(of("response_data_size_bytes", "long"), F.lit(0)), "pause_sum": F.coalesce(pause, F.lit(0)), "pause_count": one(pause.isNotNull()),
        "business_events": one(hour.between(9, 18)), "weekend_events": one(weekend), "downloads": flag("is_download_action"), "risk_sum": F.coalesce(risk, F.lit(0.0)),
        "risk_count": one(risk.isNotNull()), "anomaly_events": one(flag("is_anomaly") == 1),
    }
    most = {
        "unique_ips": F.when(filled("ip"), flag("unique_ips_in_session")).otherwise(0), "unique_devices": F.when(filled("device"), flag("unique_devices_in_session")).otherwise(0),
        "ip_changed": one(flag("is_ip_changed") == 1), "device_changed": one(flag("is_device_changed") == 1), "max_downloads": flag("downloads_last_2_minutes"),
        "ping_pongs": flag("ping_pong_count"), "has_login": one(text("action").isin(*p.login_actions)), "has_logout": one(text("action").isin(*p.logout_actions)),
        "cumulative_kos": flag("cumulative_kos"), "longest_ko_streak": flag("longest_ko_streak"), "risk_max": F.greatest(F.lit(0.0), F.coalesce(risk, F.lit(0.0))),
    }
    country = F.coalesce(F.when(filled("ip_country"), of("ip_country", "string")), of("country_code", "string"))
    return events.select(
        *SESSION, F.unix_micros(at).alias("at_us"), of("sequence_in_session", "long").alias("seq"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("event_id"),
        *(sums[k].cast(t).alias(k) for k, t in SUMS.items()), *(most[k].cast(t).alias(k) for k, t in MOST.items()),
        *(text(c).alias(c) for c in EDGE if c != "country"), country.alias("country"), of("route", "string").alias("route"), of("anomaly_type", "string").alias("anomaly_type"),
    )


def session_states(events: DataFrame, p: FeatureParams = FeatureParams(), recent: int = RECENT) -> DataFrame:
    """The state of each session after all of its events: one pass, one shuffle, by session.

    ``events`` are enriched. Events without a time are never first or last; in a session without any time
    there is no first. Of the last ``recent`` events, by sequence number, time and id, action, route and type are kept.
    """
    number = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    order = F.when(F.col("at_us").isNotNull(), F.struct("at_us", number(F.col("seq")).alias("seq"), "event_id"))
    newest = Window.partitionBy(*SESSION).orderBy(F.col("seq").desc_nulls_first(), F.col("at_us").desc_nulls_first(), F.col("event_id").desc_nulls_first())
    rows = contributions(events, p).withColumn("_back", F.row_number().over(newest))
    edge = F.struct("at_us", *EDGE)
    kept = F.array_sort(F.collect_list(F.when(F.col("_back") <= recent, F.struct((-F.col("_back")).alias("place"), *SEEN))))
    return rows.groupBy(*SESSION).agg(
        *(F.sum(c).alias(c) for c in SUMS), *(F.max(c).alias(c) for c in MOST), F.min_by(edge, order).alias("first"), F.max_by(edge, order).alias("last"),
        F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in SEEN))).alias("recent"),
    )


def running_states(events: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """``id`` and the state of its session after each event, in order of arrival: what the accumulator holds from event to event.

    Besides sums and greatest values: the first and the last event so far by time, sequence number and id, and ``failures_in_a_row`` and
    ``most_failures_in_a_row``, which only OK and all else but KO break. All share one partitioning and one order.
    """
    rows = contributions(events, p).withColumn("_n", F.coalesce("seq", F.lit((1 << 63) - 1)))
    arrival = Window.partitionBy(*SESSION).orderBy("_n", F.col("at_us").asc_nulls_last(), "event_id")
    upto = arrival.rowsBetween(Window.unboundedPreceding, 0)
    order = F.when(F.col("at_us").isNotNull(), F.struct("at_us", F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), "event_id"))
    edge = F.struct("at_us", *EDGE)
    place = F.row_number().over(arrival)
    broken = F.coalesce(F.max(F.when(F.col("kos") == 0, F.col("_place"))).over(upto), F.lit(0))
    numbered = rows.withColumn("_place", place).withColumn("failures_in_a_row", F.when(F.col("kos") > 0, F.col("_place") - broken).otherwise(0))
    return numbered.select(
        *SESSION, F.col("event_id").alias("id"), *(F.sum(c).over(upto).alias(c) for c in SUMS), *(F.max(c).over(upto).alias(c) for c in MOST),
        F.min_by(edge, order).over(upto).alias("first"), F.max_by(edge, order).over(upto).alias("last"),
        "failures_in_a_row", F.max("failures_in_a_row").over(upto).alias("most_failures_in_a_row"),
    )


def _first_filled(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: F.trim(x) != ""), F.lit(0))


def live_view(states: DataFrame) -> DataFrame:
    """The summary that the live view shows of each state.

    Where nothing recent is kept, the first and last action stand for the sequence, and numbers of
    different values are at least 1. The least and greatest pause are not kept while a session goes on and are 0.
    A session without any time has an empty summary: counts are null, lists empty, its type normal.
    """
    c = F.col
    some, timed = F.size("recent") > 0, c("first").isNotNull()
    start, end = F.timestamp_micros(c("first.at_us")), F.timestamp_micros(c("last.at_us"))
    of = lambda name: F.transform("recent", lambda x: x[name])
    actions = F.when(some, F.transform("recent", lambda x: F.coalesce(x.action, F.lit("")))).otherwise(F.array(c("first.action"), c("last.action")))
    routes = F.filter(of("route"), lambda x: F.trim(x) != "")
    types = F.array_distinct(F.filter(of("anomaly_type"), lambda x: (F.trim(x) != "") & (F.lower(x) != "normal")))
    named = states.withColumns({"_actions": actions, "_routes": F.array_distinct(routes), "_types": types})
    counts = F.map_from_entries(F.transform(F.array_distinct(c("_actions")), lambda a: F.struct(a, F.size(F.filter(c("_actions"), lambda x: x == a)).cast("bigint"))))
    least = lambda n: F.when(some, c(n)).otherwise(F.greatest(F.lit(1), c(n)))
    empty = F.array().cast("array<string>")
    shown = {
        "country_code": c("first.country"), "session_start": start, "session_end": end, "start_hour": F.hour(start), "end_hour": F.hour(end), "day_of_week": F.weekday(start),
        "is_weekend": (c("weekend_events") > 0).cast("int"), "first_action": c("first.action"), "last_action": c("last.action"),
        "first_route": F.when(some, F.coalesce(_first_filled(of("route")), F.lit(""))), "last_route": F.when(some, F.coalesce(_first_filled(F.reverse(of("route"))), F.lit(""))),
        "total_events": c("events"), "total_duration_seconds": F.greatest(F.lit(0), F.floor((c("last.at_us") - c("first.at_us")) / 1_000_000)),
        "avg_inter_action_seconds": F.when(c("pause_count") > 0, c("pause_sum") / c("pause_count")).otherwise(0.0), "min_inter_action_seconds": F.lit(0.0),
        "max_inter_action_seconds": F.lit(0.0), "unique_actions": F.when(some, F.size(F.array_distinct("_actions"))).otherwise(1),
        "unique_routes": F.when(some, F.size("_routes")).otherwise(1), "unique_ips_used": least("unique_ips"), "unique_devices_used": least("unique_devices"),
        "total_kos": c("kos"), "total_oks": c("oks"), "longest_ko_streak": c("longest_ko_streak"), "has_login": c("has_login"), "has_logout": c("has_logout"),
        "ip_changed": c("ip_changed"), "device_changed": c("device_changed"), "total_download_actions": c("downloads"), "max_downloads_in_2_minutes": c("max_downloads"),
        "ping_pong_count": c("ping_pongs"), "risk_score_max": c("risk_max"), "risk_score_avg": F.when(c("risk_count") > 0, c("risk_sum") / c("risk_count")).otherwise(0.0),
        "ended_abruptly": ((c("has_logout") == 0) & (c("events") >= 3)).cast("int"), "anomaly_event_count": c("anomaly_events"),
        "action_sequence_signature": F.array_join("_actions", " > "), "route_sequence_signature": F.array_join("_routes", " > "),
    }
    lists = {"anomaly_types": c("_types"), "campaign_ids": empty, "action_sequence": c("_actions"), "route_sequence": c("_routes")}
    return named.select(
        *SESSION, *(F.when(timed, x).alias(k) for k, x in shown.items()), F.when(timed, F.coalesce(F.get("_types", F.lit(0)), F.lit("normal"))).otherwise("normal").alias("primary_anomaly_type"),
        *(F.when(timed, x).otherwise(empty).alias(k) for k, x in lists.items()), F.when(timed, counts).otherwise(F.create_map().cast("map<string,bigint>")).alias("action_counts"),
    )


def live_summaries(events: DataFrame, p: FeatureParams = FeatureParams(), recent: int = RECENT) -> DataFrame:
    """Live summaries of the sessions of enriched events; ``recent`` of 0 shows what the totals alone tell."""
    return live_view(session_states(events, p, recent))
