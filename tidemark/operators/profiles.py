"""What is known of a user: rolling risk, clean streaks, habits and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import ProfileParams
from ..functions.scores import business_hours
from ..functions.text import api_family, comparison_key
from .alerts import latest_by
from .sessions import SESSION


def _newest(*columns: str) -> Column:
    return F.struct(*columns)


def risk_profile(sessions: DataFrame, as_of: str, p: ProfileParams = ProfileParams()) -> DataFrame:
    """Profiles over the 30 and 7 days before ``as_of``, of users with a session in them.

    ``sessions``: insured_id, session_id, end_time, final_risk_score, anomaly_type, session_duration_seconds, action_counts (map).
    """
    now = F.lit(as_of).cast("timestamp")
    month = sessions.where((F.col("end_time") > now - F.expr("interval 30 days")) & (F.col("end_time") <= now))
    week = F.col("end_time") > now - F.expr("interval 7 days")
    bad = F.coalesce(F.col("final_risk_score") >= p.anomaly_at, F.lit(False))
    kind = F.when(bad & (F.trim("anomaly_type") != ""), F.struct("end_time", "session_id", "anomaly_type"))
    risky = F.coalesce(F.lower("anomaly_type").isin(*(t.lower() for t in p.high_risk_types)), F.lit(False)) if p.high_risk_types else F.lit(False)
    duration = F.coalesce(F.col("session_duration_seconds").cast("double"), F.lit(0.0))
    # a row for each action of a session, of which the first stands for the session as well: one pass gives both
    rows = month.select("*", week.alias("_week"), bad.alias("_bad"), kind.alias("_kind"), risky.alias("_risky"), duration.alias("_seconds"), F.posexplode_outer("action_counts").alias("_at", "action", "n"))
    one = F.coalesce(F.col("_at"), F.lit(0)) == 0
    of_one = lambda c: F.when(one, c)
    by_action = rows.groupBy("insured_id", "action").agg(
        F.sum("n").alias("n"), F.count_if(one).alias("sessions_30d"), F.count_if(one & F.col("_week")).alias("sessions_7d"), F.count_if(one & F.col("_bad")).alias("anomaly_count_30d"),
        F.count_if(one & F.col("_bad") & F.col("_week")).alias("anomaly_count_7d"), F.sum(of_one(F.col("final_risk_score"))).alias("_risk"), F.count(of_one(F.col("final_risk_score"))).alias("_scored"),
        F.max("final_risk_score").alias("max_risk"), F.max("_kind").alias("_kind"), F.sum(of_one(F.col("_seconds"))).alias("_seconds"), F.max("_risky").alias("_risky"),
    )
    # most frequent first; of equals the first in the alphabet
    usual = F.min(F.when(F.col("action").isNotNull(), F.struct((-F.col("n")).alias("n"), "action")))["action"]
    counts = ("sessions_30d", "sessions_7d", "anomaly_count_30d", "anomaly_count_7d")
    out = by_action.groupBy("insured_id").agg(
        *(F.sum(c).alias(c) for c in counts), F.when(F.sum("_scored") > 0, F.sum("_risk") / F.sum("_scored")).otherwise(0.0).alias("avg_risk"),
        F.coalesce(F.max("max_risk"), F.lit(0.0)).alias("max_risk"), F.max("_kind")["anomaly_type"].alias("last_anomaly_type"),
        (F.sum("_seconds") / F.sum("sessions_30d")).alias("avg_session_duration_30d"), F.max("_risky").alias("_risky"), usual.alias("most_frequent_action_30d"),
    )
    rate = F.col("anomaly_count_30d") / F.col("sessions_30d")
    out = out.withColumn("anomaly_rate_30d", rate)
    tier = (
        F.when(F.col("_risky") | (F.col("max_risk") >= 80), "HIGH").when((F.col("anomaly_rate_30d") >= p.high_rate) | (F.col("avg_risk") >= 60), "HIGH")
        .when((F.col("anomaly_rate_30d") >= p.medium_rate) | (F.col("avg_risk") >= 35), "MEDIUM").otherwise("LOW")
    )
    return out.withColumn("risk_tier", tier).drop("_risky")


def clean_streak(sessions: DataFrame, anomaly_at: float = ProfileParams.anomaly_at, most: int = 200) -> DataFrame:
    """Sessions since the last anomalous one, among a user's latest ``most``."""
    w = Window.partitionBy("insured_id").orderBy(F.col("end_time").desc_nulls_last(), F.col("session_id").desc())
    rows = sessions.withColumn("n", F.row_number().over(w)).where(f"n <= {most}")
    dirty = F.min(F.when(F.col("final_risk_score") >= anomaly_at, F.col("n")))
    return rows.groupBy("insured_id").agg(F.coalesce(dirty - 1, F.count("*")).cast("int").alias("consecutive_clean_sessions"))


def latest_n(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where(f"_n <= {n}").drop("_n")


def user_360(sessions: DataFrame, anomalies: DataFrame, recent: int = 10) -> DataFrame:
    """Average risk over a user's latest sessions, alerts and critical ones among the latest anomalies."""
    s = latest_n(sessions, "insured_id", recent, "end_time", "session_id").groupBy("insured_id").agg(
        F.avg("final_risk_score").alias("avg_risk"), F.count("*").alias("recent_sessions"))
    a = latest_n(anomalies, "insured_id", recent, "detected_at", "event_id").groupBy("insured_id").agg(
        F.count("*").alias("alerts"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_alerts"))
    zero = {"recent_sessions": 0, "alerts": 0, "critical_alerts": 0}
    return s.join(a, "insured_id", "full").fillna(zero)


def active_hours(sessions: DataFrame, events: DataFrame, top: int = 3) -> DataFrame:
    """A user's most frequent hours over starts, ends and events; of equals the earlier."""
    hours = sessions.select("insured_id", F.explode(F.array("start_hour", "end_hour")).alias("hour")).unionByName(
        events.select("insured_id", F.hour("created_at").alias("hour"))
    )
    counts = hours.where("hour is not null").groupBy("insured_id", "hour").agg(F.count("*").alias("n"))
    w = Window.partitionBy("insured_id").orderBy(F.desc("n"), "hour")
    return counts.withColumn("rank", F.row_number().over(w)).where(f"rank <= {top}").select("insured_id", "rank", "hour", "n")


def top_api_families(rows: DataFrame, top: int = 5) -> DataFrame:
    """A user's most frequent families of ``rows(insured_id, family)``; placeholders do not count."""
    counts = rows.select("insured_id", api_family(F.col("family")).alias("family")).where("family is not null").groupBy("insured_id", "family").agg(F.count("*").alias("n"))
    w = Window.partitionBy("insured_id").orderBy(F.desc("n"), "family")
    return counts.withColumn("rank", F.row_number().over(w)).where(f"rank <= {top}").select("insured_id", "rank", "family", "n")


def churn_level(c: Column, high: float = 0.70, medium: float = 0.30) -> Column:
    return F.when(c >= high, "HIGH").when(c >= medium, "MEDIUM").when(c.isNotNull(), "LOW")


def churn_distribution(sessions: DataFrame) -> DataFrame:
    """One row: sessions by churn level, their average, and distinct users."""
    level = churn_level(F.col("churn_probability"))
    return sessions.where("churn_probability is not null").agg(
        F.count_if(level == "HIGH").alias("high"), F.count_if(level == "MEDIUM").alias("medium"), F.count_if(level == "LOW").alias("low"),
        F.avg("churn_probability").alias("avg_probability"), F.count_distinct("insured_id").alias("users"),
    )


def churn_dashboard(sessions: DataFrame, latest: int = 50, n: int = 10) -> DataFrame:
    """One row over the ``latest`` sessions: churn levels, average probability, users, and the ``n`` sessions most likely to churn."""
    rows = sessions.orderBy(F.col("end_time").desc_nulls_last(), F.col("session_id").desc()).limit(latest)
    p = F.col("churn_probability")
    level = churn_level(p)
    # at most ``latest`` rows are left
    likely = F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce(p, F.lit(0.0))).alias("p"), "session_id"))), 1, n)
    return rows.agg(
        F.count_if(level == "HIGH").alias("high"), F.count_if(level == "MEDIUM").alias("medium"), F.count_if(level == "LOW").alias("low"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("avg_probability"), F.count_distinct("insured_id").alias("users"),
        F.transform(likely, lambda x: x.session_id).alias("top_sessions"),
    )


def top_churn_users(sessions: DataFrame, limit: int = 50) -> DataFrame:
    """Users by the probability of their deciding session, highest first; 200 at most."""
    return churn_users(sessions).orderBy(F.desc("churn_probability"), "insured_id").limit(max(1, min(limit, 200)))


def churn_users(sessions: DataFrame) -> DataFrame:
    """Each user's deciding session: the latest end, then creation, then the highest probability."""
    rows = sessions.where("churn_probability is not null")
    return latest_by(rows, ["insured_id"], "end_time", "churn_probability", "session_id").select(
        "insured_id", "session_id", "churn_probability", churn_level(F.col("churn_probability")).alias("churn_risk_level")
    )


# Words in the kind of an action, and in the name of a device, whose shares churn features give.
ACTION_KINDS = ("logging", "contact", "document", "banking", "insured", "open")
DEVICE_KINDS = ("mobile", "desktop", "tablet")


def churn_session_features(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """The 32 churn features of each session.

    ``events``: enriched, with ``type``, ``device``, ``country_code`` and, where there, ``browser``, ``os``, ``ip_region``. As the live
    system has it, what only a user's history could tell is constant, and unique countries are counted as addresses.
    Usual values are comparison keys with dashes; of equally frequent ones the first seen.
    """
    key = lambda c: comparison_key(F.col(c)) if c in events.columns else F.lit("")
    share = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    fields = {"device": "device", "browser": "browser", "os": "os", "region": "ip_region"}
    rows = events.withColumns({"_type": key("type"), "_country": key("country_code"), **{f"_{k}": F.translate(key(c), " ", "-") for k, c in fields.items()}})

    def usual(c: str) -> Column:
        seen = F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("number_in_session", F.col(c).alias("v"))))), lambda x: x.v)
        # bound once, counted by value
        counted = F.transform(F.array(seen), lambda a: F.array_max(F.transform(F.array_distinct(a), lambda v: F.struct(
            F.size(F.filter(a, lambda x: x == v)).alias("n"), (-F.array_position(a, v)).alias("at"), v.alias("v")))))
        return counted[0]["v"]

    of_events = rows.groupBy(*SESSION).agg(
        *(share(F.contains("_type", F.lit(k))).alias(f"pct_{k}_actions") for k in ACTION_KINDS),
        *(share(F.contains("_device", F.lit(k))).alias(f"{k}_ratio") for k in DEVICE_KINDS),
        share(business_hours(F.hour("created_at")) == 1).alias("business_hours_ratio"), share(F.col("_country") == "fr").alias("fr_events_ratio"),
        *(usual(f"_{k}").alias(f"primary_{k}") for k in fields),
    )
    c, total, per = F.col, F.col("total_events"), lambda n: F.when(F.col("total_events") > 0, F.col(n) / F.col("total_events")).otherwise(0.0)
    of_session = summaries.select(
        *SESSION, total.alias("total_actions"), F.lit(1.0).alias("total_sessions"), F.lit(1.0).alias("days_active"), F.lit(0.0).alias("days_active_ratio"),
        (c("total_duration_seconds") * 1000.0).alias("avg_session_duration_ms"), total.alias("avg_actions_per_session"), F.lit(0.0).alias("sessions_per_week"),
        (c("avg_inter_action_seconds") * 1000.0).alias("avg_inter_action_ms"), c("unique_routes").alias("pages_visited"), per("total_kos").alias("failure_rate"),
        (c("day_of_week") >= 5).cast("double").alias("weekend_ratio"), c("unique_devices_used").alias("unique_devices"), c("unique_ips_used").alias("unique_countries"),
        F.lit(0.0).alias("is_anomalous_user"), c("anomaly_event_count").cast("double").alias("anomaly_event_count"), per("anomaly_event_count").alias("anomaly_ratio"),
        F.lit(0.0).alias("is_confuser"),
    )
    return of_session.join(of_events, SESSION)


def churn_features(events: DataFrame) -> DataFrame:
    """Shares of a user's events by kind, device and hour, and the usual device (first in the alphabet among equals)."""
    h = F.hour("created_at")
    share = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    base = events.groupBy("insured_id").agg(
        share(F.upper("status") == "KO").alias("failure_rate"), share((h >= 8) & (h < 19)).alias("business_hours_ratio"),
        share(F.col("country_code") == "FR").alias("fr_ratio"), share(F.col("is_download_action") == 1).alias("download_ratio"),
    )
    n = events.where("device is not null").groupBy("insured_id", "device").agg(F.count("*").alias("n"))
    usual = n.groupBy("insured_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "device"))["device"].alias("primary_device"))
    return base.join(usual, "insured_id", "left")
