"""The tables that catalogue queries start from, made of the generated events by fixed rules.

Model artifacts are not part of this library, so model scores, churn probabilities and clusters are
plain functions of a session's counts: enough to run every fusion path, null scores included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import GENERATED
from ..functions.scores import business_hours, risk_level
from ..operators import fusion, rules, sessions, summary
from ..sources.audit import audit_events

P = GENERATED
#: Rows that one task sorts, some 1.6 kB each over all sorts of an enrichment.
TASK_ROWS = 100_000


def task_count(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks the events make, of ``TASK_ROWS`` each, by the footers of their files; None where the session has as many cores."""
    tasks = -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // TASK_ROWS)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.assign_sessions(sessions.dealt(audit_events(spark, sf_dir), task_count(spark, sf_dir), "insured_id"), P.sessions.gap_seconds)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.enrich(session_events(spark, sf_dir), P.features)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarize(enriched(spark, sf_dir), P.features)


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with rules, their points, context and boost."""
    rows = rules.flag_rows(enriched(spark, sf_dir), P.rules)
    both = summary.summarize(rows, P.features, also=rules.flag_aggregates(P.rules)).withColumn("triggered_rules", rules.triggered_rules()).drop(*rules.RULES)
    return rules.score_rules(both, business_hours=business_hours(F.col("end_hour")))


def with_model_scores(df: DataFrame) -> DataFrame:
    n, kos = F.col("total_events"), F.col("total_kos")
    some = lambda missing, value: F.when(~missing, F.pmod(value, F.lit(101)).cast("double"))
    return df.withColumns({
        "xgboost_score": some(n % 5 == 0, n * 7 + kos * 13), "lightgbm_score": some(kos % 4 == 3, n * 11 + F.col("ping_pong_count") * 17),
        "transformer_score": some(F.col("unique_routes") == 2, n * 5 + F.col("total_download_actions") * 19), "tcn_score": some(n % 3 == 0, n * 3 + F.col("unique_ips_used") * 23),
        "catboost_score": F.pmod(n * 29, F.lit(101)).cast("double"), "svm_score": F.pmod(n * 31 + kos, F.lit(101)).cast("double"),
        "api_template": F.when(n % 2 == 0, "/auth/login").otherwise("/documents/file"),
    })


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.flags(fusion.fuse(with_model_scores(ruled(spark, sf_dir)), P.fusion), P.fusion)
    return fusion.decide_alerts(fusion.attribute(out), P.fusion)


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished sessions with their score, type, churn probability and cluster."""
    n = F.col("total_events")
    return fused(spark, sf_dir).select(
        "insured_id", "session_id", F.col("session_end").alias("end_time"), "start_hour", "end_hour", "final_risk_score", "risk_level", "rule_codes",
        F.col("anomaly_type_attributed").alias("anomaly_type"), F.col("total_duration_seconds").alias("session_duration_seconds"), "action_counts", "last_action",
        "ended_abruptly", "total_events", "primary_anomaly_type",
        F.when(n % 7 != 0, F.pmod(n * 37, F.lit(100)) / 100).alias("churn_probability"), F.when(n % 5 != 4, n % 5).alias("cluster"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert for each event of some risk, partly hydrated; every third comes twice, the second time poorer."""
    e = enriched(spark, sf_dir)
    n = F.col("event_id")
    base = e.where("session_risk_score >= 35").select(
        F.col("id").alias("event_id"), "insured_id", "session_id", F.col("created_at").alias("timestamp"), F.col("created_at") .alias("created_at"),
        F.col("session_risk_score").alias("final_risk_score"), risk_level(F.col("session_risk_score"), P.fusion).alias("risk_level"), "anomaly_type",
        F.col("action").alias("event_action"), F.when(F.col("k") % 2 == 0, F.col("device")).alias("device"), F.when(F.col("k") % 4 < 2, F.col("country_code")).alias("country"),
    )
    twice = base.withColumn("position", F.explode(F.when(n % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    first = F.col("position") == 0
    return twice.withColumns({"device": F.when(first, F.col("device")), "event_action": F.when(first, F.col("event_action")).otherwise("")})


def alerts_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts dealt out by event: what joins and ranks them by event shuffles no more."""
    return sessions.dealt(alerts(spark, sf_dir), task_count(spark, sf_dir), "event_id")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored anomaly of each alert: complete, detected a second later."""
    e = enriched(spark, sf_dir)
    return e.where("session_risk_score >= 35").select(
        F.col("id").alias("event_id"), "insured_id", "session_id", F.col("created_at").alias("event_time"), (F.col("created_at") + F.expr("interval 1 second")).alias("detected_at"),
        F.col("session_risk_score").alias("final_risk_score"), risk_level(F.col("session_risk_score"), P.fusion).alias("risk_level"), "anomaly_type", "device",
        F.col("country_code").alias("country"),
    )


def anomalies_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies dealt out by event, as ``alerts_by_event`` are."""
    return sessions.dealt(anomalies(spark, sf_dir), task_count(spark, sf_dir), "event_id")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as events of sessions."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    none = lambda t: F.lit(None).cast(t)
    return c.select(
        F.col("conv_id").alias("insured_id"), F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("sequence_in_session"), F.col("turn").alias("id"),
        none("timestamp").alias("created_at"), F.col("role").alias("action"), F.length("text").alias("n_chars"),
    )


def detail_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Anomalies and session analyses with payloads that speak of their own event, of another one, or are missing, by fixed rules."""
    about = lambda x: F.concat(F.lit('{"eventMetadata":{"eventId":"'), x.cast("string"), F.lit('"},"eventId":"'), x.cast("string"), F.lit('"}'))
    n = F.col("event_id")
    rows = anomalies(spark, sf_dir)
    own = F.when(n % 4 == 0, about(n)).when(n % 4 == 1, about(n + 1)).when(n % 8 == 2, F.lit("no json"))
    first = rows.groupBy("insured_id", "session_id").agg(F.min("event_id").alias("e"), F.max("detected_at").alias("created_at"))
    latest = F.struct("created_at", F.when(F.col("e") % 3 != 0, about(F.col("e"))).alias("payload"))
    earlier = F.struct((F.col("created_at") - F.expr("interval 1 hour")).alias("created_at"), about(F.lit(-1)).alias("payload"))
    sessions_ = first.select("insured_id", "session_id", F.inline(F.array(latest, earlier)))
    return sessions.dealt(rows, task_count(spark, sf_dir), "event_id").withColumn("payload", own), sessions_
