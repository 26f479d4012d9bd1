"""Fusion of rule and model scores into one risk, its level, attribution and alert decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import FusionParams
from ..functions.scores import clamp, risk_level

MODELS = ("xgboost", "lightgbm", "transformer", "tcn")


def fuse(df: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Adds ``final_risk_score``, ``risk_level``, ``fallback_mode`` and each part's contribution.

    Columns read: ``xgboost_score``, ``lightgbm_score``, ``transformer_score``, ``tcn_score`` (0..100, null where a
    model gave none), ``rule_score``, ``business_context_score``, ``aggregation_boost``. The weight of missing models goes to the others in
    proportion; without any model the rules' score and the boost count in full.
    """
    score = {m: F.col(f"{m}_score") for m in MODELS}
    weight = {m: getattr(p, m) for m in MODELS}
    there = sum((F.when(score[m].isNotNull(), weight[m]).otherwise(0.0) for m in MODELS), F.lit(0.0))
    gone = sum((F.when(score[m].isNull(), weight[m]).otherwise(0.0) for m in MODELS), F.lit(0.0))
    rules, context, boost = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("rule_score", "business_context_score", "aggregation_boost"))
    out = df.withColumns({"_there": there, "_gone": gone})
    share = lambda m: F.lit(weight[m]) + (F.col("_gone") * (F.lit(weight[m]) / F.col("_there")) if p.renormalize else F.lit(0.0))
    out = out.withColumns({f"{m}_contribution": F.when(score[m].isNull(), 0.0).otherwise(score[m] * share(m)) for m in MODELS})
    out = out.withColumns({"rule_contribution": rules * p.rules, "business_context_contribution": context * p.business_context})
    parts = sum((F.col(f"{m}_contribution") for m in MODELS), F.lit(0.0))
    none = F.col("_there") == 0.0
    total = F.when(none, rules + boost).otherwise(parts + F.col("rule_contribution") + F.col("business_context_contribution") + boost)
    null = {m: score[m].isNull() for m in MODELS}
    mode = (
        F.when(none, "RULES_ONLY").when(F.col("_gone") == 0.0, "FULL_HYBRID").when(null["transformer"] & null["tcn"], "TABULAR_RULES")
        .when(null["xgboost"] & null["lightgbm"], "SEQUENCE_RULES").otherwise("PARTIAL_HYBRID")
    )
    out = out.withColumns({"final_risk_score": clamp(total), "fallback_mode": mode}).drop("_there", "_gone")
    return out.withColumn("risk_level", risk_level(F.col("final_risk_score"), p))


def sum_of_parts() -> Column:
    """What ``fuse`` holds to 0..100 where models scored: all contributions and the boost."""
    parts = (F.col(f"{m}_contribution") for m in (*MODELS, "rule", "business_context"))
    return sum(parts, F.lit(0.0)) + F.coalesce("aggregation_boost", F.lit(0.0))


def rules_only(df: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Fusion as it is when no model may run: no scores and no boost."""
    none = {f"{m}_score": F.lit(None).cast("double") for m in MODELS}
    return fuse(df.withColumns(none | {"aggregation_boost": F.lit(0.0)}), p)


def flags(df: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Adds ``ai_risk_score``, ``is_anomaly``, ``binary_anomaly`` and ``anomaly_probability``."""
    s = [F.coalesce(F.col(f"{m}_score"), F.lit(0.0)) for m in ("xgboost", "lightgbm", "transformer", "tcn")]
    out = df.withColumn("ai_risk_score", F.greatest(*s))
    return out.withColumns({
        "is_anomaly": F.col("final_risk_score") >= p.medium, "binary_anomaly": F.col("ai_risk_score") >= p.medium,
        "anomaly_probability": F.col("final_risk_score") / 100,
    })


def _joined(columns: list[str], have: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *(c for c in columns if c in have)))


def _mentions(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def attribute(df: DataFrame) -> DataFrame:
    """Adds ``anomaly_type_attributed`` and ``anomaly_type_confidence``: the first case that holds."""
    have = df.columns
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)
    has = lambda *codes: F.arrays_overlap("rule_codes", F.array(*map(F.lit, codes)))
    xgb, cat, svm, seq = z("xgboost_score"), z("catboost_score"), z("svm_score"), F.greatest(z("transformer_score"), z("tcn_score"))
    login = _mentions(_joined(["api_template", "action_value", "frontend_action_name", "action_type"], have), ["login", "connexion", "auth"])
    sensitive = _mentions(
        _joined(["api_template", "api_family", "controller", "action_value"], have), ["document", "download", "wallet", "bank", "insured", "file"]
    )
    # Tests in order, the type that each names and how sure it is.
    cases = [
        ((xgb >= 60) & has("API_SCRAPING_PATTERN") & (F.col("ping_pong_count") >= 2), "api_scraping", 0.82),
        ((has("STATUS_CODE_BURST") | (F.col("total_kos") >= 3)) & login & (seq >= 50), "credential_stuffing", 0.80),
        (has("LARGE_DOWNLOAD", "DATA_EXTRACTION_PATTERN") & sensitive & ((xgb >= 55) | (cat >= 55)), "data_exfiltration", 0.82),
        (has("OFF_HOURS_ACCESS", "SENSITIVE_API_OFF_HOURS") & (has("COUNTRY_SWITCH", "DEVICE_SWITCH") | (svm >= 55)), "off_hours_compromise", 0.78),
        (has("COUNTRY_SWITCH", "DEVICE_SWITCH") & (seq >= 55), "session_hijacking", 0.76),
        ((seq >= 60) & (z("rule_score") < 35), "behavioral_sequence_anomaly", 0.68),
        (z("final_risk_score") >= 60, "unknown_suspicious_behavior", 0.55),
    ]
    kind = sure = None
    for test, name, confidence in cases:
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        sure = F.when(test, confidence) if sure is None else sure.when(test, confidence)
    return df.withColumns({"anomaly_type_attributed": kind.otherwise("unknown_suspicious_behavior"), "anomaly_type_confidence": sure.otherwise(0.45)})


def decide_alerts(df: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Adds ``alert_eligible`` and ``alert_reason``."""
    final, ensemble = F.coalesce(F.col("final_risk_score"), F.lit(0.0)), F.coalesce(F.col("ai_risk_score"), F.lit(0.0))
    has_rules = F.size(F.coalesce(F.col("rule_codes"), F.array().cast("array<string>"))) > 0
    eligible = F.col("is_anomaly") | (final >= p.alert) | (ensemble >= p.alert)
    reason = (
        F.when(~eligible, "BELOW_THRESHOLD").when(F.col("is_anomaly") & has_rules, "RULE_AND_RISK").when(F.col("is_anomaly"), "ANOMALY_THRESHOLD")
        .when(final >= p.alert, "FINAL_RISK_THRESHOLD").when(has_rules, "RULE_TRIGGER").otherwise("UNKNOWN")
    )
    return df.withColumns({"alert_eligible": eligible, "alert_reason": reason})


def load_shedding(lag: Column, tcn_from: int = 5_000, rules_from: int = 20_000) -> Column:
    """Which scoring a backlog allows."""
    return F.when(lag >= rules_from, "RULES_ONLY").when(lag >= tcn_from, "TCN").otherwise("TRANSFORMER")


def offline_score(df: DataFrame) -> Column:
    """The notebook's ensemble of rules, anomaly probability ``p_anomaly`` and churn probability ``p_churn``."""
    on = lambda t, n: F.when(t, float(n)).otherwise(0.0)
    c = F.col
    return clamp(
        on(c("ip_changed") == 1, 30) + on(c("device_changed") == 1, 25) + on(c("total_kos") >= 3, 15) + on(c("total_download_actions") >= 10, 15)
        + on(c("ping_pong_count") >= 2, 15) + 40 * c("p_anomaly") + 15 * c("p_churn")
    )
