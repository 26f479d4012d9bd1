"""Alert tables: search, order, pages, deduplication, merging and hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Alerts newest first: time, creation, id.
NEWEST = ("timestamp", "created_at", "event_id")
# What a filled field adds to an alert's richness.
RICHNESS = {
    "risk_level": 10, "timestamp": 10, "event_action": 8, "final_risk_score": 5, "anomaly_type": 5, "api_template": 5, "api_family": 5,
    "controller": 5, "page": 5, "country": 5, "device": 5, "browser": 5, "os": 5, "http_method": 5, "status": 5, "xgboost_score": 8,
    "lightgbm_score": 8, "transformer_score": 8, "tcn_score": 8, "model_contributions": 8, "triggered_rules": 8, "churn_probability": 5,
    "churn_risk_level": 5, "persona_label": 3, "llm_evidence_available": 3, "alert_status": 2,
}
MOST_ON_A_PAGE, USUAL_PAGE = 500, 100


def search(alerts: DataFrame, level=None, kind=None, insured=None, session=None, since=None, until=None) -> DataFrame:
    """Rows that meet all the given conditions; ``level`` matches the level or the tier, times are inclusive."""
    c, tests = F.col, []
    if level is not None:
        tests.append((c("risk_level") == level) | (c("anomaly_tier") == level) if "anomaly_tier" in alerts.columns else c("risk_level") == level)
    tests += [c(n) == v for n, v in (("anomaly_type", kind), ("insured_id", insured), ("session_id", session)) if v is not None]
    if since is not None:
        tests.append(c("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        tests.append(c("timestamp") <= F.lit(until).cast("timestamp"))
    for t in tests:
        alerts = alerts.where(t)
    return alerts


def lenient_filter(alerts: DataFrame, level=None, kind=None, since=None, until=None, insured=None, session=None) -> DataFrame:
    """As ``search``, without regard to case; blank conditions are none; rows without a time pass any range."""
    c = F.col
    for name, value in (("risk_level", level), ("anomaly_type", kind), ("insured_id", insured), ("session_id", session)):
        if value is not None and str(value).strip():
            alerts = alerts.where(F.lower(c(name).cast("string")) == str(value).lower())
    if since is not None:
        alerts = alerts.where(c("timestamp").isNull() | (c("timestamp") >= F.lit(since).cast("timestamp")))
    if until is not None:
        alerts = alerts.where(c("timestamp").isNull() | (c("timestamp") <= F.lit(until).cast("timestamp")))
    return alerts


def half_open(df: DataFrame, column: str, since: str, until: str) -> DataFrame:
    return df.where((F.col(column) >= F.lit(since).cast("timestamp")) & (F.col(column) < F.lit(until).cast("timestamp")))


def newest_first(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(*(F.col(c).desc_nulls_last() for c in NEWEST))


def page(alerts: DataFrame, limit: int = USUAL_PAGE, offset: int = 0, snapped: bool = False) -> DataFrame:
    """One page, newest first. ``snapped``: the offset goes down to a whole page, as the stored search has it."""
    limit = USUAL_PAGE if limit < 1 else min(limit, MOST_ON_A_PAGE)
    offset = max(0, offset)
    return newest_first(alerts).offset(offset // limit * limit if snapped else offset).limit(limit)


def richness(columns: list[str]) -> Column:
    def filled(name: str) -> Column:
        c = F.col(name)
        if name == "triggered_rules":
            return F.coalesce(F.size(c) > 0, F.lit(False))
        if name == "persona_label":
            return F.coalesce((F.trim(c) != "") & (c != "persona_disabled"), F.lit(False))
        if name == "llm_evidence_available":
            return F.coalesce(c, F.lit(False))
        return c.isNotNull() & F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))

    return sum((F.when(filled(n), points).otherwise(0) for n, points in RICHNESS.items() if n in columns), F.lit(0))


def keep_richest(alerts: DataFrame, position: str) -> DataFrame:
    """One row an event: the richest, the first by ``position`` among equals. Rows without event id go."""
    w = Window.partitionBy("event_id").orderBy(F.desc("richness"), position)
    rows = alerts.where("event_id is not null").withColumn("richness", richness(alerts.columns))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key; later columns of ``order`` break ties, all descending."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hydrate(alerts: DataFrame, events: DataFrame, fields: list[str]) -> DataFrame:
    """Fill null or blank ``fields`` from the event's latest row; nothing is overwritten."""
    from ..functions.text import first_text

    right = latest_by(events.where("event_id is not null"), ["event_id"], "detected_at").select("event_id", *(F.col(f).alias(f"_r_{f}") for f in fields))
    kinds = dict(alerts.dtypes)
    fill = lambda f: first_text(f, f"_r_{f}") if kinds[f] == "string" else F.coalesce(f, f"_r_{f}")
    return alerts.join(right, "event_id", "left").withColumns({f: fill(f) for f in fields}).drop(*(f"_r_{f}" for f in fields))


def merge_missing(first: DataFrame, second: DataFrame, key: str = "event_id") -> DataFrame:
    """All of ``first`` and the rows of ``second`` whose key it lacks; rows without a key stay."""
    known = first.where(F.col(key).isNotNull()).select(key).distinct()
    return first.unionByName(second.join(known, key, "left_anti").select(first.columns))


def first_per_session(alerts: DataFrame) -> DataFrame:
    """A session alerts once: its earliest eligible row."""
    w = Window.partitionBy("insured_id", "session_id").orderBy(F.col("timestamp").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return alerts.where("alert_eligible").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicates_skipped(alerts: DataFrame) -> DataFrame:
    """Eligible rows of a session after its earliest one are not raised again: not eligible, and DUPLICATE_SKIPPED their reason."""
    w = Window.partitionBy("insured_id", "session_id", "alert_eligible").orderBy(F.col("timestamp").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    again = F.coalesce(F.col("alert_eligible"), F.lit(False)) & (F.row_number().over(w) > 1)
    out = alerts.withColumn("_again", again)
    return out.withColumns({
        "alert_reason": F.when(F.col("_again"), "DUPLICATE_SKIPPED").otherwise(F.col("alert_reason")), "alert_eligible": F.col("alert_eligible") & ~F.col("_again"),
    }).drop("_again")


def new_rows(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored yet: the idempotent insert. Repeated rows go in once."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upsert_latest(stored: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The stored table with each key's latest row of both."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest_by(both, keys, order, "_new").drop("_new")


def alert_view(anomalies: DataFrame) -> DataFrame:
    """Anomaly rows as alerts: each field from the first of its sources that holds a value.

    Sources: columns of the row, then its ``event_json``, then the event metadata of its ``payload`` and of its ``llm_payload``, of which the
    latter only help a row whose event has no action. Columns that the table lacks count as null.
    """
    from ..functions.text import first_text, json_text

    have = set(anomalies.columns)
    of = lambda c, kind="string": (F.col(c) if c in have else F.lit(None)).cast(kind)
    number = lambda *c: F.coalesce(*(of(x, "double") for x in c))
    j = lambda payload, *names: json_text(of(payload), *(f"$.{n}" for n in names))
    own_action = j("event_json", "eventAction", "action")

    def event(*names: str) -> Column:
        meta = [j(p, *(f"eventMetadata.{n}" for n in names)) for p in ("payload", "llm_payload")]
        return F.coalesce(j("event_json", *names), *(F.when(own_action.isNull(), m) for m in meta))

    codes = F.coalesce(F.from_json(of("triggered_rules_json"), "array<string>"), F.when(first_text(of("triggered_rules_json")).isNull() & (F.trim(of("rule_type")) != ""), F.array(of("rule_type"))))
    return anomalies.select(
        "event_id", "insured_id", "session_id", F.coalesce(of("event_time", "timestamp"), F.col("detected_at")).alias("timestamp"), F.col("detected_at").alias("created_at"),
        first_text(of("risk_level"), of("anomaly_tier")).alias("risk_level"), number("final_risk_score", "risk_score", "anomaly_score").alias("final_risk_score"), first_text(of("anomaly_type")).alias("anomaly_type"),
        number("anomaly_type_confidence", "type_confidence").alias("anomaly_type_confidence"), F.coalesce(codes, F.array().cast("array<string>")).alias("triggered_rule_codes"),
        event("eventAction", "action").alias("event_action"), event("apiTemplate", "route").alias("api_template"), event("country", "countryCode").alias("country"),
        event("httpMethod", "method").alias("http_method"), event("apiFamily").alias("api_family"), *(event(n).alias(n) for n in ("controller", "page", "device", "browser", "os", "status")),
        first_text(of("persona_label"), F.lit("persona_disabled")).alias("persona_label"), F.coalesce(F.trim(of("llm_payload")) != "", F.lit(False)).alias("llm_evidence_available"), F.lit("OPEN").alias("alert_status"),
    )
