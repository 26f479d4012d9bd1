"""Alert lists as a reader sees them, and the detail of one alert: its event, its session, and a payload that speaks of no other event."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_text
from . import alerts as A
from .sessions import dealt

# Where a payload may name the event that it is about.
ID_PATHS = [
    f"$.{where}{name}"
    for where, names in {
        "": ("eventId", "recordId", "contextEventId", "evaluatedEventId"), "eventMetadata.": ("eventId", "recordId"),
        "data.": ("eventId", "recordId", "contextEventId", "evaluatedEventId"), "data.eventMetadata.": ("eventId", "recordId"),
    }.items() for name in names
]


def payload_is_about(payload: Column, event_id: Column) -> Column:
    """Whether a JSON payload names the event and no other one; null, broken and silent payloads are about nothing."""
    own = event_id.cast("string")
    named = F.array_compact(F.array(*(F.get_json_object(payload, path) for path in ID_PATHS)))
    return F.coalesce((F.size(named) > 0) & F.forall(named, lambda x: x == own), F.lit(False))


def by_ids(alerts: DataFrame, ids: DataFrame | Iterable) -> DataFrame:
    """Alerts of the given events: a table of ids, or a list that a caller typed."""
    if isinstance(ids, DataFrame):
        return alerts.join(ids.select("event_id").distinct(), "event_id", "left_semi")
    return alerts.where(F.col("event_id").isin(*ids))


def with_latest_session(anomalies: DataFrame, sessions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each anomaly with ``session``, a struct of the latest analysis of its session; null where there is none. ``tasks``: partitions of the join, if not Spark's own."""
    keys = ["insured_id", "session_id"]
    rest = [c for c in sessions.columns if c not in keys]
    latest = A.latest_by(dealt(sessions, tasks, *keys), keys, "created_at").select(*keys, F.struct(*rest).alias("session"))
    return dealt(anomalies, tasks, *keys).join(latest, keys, "left")


def alert_details(anomalies: DataFrame, sessions: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row for each event, of its latest anomaly: which payload it shows, from where, and what was held back.

    ``anomalies``: event_id, insured_id, session_id, detected_at, ``payload`` (JSON). ``sessions``: insured_id, session_id,
    created_at, ``payload``. The event's own payload comes first; without one, that of the latest analysis of its session. A payload is
    shown where it speaks of this event and names its own source or is an ``sql-payload``; one about another event is held back with
    the warning ``sql_payload_event_mismatch``. Where there is neither a payload nor a session, the warning is ``exact_event_payload_unavailable``.
    """
    rows = with_latest_session(A.latest_by(anomalies.where("event_id is not null"), ["event_id"], "detected_at"), sessions, tasks)
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    one = F.when(has(F.col("payload")), F.col("payload")).when(has(F.col("session.payload")), F.col("session.payload"))
    about = payload_is_about(F.col("_one"), F.col("event_id"))
    shown = F.when(about, F.col("_one"))
    warning = F.when(F.col("_one").isNotNull() & ~about, "sql_payload_event_mismatch").when(F.col("_one").isNull() & F.col("session").isNull(), "exact_event_payload_unavailable")
    source = F.when(about, json_text(F.col("_one"), "$.source")).when(~about, "sql")
    return rows.withColumn("_one", one).withColumns({"source": F.coalesce(source, F.lit("sql-payload")), "warning": warning, "shown_payload": shown}).drop("_one")


def evidence(anomaly: dict[str, str], scores: Iterable[str], sequence: dict[str, str] | None = None) -> Column:
    """The payload of an alert as JSON: event metadata, model, sequence and rule evidence, churn and persona.

    ``anomaly``: payload field of the event's metadata to column; ``scores``: columns of model scores; ``sequence``: payload field of the
    sequence evidence to column, ``available`` being true where the score or the selected model is known. Fields without a value are left out.
    """
    c = F.col
    known = [c(v).isNotNull() for k, v in (sequence or {}).items() if k in ("anomalyScore", "selectedModel")]
    steps = [F.struct(*(c(v).alias(k) for k, v in sequence.items()), reduce(or_, known, F.lit(False)).alias("available")).alias("sequenceEvidence")] if sequence else []
    return F.to_json(F.struct(*steps,
        c("event_id").cast("string").alias("eventId"),
        F.struct(c("event_id").cast("string").alias("eventId"), *(c(v).alias(k) for k, v in anomaly.items())).alias("eventMetadata"),
        F.struct(*(c(s).alias(s) for s in scores)).alias("tabularEvidence"),
        F.struct(c("rule_codes").alias("triggeredRules"), c("rule_score").alias("ruleScore")).alias("ruleEvidence"),
        F.struct(c("churn_probability").alias("probability"), c("churn_risk_level").alias("level")).alias("churn"),
        F.struct(c("cluster").alias("cluster")).alias("persona"),
    ))


def page_of(alerts: DataFrame, limit: int = A.USUAL_PAGE, offset: int = 0) -> DataFrame:
    """One page, newest first, with ``total``, the number of all alerts, and ``has_more``."""
    size = A.USUAL_PAGE if limit < 1 else min(limit, A.MOST_ON_A_PAGE)
    one = F.lit(1).alias("_one")
    total = alerts.agg(F.count("*").alias("total")).select(one, "total")  # one row
    rows = A.page(alerts, limit, offset).select("*", one)
    return rows.join(F.broadcast(total), "_one").drop("_one").withColumn("has_more", F.col("total") > max(0, offset) + size)


def first_filled(*tables: DataFrame) -> DataFrame:
    """The rows of the first table that has any: live ones, else a snapshot, else what is stored."""
    both = None
    for k, table in enumerate(tables):
        rows = table.select(tables[0].columns).withColumn("_tier", F.lit(k))
        both = rows if both is None else both.unionByName(rows)
    first = both.agg(F.min("_tier").alias("_tier"))  # one row
    return both.join(F.broadcast(first), "_tier", "left_semi").drop("_tier")


def live_list(live: DataFrame, stored: DataFrame, limit: int = A.USUAL_PAGE, offset: int = 0, events: DataFrame | None = None, fields: Iterable[str] = (), **conditions) -> DataFrame:
    """The list of alerts: live ones and the stored ones that live lacks, one row an event, hydrated, filtered leniently and paged.

    ``events``: rows (event_id, detected_at, ``fields``) that fill what an alert lacks before it is filtered.
    """
    rows = A.keep_richest(A.merge_missing(live, stored), "position")
    rows = rows if events is None else A.hydrate(rows, events, list(fields))
    return page_of(A.lenient_filter(rows, **conditions), limit, offset)


def top_of_both(live: DataFrame, stored: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of both tables, what is in both twice."""
    return live.unionByName(stored.select(live.columns)).orderBy(*(F.col(c).desc_nulls_last() for c in order)).limit(n)


def trimmed(cache: DataFrame, order: str, most: int = 5_000, keep: int = 2_500) -> DataFrame:
    """A cache of at most ``most`` rows as it is; a larger one down to its newest ``keep``. Only ``most`` + 1 rows are ever ranked."""
    newest = cache.orderBy(F.col(order).desc_nulls_last()).limit(most + 1)
    w = Window.partitionBy(F.lit(0))
    ranked = newest.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(F.col(order).desc_nulls_last()))})
    return ranked.where((F.col("_n") <= most) | (F.col("_r") <= keep)).drop("_n", "_r")


def buffered(events: DataFrame, *order: str) -> DataFrame:
    """A session's buffer: the first event of each id; events without one count as one."""
    w = Window.partitionBy("insured_id", "session_id", F.coalesce(F.col("id").cast("string"), F.lit(""))).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
