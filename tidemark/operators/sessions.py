"""Sessions and what each event of one knows of those before it.

All features of ``enrich`` share one partitioning and one order, so Spark shuffles and sorts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.params import FeatureParams, SessionParams
from ..functions.text import comparison_key, has_download_word, is_one_of

SESSION = ["insured_id", "session_id"]
# Types that add to an event's risk.
_RISKY_TYPES = ("geo_jump", "data_exfiltration", "impossible_device_switch", "distributed_brute_force", "zombie_session")


def event_order() -> list[Column]:
    """Sequence number, time, id; nulls last."""
    return [F.col(c).asc_nulls_last() for c in ("sequence_in_session", "created_at", "id")]


def in_session() -> WindowSpec:
    return Window.partitionBy(*SESSION).orderBy(*event_order())


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows by key in ``tasks`` partitions, or as they are.

    Left to itself, a shuffle is merged down to one partition a core or 64 MB of packed rows, and the memory of a task grows with the table.
    """
    return df.repartition(tasks, *keys) if tasks else df


def assign_sessions(events: DataFrame, gap_seconds: int = SessionParams.gap_seconds) -> DataFrame:
    """Adds ``session_id``: a new one for each user after a pause of ``gap_seconds`` or more.

    Events without a time go to the user's last session.
    """
    w = Window.partitionBy("insured_id").orderBy(F.col("created_at").asc_nulls_last(), F.col("id").asc_nulls_last())
    pause = F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(w))
    opens = F.when(pause >= gap_seconds * 1_000_000, 1).otherwise(0)
    number = F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        events.withColumn("_opens", opens).withColumn("_n", number)
        .withColumn("session_id", F.concat(F.col("insured_id").cast("string"), F.lit("-"), F.col("_n").cast("string"))).drop("_opens", "_n")
    )


def cut_long_sessions(events: DataFrame, max_seconds: int = SessionParams.max_duration_seconds) -> DataFrame:
    """Adds ``part``: a session's part ends before the first event ``max_seconds`` or more after the part's start.

    Each part starts anew, so a session is walked in order of time: sorted within partitions, one batch after another, from each
    part's start straight to its end. Only the last start is carried on, no session is ever gathered. Events without a time have no part.
    """
    rows = events.withColumn("_us", F.unix_micros("created_at")).repartition(*SESSION).sortWithinPartitions(*SESSION, "_us")
    limit = max_seconds * 1_000_000

    def run(batches):
        key, start, part = None, 0, -1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in SESSION)))
            us = batch.column("_us").to_numpy(zero_copy_only=False).astype(float)
            turns = [k for k in range(n) if k == 0 or keys[k] != keys[k - 1]] + [n]
            parts = np.full(n, -1, dtype=np.int64)
            for a, b in zip(turns[:-1], turns[1:]):
                if keys[a] != key:
                    key, part = keys[a], -1
                at = a + int(np.isnan(us[a:b]).sum())  # nulls are first
                while at < b:
                    if part < 0 or us[at] - start >= limit:
                        start, part = us[at], part + 1
                    end = at + int(np.searchsorted(us[at:b], start + limit))
                    parts[at:end] = part
                    at = end
            kept = [c for c in batch.schema.names if c != "_us"]
            column = pa.array(parts.astype(np.int32), pa.int32(), mask=parts < 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], names=[*kept, "part"])

    own = events.drop("part")
    return rows.select(*own.columns, "_us").mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("part", T.IntegerType())]))


def enrich(events: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Each event with the features of its session up to it.

    Null times give hour and day 0, no pause and no downloads; blank addresses and devices never count as
    changed and are not counted as distinct, of which there is at least one.
    """
    w = in_session()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    us = F.unix_micros("created_at")
    ko = F.coalesce(F.upper("status") == "KO", F.lit(False))
    action = F.coalesce("action", F.lit(""))
    download = F.coalesce(F.col("is_download_action"), F.lit(0)) if not p.download_words else has_download_word(F.col("action"), p.download_words).cast("int")

    def seconds(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.floor((a - b) / 1_000_000))

    def changed(c: str) -> Column:
        first = F.first(F.col(c)).over(whole)
        return F.coalesce(((F.trim(c) != "") & (F.trim(first) != "") & (F.col(c) != first)).cast("int"), F.lit(0))

    def distinct(c: str) -> Column:
        return F.greatest(F.lit(1), F.size(F.collect_set(F.when(F.trim(c) != "", F.col(c))).over(upto)))

    def trailing(n: str) -> Column:
        """Sum of ``n`` over earlier rows and this one whose age is at most the window's whole seconds."""
        by_time = Window.partitionBy(*SESSION).orderBy("_us")
        recent = F.sum(n).over(by_time.rangeBetween(-(p.download_window_seconds + 1) * 1_000_000 + 1, 0))
        # a range holds later rows of the same time as well
        later = F.sum(n).over(by_time.rangeBetween(Window.unboundedPreceding, 0)) - F.sum(n).over(by_time_then_id)
        return F.when(F.col("_us").isNotNull(), recent - later).otherwise(0)

    by_time_then_id = Window.partitionBy(*SESSION).orderBy(*event_order()).rowsBetween(Window.unboundedPreceding, 0)
    base = events.withColumns({"_us": us, "_ko": ko, "_key": comparison_key(action), "is_download_action": download})
    first_pass = base.withColumns({
        "number_in_session": F.row_number().over(w),
        "prev_action": F.coalesce(F.lag("action").over(w), F.lit("")),
        "next_action": F.coalesce(F.lead("action").over(w), F.lit("")),
        "session_duration_seconds": F.coalesce(seconds(F.last("_us").over(whole), F.first("_us").over(whole)), F.lit(0)),
        "time_delta_since_last_action": F.coalesce(seconds(F.col("_us"), F.lag("_us").over(w)), F.lit(0)),
        "hour_of_day": F.coalesce(F.hour("created_at"), F.lit(0)),
        "day_of_week": F.coalesce(F.weekday("created_at"), F.lit(0)),
        "is_ip_changed": changed("ip"),
        "is_device_changed": changed("device"),
        "unique_ips_in_session": distinct("ip"),
        "unique_devices_in_session": distinct("device"),
        "cumulative_kos": F.sum(F.col("_ko").cast("int")).over(upto).cast("int"),
        "has_logged_in": F.coalesce(F.max(F.col("action").isin(*p.login_actions).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "download_actions_in_session": F.sum("is_download_action").over(upto).cast("int"),
        "_pong": ((F.col("_key") == F.lag("_key", 2).over(w)) & (F.col("_key") != F.lag("_key", 1).over(w))).cast("int"),
    })
    second = first_pass.withColumns({
        "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
        "downloads_last_2_minutes": trailing("is_download_action").cast("int"),
        "ping_pong_count": F.coalesce(F.sum("_pong").over(upto), F.lit(0)).cast("int"),
        "_last_ok": F.coalesce(F.max(F.when(~F.col("_ko"), F.col("number_in_session"))).over(upto), F.lit(0)),
    })
    run = F.when(F.col("_ko"), F.col("number_in_session") - F.col("_last_ok")).otherwise(0)
    third = second.withColumn("longest_ko_streak", F.max(run).over(upto).cast("int"))
    return third.withColumn("session_risk_score", event_risk(p)).drop("_us", "_ko", "_key", "_pong", "_last_ok")


def event_risk(p: FeatureParams = FeatureParams()) -> Column:
    """Points of one enriched event, 100 at most."""
    c, kind = F.col, F.coalesce("anomaly_type", F.lit(""))
    # What adds how many points.
    points = [
        (c("is_ip_changed") == 1, 30), (F.coalesce(F.upper("status") == "KO", F.lit(False)), 10), (c("is_device_changed") == 1, 25),
        (c("hour_of_day").between(2, 4), 15), (c("time_delta_since_last_action").between(1, p.rapid_action_seconds), 15),
        (c("cumulative_kos") >= 3, 15), (c("downloads_last_2_minutes") >= 10, 20), (c("ping_pong_count") >= 2, 15),
        (kind.isin(*_RISKY_TYPES), 10), ((F.lower(kind) == "skip_login") & (c("has_logged_in") == 0), 15),
    ]
    total = F.lit(0)
    for test, n in points:
        total = total + F.when(test, n).otherwise(0)
    return F.least(F.lit(100), total).cast("double")


def explicit_ends(events: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Adds ``ends_session`` and ``end_reason`` of events that close their session themselves."""
    from ..functions.text import first_text

    label = first_text("action_value", "action", "frontend_action_name") if "action_value" in events.columns else F.col("action")
    ends = is_one_of(label, p.end_actions)
    reason = F.when(ends, F.when(F.contains(comparison_key(label), F.lit("sso disconnect")), "explicit_sso_disconnect").otherwise("explicit_logout"))
    return events.withColumns({"ends_session": F.coalesce(ends, F.lit(False)), "end_reason": reason})
