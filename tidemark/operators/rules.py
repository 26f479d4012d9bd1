"""Deterministic session rules: codes, points, context and boosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import RuleParams
from ..functions.text import is_one_of
from .sessions import SESSION, in_session

# Rule names and their codes; other names become upper case.
CODES = {
    "unusual_hour": "OFF_HOURS_ACCESS", "repeated_fail": "STATUS_CODE_BURST", "rapid_fire": "RAPID_FIRE_EVENTS", "geo_jump": "COUNTRY_SWITCH",
    "country_switch": "COUNTRY_SWITCH", "device_switch": "DEVICE_SWITCH", "download_spike": "LARGE_DOWNLOAD", "api_scraping": "API_SCRAPING_PATTERN",
    "skip_login": "SKIP_LOGIN", "session_timeout": "SESSION_TIMEOUT", "data_exfiltration": "DATA_EXTRACTION_PATTERN",
}
# Points of a code; others have 10.
POINTS = {
    "OFF_HOURS_ACCESS": 25.0, "SENSITIVE_API_OFF_HOURS": 25.0, "STATUS_CODE_BURST": 35.0, "UNUSUAL_DEVICE": 35.0, "DEVICE_SWITCH": 35.0,
    "API_SCRAPING_PATTERN": 35.0, "COUNTRY_SWITCH": 40.0, "UNUSUAL_COUNTRY": 40.0, "LARGE_DOWNLOAD": 40.0, "DATA_EXTRACTION_PATTERN": 40.0,
    "RAPID_FIRE_EVENTS": 30.0, "SKIP_LOGIN": 30.0, "IMPOSSIBLE_ENDPOINT_TRANSITION": 30.0, "SESSION_TIMEOUT": 20.0,
    "SENSITIVE_API_OUTSIDE_BUSINESS_CONTEXT": 30.0,
}
# What the summary adds where the rules have not: code, points, column, least value.
EXTRAS = [
    ("DEVICE_SWITCH", 25.0, "device_changed", 1), ("COUNTRY_SWITCH", 25.0, "ip_changed", 1), ("STATUS_CODE_BURST", 20.0, "total_kos", 3),
    ("LARGE_DOWNLOAD", 30.0, "max_downloads_in_2_minutes", 10), ("API_SCRAPING_PATTERN", 20.0, "ping_pong_count", 2),
]
DEFAULT_POINTS = 10.0


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def flag_rows(enriched: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """Enriched events with what the rules look at; the partitioning and order of ``enrich`` serve."""
    w = in_session()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    us = F.unix_micros("created_at")
    whole_seconds = lambda n: F.floor(F.abs(us - F.unix_micros(F.lag("created_at", n).over(w))) / 1_000_000)
    fails = F.coalesce((F.upper("status") == "KO") & F.upper("type").isin(*(t.upper() for t in p.fail_types)), F.lit(False))
    first_country = F.first(F.when(F.trim("country_code") != "", F.lower("country_code")), ignorenulls=True).over(whole)
    return enriched.withColumns({
        "_fail": fails, "_span": whole_seconds(p.rapid_events - 1), "_pause": whole_seconds(1),
        "_jump": F.coalesce((F.trim("country_code") != "") & (F.lower("country_code") != first_country), F.lit(False)),
    }).withColumn("_ok_at", F.coalesce(F.max(F.when(~F.col("_fail"), F.col("number_in_session"))).over(upto), F.lit(0)))


def flag_aggregates(p: RuleParams = RuleParams()) -> list[Column]:
    """A boolean for each rule, over the ``flag_rows`` of a session."""
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    low, high = p.unusual_hours
    n = F.col("number_in_session")
    skips = (n == 1) & F.col("action").isNotNull() & ~is_one_of(F.col("action"), p.allowed_first_actions)
    return [
        any_(F.hour("created_at").between(low, high)).alias("unusual_hour"),
        any_(skips).alias("skip_login"),
        any_(F.col("_fail") & (n - F.col("_ok_at") >= p.fail_run)).alias("repeated_fail"),
        any_(F.col("_span") <= p.rapid_window_seconds).alias("rapid_fire"),
        any_(F.col("_jump")).alias("geo_jump"),
        any_(F.col("is_device_changed") == 1).alias("device_switch"),
        any_(F.col("downloads_last_2_minutes") >= p.download_spike).alias("download_spike"),
        any_(F.col("ping_pong_count") >= p.scraping_ping_pongs).alias("api_scraping"),
        any_(F.col("_pause") > p.timeout_seconds).alias("session_timeout"),
    ]


def rule_flags(enriched: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """One row a session with a boolean for each rule."""
    return flag_rows(enriched, p).groupBy(*SESSION).agg(*flag_aggregates(p))


RULES = ["unusual_hour", "skip_login", "repeated_fail", "rapid_fire", "geo_jump", "device_switch", "download_spike", "api_scraping", "session_timeout"]


def triggered_rules() -> Column:
    """The names of a session's rules, in their fixed order."""
    return F.array_compact(F.array(*(F.when(F.col(r), r) for r in RULES))).alias("triggered_rules")


def triggered(flags: DataFrame) -> DataFrame:
    return flags.select(*SESSION, triggered_rules())


def canonical(rule: Column) -> Column:
    return F.when(F.coalesce(F.trim(rule), F.lit("")) == "", "UNKNOWN_RULE").otherwise(F.coalesce(_lookup(CODES, F.lower(rule)), F.upper(rule)))


def points_of(code: Column) -> Column:
    return F.coalesce(_lookup(POINTS, code), F.lit(DEFAULT_POINTS))


def score_rules(summaries: DataFrame, rules: Column | str = "triggered_rules", business_hours: Column | None = None) -> DataFrame:
    """Adds ``rule_codes``, ``rule_score``, ``business_context_score`` and ``aggregation_boost`` to session summaries.

    Every triggered rule counts its points, repeated ones each time; the summary's extras follow where their code
    is not there yet. ``business_hours``: of the session's last event, 0 adds to the context.
    """
    codes = F.transform(F.coalesce(F.col(rules) if isinstance(rules, str) else rules, F.array().cast("array<string>")), canonical)
    base = summaries.withColumn("_codes", codes)
    adds = [(code, pts, (F.coalesce(F.col(c), F.lit(0)) >= least) & ~F.array_contains("_codes", code)) for code, pts, c, least in EXTRAS]
    own = F.aggregate("_codes", F.lit(0.0), lambda a, c: a + points_of(c))
    total = reduce(lambda a, x: a + F.when(x[2], x[1]).otherwise(0.0), adds, own)
    extra = F.array_compact(F.array(*(F.when(test, code) for code, _, test in adds)))
    out = base.withColumns({"rule_score": F.least(F.lit(100.0), total), "rule_codes": F.array_distinct(F.concat("_codes", extra))}).drop("_codes")
    has = lambda c: F.array_contains("rule_codes", c)
    off = F.lit(False) if business_hours is None else F.coalesce(business_hours == 0, F.lit(False))
    sensitive = has("SENSITIVE_API_OUTSIDE_BUSINESS_CONTEXT")
    context = F.when(off, 10.0).otherwise(0.0) + F.when(sensitive, 15.0).otherwise(0.0) + F.when(F.col("ended_abruptly") == 1, 5.0).otherwise(0.0)
    boost = (
        F.when(F.size("rule_codes") >= 3, 5.0).otherwise(0.0)
        + F.when(has("STATUS_CODE_BURST") & has("RAPID_FIRE_EVENTS"), 3.0).otherwise(0.0)
        + F.when((F.col("max_downloads_in_2_minutes") >= 10) & sensitive, 5.0).otherwise(0.0)
    )
    return out.withColumns({"business_context_score": F.least(F.lit(30.0), context), "aggregation_boost": F.least(F.lit(10.0), boost)})
