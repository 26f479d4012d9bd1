"""Audit events: their schema, readers for JSON, CSV and Kafka, aliases, and an adapter for generated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_text, normalize_label

_TEXT = (
    "id insured_id session_id status action action_value frontend_action_name action_type action_subtype http_method action_api "
    "api_template api_family controller page route browser os device country_code ip_country ip_region city month persona "
    "environment_id campaign_id ip user_agent anomaly_type created_at"
).split()
_INTS = (
    "session_number sequence_in_session session_action_seq http_code hour day_of_week is_weekend is_business_hours is_anomaly is_download_action"
).split()
_LONGS = "time_since_prev_action_ms session_duration_so_far_ms request_data_size_bytes response_data_size_bytes".split()

#: What a JSON or CSV record may hold. ``created_at`` is parsed afterwards.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT] + [T.StructField(n, T.IntegerType()) for n in _INTS] + [T.StructField(n, T.LongType()) for n in _LONGS]
)
# Other names that records use for a field.
ALIASES = {
    "id": ("record_id",),
    "insured_id": ("insuredId",),
    "session_id": ("sessionId",),
    "created_at": ("createdAt", "timestamp"),
    "action_value": ("actionValue",),
    "frontend_action_name": ("frontendActionName",),
    "action_type": ("type", "actionType"),
    "action_subtype": ("sub_type", "actionSubtype"),
    "http_method": ("httpMethod",),
    "api_template": ("apiTemplate",),
    "api_family": ("apiFamily",),
    "country_code": ("countryCode",),
    "ip_country": ("ipCountry",),
    "sequence_in_session": ("sequenceInSession",),
    "session_action_seq": ("sessionActionSeq",),
    "anomaly_type": ("anomalyType",),
    "is_anomaly": ("isAnomaly",),
}
_FLAT = {t.name: t.dataType for t in RECORD} | {a: RECORD[n].dataType for n, own in ALIASES.items() for a in own}
_WIDE = T.StructType([T.StructField(n, t) for n, t in _FLAT.items()] + [T.StructField("_corrupt", T.StringType())])


def resolve_aliases(df: DataFrame) -> DataFrame:
    """One column for each field, from whichever of its names holds a value; missing fields are null."""
    have = set(df.columns)
    out = []
    for f in RECORD:
        names = [n for n in (f.name, *ALIASES.get(f.name, ())) if n in have]
        out.append((F.coalesce(*(F.col(n) for n in names)) if names else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*out, *(c for c in df.columns if c.startswith("_")))


def typed(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.try_to_timestamp("created_at"))


def parse_json(records: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Events of JSON records, and the dead letters with their reason.

    Null and blank values are skipped; text that is no JSON is a dead letter ``invalid_json``; events
    without an insured or a session id are dropped, as upstream cannot place them. Other columns (topic,
    partition, offset, key) go with the dead letters.
    """
    rest = [c for c in records.columns if c != value]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    text = records.where(F.trim(F.col(value).cast("string")) != "").withColumn("_text", F.col(value).cast("string"))
    parsed = text.withColumn("_event", F.from_json("_text", _WIDE, options))
    dead = parsed.where("_event._corrupt is not null").select(*rest, F.lit("invalid_json").alias("reason"), F.col("_text").alias("value"))
    good = resolve_aliases(parsed.where("_event._corrupt is null").select("_event.*").drop("_corrupt"))
    return typed(good.where("trim(insured_id) <> '' and trim(session_id) <> ''")), dead


def read_csv(spark: SparkSession, path: str, sessions: str | None = None) -> DataFrame:
    """Events of CSV files; fields that an event lacks are filled from its row of the session files."""
    events = typed(resolve_aliases(spark.read.csv(path, header=True)))
    if not sessions:
        return events
    more = resolve_aliases(spark.read.csv(sessions, header=True)).where("session_id is not null").dropDuplicates(["session_id"])
    return fill_from(events, typed(more), ["session_id"])


def fill_from(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that fills nulls and never overwrites; ``right`` has one row a key."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    r = right.select(*on, *(F.col(c).alias(f"_r_{c}") for c in shared))
    return left.join(r, on, "left").select(*(F.coalesce(c, f"_r_{c}").alias(c) if c in shared else F.col(c) for c in left.columns))


def read_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A stream of raw records; the checkpoint of its query stands in for acknowledgements."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("startingOffsets", "latest").options(**options).load()


def with_fallbacks(events: DataFrame) -> DataFrame:
    """Fields taken from their stand-ins where null or blank; labels repaired."""
    label = lambda *c: normalize_label(first_text(*c))
    return (
        events.withColumn("action", label("action", "action_value", "frontend_action_name"))
        .withColumn("route", first_text("route", "page", "api_template"))
        .withColumn("type", label("action_type"))
        .withColumn("sub_type", label("action_subtype"))
        .withColumn("country_code", first_text("country_code", "ip_country"))
        .withColumn("sequence_in_session", F.coalesce("sequence_in_session", "session_action_seq"))
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events made of the generated ``events`` table, by fixed rules of its columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")

    def pick(c: Column, values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(c, F.lit(len(values))) + 1).cast("int"))

    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("insured_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("action"), F.col("event_type").alias("type"),
        F.when(F.col("event_type") == "error", "KO").otherwise("OK").alias("status"),
        F.concat(F.lit("D"), F.pmod(k, F.lit(3)).cast("string")).alias("device"), F.concat(F.lit("10.0.0."), F.pmod(k, F.lit(7)).cast("string")).alias("ip"),
        pick(k, ["FR", "BE", "DE", "ES", "IT"]).alias("country_code"), F.concat(F.lit("/r"), F.pmod(k, F.lit(4)).cast("string")).alias("route"),
        (F.col("event_type") == "purchase").cast("int").alias("is_download_action"),
        F.when(F.pmod(k, F.lit(10)) == 0, "geo_jump").when(F.pmod(k, F.lit(10)) == 1, "skip_login").otherwise("normal").alias("anomaly_type"),
        (F.pmod(k, F.lit(10)) < 2).cast("int").alias("is_anomaly"), F.lit(None).cast("int").alias("sequence_in_session"),
        k.alias("k"), (F.col("value") * 1000).cast("long").alias("response_data_size_bytes"),
    )
