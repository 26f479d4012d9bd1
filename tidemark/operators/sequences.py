"""Transitions between actions, windows for sequence models, their encoding and what predictions are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import softmax, surprise
from ..functions.text import normalize_label
from .sessions import SESSION, event_order, in_session


def transitions(events: DataFrame) -> DataFrame:
    """``from_action, to_action, n, probability`` over all sessions."""
    pairs = events.select(F.col("action").alias("from_action"), F.lead("action").over(in_session()).alias("to_action")).where("to_action is not null and from_action is not null")
    counts = pairs.groupBy("from_action", "to_action").agg(F.count("*").alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("from_action")))


def score_transitions(events: DataFrame, known: DataFrame) -> DataFrame:
    """Each event's step from the one before with its probability; unknown steps have 0. First events have none."""
    steps = events.withColumn("prev", F.lag("action").over(in_session())).where("prev is not null")
    table = known.select(F.col("from_action").alias("prev"), F.col("to_action").alias("action"), "probability")
    return steps.join(F.broadcast(table) if _few_actions(known) else table, ["prev", "action"], "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))


def _few_actions(known: DataFrame, most: int = 200_000) -> bool:
    """A step table is broadcast only while it is small."""
    return known.limit(most + 1).count() <= most


def path_flags(scored: DataFrame, impossible: float = 0.005, rare: float = 0.02) -> DataFrame:
    return scored.groupBy(*SESSION).agg(
        F.max(F.col("probability") < impossible).alias("impossible_seq"), F.max(F.col("probability") < rare).alias("path_deviation"),
        F.count_if(F.col("probability") < rare).alias("rare_steps"),
    )


def rare_paths(known: DataFrame, below: float = 0.02) -> DataFrame:
    return known.where(F.col("probability") < below).select("from_action", "to_action", "n", "probability")


def next_hits(scored: DataFrame, known: DataFrame) -> DataFrame:
    """How often the true next action is the likeliest one, or among the three likeliest (then the more frequent, then by name)."""
    w = Window.partitionBy("from_action").orderBy(F.desc("probability"), F.desc("n"), "to_action")
    ranked = known.select(F.col("from_action").alias("prev"), F.col("to_action").alias("action"), F.row_number().over(w).alias("rank"))
    return scored.join(ranked, ["prev", "action"], "left").agg(
        F.count("*").alias("steps"), F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.when(F.col("rank") <= 3, 1.0).otherwise(0.0)).alias("top3")
    )


def dropoff_actions(summaries: DataFrame) -> DataFrame:
    """Last actions of sessions that ended abruptly."""
    return summaries.where("ended_abruptly = 1").groupBy("last_action").agg(F.count("*").alias("n"))


# Spellings of each outcome; a vocabulary is asked for the outcome's own name.
STATUS_SYNONYMS = {"OK": ("SUCCESS", "SUCCEEDED", "200"), "KO": ("FAILURE", "FAILED", "ERROR")}


def time_since_previous(df: DataFrame, supplied: str | None = None, differs: int = 1_000) -> DataFrame:
    """Adds ``ms_since_previous`` within a session, 0 for its first event, never negative; where a time is missing, the ``supplied``
    milliseconds. ``ms_mismatch`` marks supplied values further than ``differs`` from the computed ones."""
    now, before = F.unix_millis("created_at"), F.unix_millis(F.lag("created_at").over(in_session()))
    first = F.row_number().over(in_session()) == 1
    computed = F.when(first, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), now - before))
    given = F.col(supplied).cast("long") if supplied else F.lit(None).cast("long")
    out = df.withColumn("_ms", F.when(first | (now.isNotNull() & before.isNotNull()), computed))
    return out.withColumns({
        "ms_since_previous": F.coalesce("_ms", F.greatest(F.lit(0).cast("long"), given), F.lit(0).cast("long")),
        "ms_mismatch": F.coalesce(F.abs(given - F.col("_ms")) > differs, F.lit(False)),
    }).drop("_ms")


def top_surprises(contributions: Column, n: int = 5) -> Column:
    """The ``n`` fields of a map of contributions that add most, highest first; of equals the first in the alphabet."""
    ranked = F.array_sort(F.transform(F.map_entries(contributions), lambda e: F.struct((-e.value).alias("c"), e.key.alias("field"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x.field)


def of_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The events of the given sessions: a training or test set by whole sessions."""
    return events.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def numbered(df: DataFrame) -> DataFrame:
    """Adds each event's ``number`` in its session, from 1, and the session's ``length``."""
    return df.withColumns({"number": F.row_number().over(in_session()), "length": F.count("*").over(Window.partitionBy(*SESSION))})


def encode(df: DataFrame, vocabularies: dict[str, list[str]]) -> DataFrame:
    """Adds ``<field>_id``: a value's place in its vocabulary from 1, as it is, repaired and trimmed, lower or upper case; 0 where unknown.

    Spellings of an outcome in ``status`` stand for OK and KO, in either case, where the vocabulary has those; never the other way round.
    """
    out = {}
    for f, words in vocabularies.items():
        table = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, i + 1)])
        c = F.col(f).cast("string")
        label = F.coalesce(F.trim(normalize_label(c)), F.lit(""))
        tries = [F.try_element_at(table, t) for t in (c, label, F.lower(label), F.upper(label))]
        if f == "status":
            tries += [F.when(F.upper(label).isin(*same), F.try_element_at(table, F.lit(x))) for name, same in STATUS_SYNONYMS.items() for x in (name, name.lower())]
        out[f"{f}_id"] = F.coalesce(*tries, F.lit(0))
    return df.withColumns(out)


def window_features(df: DataFrame, continuous: list[str], categorical: dict[str, int], length: int = 10) -> DataFrame:
    """Mean, last value and deviation of each number, and of each code its last one and the share of codes seen,
    over the ``length`` events before an event and the event itself. ``categorical``: id column and size of its vocabulary."""
    w = Window.partitionBy(*SESSION).orderBy(F.col("created_at").asc_nulls_last(), F.col("id").asc_nulls_last()).rowsBetween(-length, 0)
    out: dict[str, Column] = {"window_length_ratio": F.least(F.lit(1.0), F.count("*").over(w) / length)}
    for c in continuous:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        out |= {f"{c}_mean": F.avg(x).over(w), f"{c}_last": x, f"{c}_std": F.stddev_pop(x).over(w)}
    for c, size in categorical.items():
        seen = F.size(F.collect_set(F.when(F.col(c) > 0, F.col(c))).over(w))
        out |= {f"{c}_last": F.col(c) / size, f"{c}_distinct": seen / size}
    return df.withColumns(out)


def padded_window(df: DataFrame, fields: list[str], length: int = 10) -> DataFrame:
    """Adds ``window``: the fields of the ``length`` events before each event, zeros to their left, and ``mask``: which places are events."""
    w = Window.partitionBy(*SESSION).orderBy(F.col("created_at").asc_nulls_last(), F.col("id").asc_nulls_last()).rowsBetween(-length, -1)
    rows = F.collect_list(F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in fields))).over(w)
    n = F.size("_rows")
    zeros = F.array(*(F.lit(0.0) for _ in fields))
    return df.withColumn("_rows", rows).withColumns({
        "window": F.concat(F.array_repeat(zeros, length - n), "_rows"), "mask": F.concat(F.array_repeat(F.lit(False), length - n), F.array_repeat(F.lit(True), n)),
    }).drop("_rows")


def top_predictions(df: DataFrame, logits: str, names: list[str], k: int = 3) -> DataFrame:
    """Adds ``predictions``: rank, value and probability of the ``k`` likeliest values; of equals the earlier one."""
    table = F.array(*map(F.lit, names))
    p = softmax(F.col(logits))
    each = F.transform(p, lambda x, i: F.struct((-x).alias("key"), i.alias("i"), x.alias("probability")))
    best = F.slice(F.array_sort(each), 1, k)
    named = F.transform(best, lambda x, r: F.struct(
        (r + 1).alias("rank"), F.coalesce(F.get(table, x.i), F.concat(F.lit("UNK_"), x.i.cast("string"))).alias("value"), x.probability.alias("probability")))
    return df.withColumn("predictions", named)


def deviation(predictions: Column, actual: Column) -> Column:
    """1 - p of the actual value; unranked values have a tenth of the least ranked probability, 0.001 without any."""
    hit = F.filter(predictions, lambda x: x.value == actual)
    least = F.array_min(F.transform(predictions, lambda x: x.probability))
    return 1 - F.coalesce(F.get(hit, F.lit(0))["probability"], least * 0.1, F.lit(0.001))


def sequence_surprise(logits: dict[str, Column], targets: dict[str, Column], weights: dict[str, float], norms: dict[str, float], predicted: Column, actual: Column, first: int = 3, rest_weight: float = 0.3) -> Column:
    """Weighted surprise over known targets, plus the mean error of the first numbers and a share of that of the others."""
    total = F.lit(0.0)
    for f, x in logits.items():
        total = total + F.coalesce(surprise(x, targets[f]) * weights.get(f, 1.0) * norms.get(f, 1.0), F.lit(0.0))
    errors = F.zip_with(predicted, actual, lambda a, b: F.abs(a - b))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)
    return total + mean(F.slice(errors, 1, first)) + rest_weight * mean(F.slice(errors, first + 1, F.greatest(F.size(errors), F.lit(1))))


def previous_prediction(df: DataFrame, column: str) -> Column:
    """The prediction that stood when the event came: that of the event before in its session."""
    return F.lag(column).over(Window.partitionBy(*SESSION).orderBy(*event_order()))


def predictions_as_of(events: DataFrame, predictions: DataFrame, on: str = "session_id") -> DataFrame:
    """``events`` with ``predicted_at``, ``predicted_for`` and ``prediction``: the latest prediction of another event that stood when each came.

    ``predictions``: ``on``, context_event_id, created_at, prediction. A prediction of the time of an event itself counts; of
    several at one time the one with the greatest context event is the latest. One that an event's own context gave is passed
    over for the latest of another event. Without one, and for events without a time or key, all three
    are null. Both sides meet in one shuffle by ``on``, in which the last prediction is carried on in order of time.
    """
    kind = events.schema["id"].dataType
    made = predictions.where(F.col(on).isNotNull() & F.col("created_at").isNotNull()).select(
        F.col(on).alias("_on"), F.col("created_at").alias("_at"), F.lit(0).alias("_side"), F.col("context_event_id").cast(kind).alias("_id"),
        F.struct(F.col("created_at").alias("at"), F.col("context_event_id").cast(kind).alias("event"), F.col("prediction").alias("prediction")).alias("_p"),
    )
    came = events.select(F.col(on).alias("_on"), F.col("created_at").alias("_at"), F.lit(1).alias("_side"), F.col("id").alias("_id"), F.struct("*").alias("_event"))
    w = Window.partitionBy("_on").orderBy(F.col("_at").asc_nulls_first(), "_side", F.col("_id").asc_nulls_first())
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = made.unionByName(came, allowMissingColumns=True).withColumn("_before", F.last("_p", ignorenulls=True).over(past))
    # the latest prediction of another context than the last one changes only where the context does
    turned = F.col("_p").isNotNull() & F.col("_before").isNotNull() & ~F.col("_p.event").eqNullSafe(F.col("_before.event"))
    rows = rows.withColumn("_other", F.last(F.when(turned, F.col("_before")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    timed = F.col("_on").isNotNull() & F.col("_at").isNotNull()
    found = F.when(timed, F.when(F.col("_before.event").eqNullSafe(F.col("_id")), F.col("_other")).otherwise(F.col("_before")))
    out = rows.where("_event is not null").select("_event", found.alias("_f"))
    return out.select("_event.*", F.col("_f.at").alias("predicted_at"), F.col("_f.event").alias("predicted_for"), F.col("_f.prediction").alias("prediction"))


def head_deviations(heads: Column, actual: dict[str, Column]) -> Column:
    """How far what came is from a prediction of several heads: ``matched`` and ``probability`` by field, and ``score``.

    ``heads``: a map of field to the ranked values, structs of value and probability. A field counts where its value is
    known and its head ranked any. What a head did not rank has a tenth of its least probability, 0.001 where
    that is 0. ``score`` is the mean of 1 - p, 1 where nothing counts; null without a prediction.
    """
    own = F.array(*(F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in actual.items()))
    asked = F.filter(own, lambda a: a.value.isNotNull() & F.coalesce(F.size(F.try_element_at(heads, a.field)) > 0, F.lit(False)))

    def judged(a: Column) -> Column:
        ranked = F.try_element_at(heads, a.field)
        hit = F.get(F.filter(ranked, lambda x: x.value == a.value), F.lit(0))
        least = F.array_min(F.transform(ranked, lambda x: x.probability))
        p = F.when(hit.probability > 0, hit.probability).when(least > 0, least * 0.1).otherwise(0.001)
        return F.struct(a.field.alias("field"), hit.isNotNull().alias("matched"), p.alias("probability"))

    each = F.transform(asked, judged)
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + 1 - x.probability, lambda s: F.when(F.size(each) > 0, s / F.size(each)).otherwise(1.0))
    by_field = lambda name: F.map_from_entries(F.transform(each, lambda x: F.struct(x.field, x[name])))
    return F.when(heads.isNotNull(), F.struct(by_field("matched").alias("matched"), by_field("probability").alias("probability"), mean.alias("score")))
