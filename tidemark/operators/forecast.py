"""Daily series, their lag and calendar features, and linear forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp

LAGS = (1, 2, 3, 7, 14)


def daily_series(events: DataFrame) -> DataFrame:
    """Events, anomalies and downloads of each day, days without any included as zeros."""
    days = events.where("created_at is not null").groupBy(F.to_date("created_at").alias("ds")).agg(
        F.count("*").alias("total_events"), F.count_if(F.col("is_anomaly") == 1).alias("anomaly_events"), F.count_if(F.col("is_download_action") == 1).alias("download_events")
    )
    spine = days.agg(F.min("ds").alias("a"), F.max("ds").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("ds"))
    return spine.join(days, "ds", "left").fillna(0, ["total_events", "anomaly_events", "download_events"])


def lag_features(days: DataFrame) -> DataFrame:
    """Lags, and mean and deviation of the seven days before, of events and anomaly rate; days before the first count as 0.

    The series has a row a day, some thousands after years of events, so one ordered window over it is small by nature.
    """
    w = Window.orderBy("ds")
    rate = F.when(F.col("total_events") > 0, F.col("anomaly_events") / F.col("total_events")).otherwise(0.0)
    out = days.withColumn("anomaly_rate", rate)
    before = w.rowsBetween(-7, -1)
    new: dict[str, Column] = {}
    for c in ("total_events", "anomaly_rate"):
        x = F.col(c).cast("double")
        new |= {f"{c}_lag_{n}": F.coalesce(F.lag(x, n).over(w), F.lit(0.0)) for n in LAGS}
        mean = F.coalesce(F.sum(x).over(before), F.lit(0.0)) / 7
        square = F.coalesce(F.sum(x * x).over(before), F.lit(0.0)) / 7
        new |= {f"{c}_roll_mean_7": mean, f"{c}_roll_std_7": F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))}
    return out.withColumns(new)


def calendar_features(days: DataFrame) -> DataFrame:
    """Weekday from Monday = 0, month, ISO week, and cycles of the year and the week."""
    year, week = 2 * math.pi * F.dayofyear("ds") / 365, 2 * math.pi * F.weekday("ds") / 7
    return days.withColumns({
        "dow": F.weekday("ds"), "month": F.month("ds"), "week": F.weekofyear("ds"), "day_sin": F.sin(year), "day_cos": F.cos(year),
        "dow_sin": F.sin(week), "dow_cos": F.cos(week), "is_weekend": (F.weekday("ds") >= 5).cast("int"),
    })


def ridge(model: dict) -> Column:
    """Prediction of a linear model artifact: ``feature_order``, ``coef``, ``intercept``, ``scaler`` with ``mean`` and ``scale``."""
    total = F.lit(float(model["intercept"]))
    scaler = model.get("scaler", {})
    for f, coef, mean, scale in zip(model["feature_order"], model["coef"], scaler["mean"], scaler["scale"]):
        total = total + coef * ((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - mean) / (scale or 1.0))
    return total


def forecast(features: DataFrame, rate_model: dict | None = None, events_model: Column | None = None) -> DataFrame:
    """Adds ``predicted_total_events``, ``predicted_anomaly_rate`` and ``expected_alerts``; without a model, the week-old value or else the week's mean."""
    usual = lambda c: F.when(F.col(f"{c}_lag_7") > 0, F.col(f"{c}_lag_7")).otherwise(F.col(f"{c}_roll_mean_7"))
    events = F.greatest(F.lit(0.0), events_model) if events_model is not None else usual("total_events")
    rate = clamp(ridge(rate_model), 0.0, 1.0) if rate_model else F.greatest(F.lit(0.0), usual("anomaly_rate"))
    out = features.withColumns({"predicted_total_events": events, "predicted_anomaly_rate": rate})
    return out.withColumn("expected_alerts", F.col("predicted_total_events") * F.col("predicted_anomaly_rate"))
