"""Score arithmetic on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import FusionParams


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def sigmoid(c: Column) -> Column:
    """Stable for large values of either sign."""
    e = F.exp(-F.abs(c))
    return F.when(c >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def saturate(c: Column, scale: float = 5.0) -> Column:
    """0..100, approaching 100 as the score grows."""
    return clamp(100 * (1 - F.exp(-c / scale)))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def surprise(logits: Column, target: Column) -> Column:
    """Negative log likelihood of the target (from 0); null where there is none."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when((target >= 0) & (target < F.size(logits)), F.ln(total) + top - F.get(logits, target.cast("int")))


def risk_level(score: Column, p: FusionParams = FusionParams()) -> Column:
    return F.when(score >= p.critical, "CRITICAL").when(score >= p.high, "HIGH").when(score >= p.medium, "MEDIUM").otherwise("LOW")


def severity(points: Column) -> Column:
    return F.when(points >= 40, "HIGH").when(points >= 25, "MEDIUM").otherwise("LOW")


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value on a cycle."""
    angle = 2 * math.pi * value / period
    return F.sin(angle), F.cos(angle)


def business_hours(hour: Column, given: Column | None = None) -> Column:
    """The encoder's definition, 8 <= hour < 19, unless the event says itself."""
    own = ((hour >= 8) & (hour < 19)).cast("int")
    return own if given is None else F.coalesce(given, own)


def business_hours_running(hour: Column) -> Column:
    """The running summary's definition: 9 <= hour <= 18."""
    return hour.between(9, 18).cast("int")


def standardized(c: Column, mean: float, scale: float) -> Column:
    """(x - mean) / scale; what is no finite number gives 0."""
    z = (c - mean) / (scale or 1.0)
    return F.when(c.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), 0.0).otherwise(z)


def clip_scaled(c: Column, low: float, high: float, center: float, scale: float) -> Column:
    return (clamp(c, low, high) - center) / (scale or 1.0)
