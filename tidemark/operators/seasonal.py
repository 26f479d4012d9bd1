"""Forecasts of a daily series: a trend that may bend at given places, times yearly and weekly cycles.

The trend is piecewise linear, the cycles are Fourier terms. Both are linear in their coefficients once the other is given,
so each is fitted in turn by least squares. The normal equations are sums over days that
tasks add up for themselves; what reaches the driver is a matrix of the terms, never the series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of the yearly and of the weekly cycle, places where the trend may bend, and the part of the history they lie in.
CYCLES = {365.25: 10, 7.0: 3}
BENDS, BENDS_WITHIN = 25, 0.8
LEAST_DAYS = 45


@dataclass
class SeasonalModel:
    """Coefficients of trend (level, slope, change of slope at each bend) and cycles; ``multiplicative``: cycles are shares of the trend."""

    first: int
    days: int
    bends: list[float]
    cycles: dict[float, int]
    multiplicative: bool
    trend: list[float] = field(default_factory=list)
    waves: list[float] = field(default_factory=list)

    def trend_terms(self, day: np.ndarray) -> np.ndarray:
        t = (day - self.first) / max(1, self.days)
        return np.column_stack([np.ones_like(t), t, *(np.maximum(0, t - b) for b in self.bends)])

    def wave_terms(self, day: np.ndarray) -> np.ndarray:
        return np.column_stack([f(2 * math.pi * k * day / period) for period, n in self.cycles.items() for k in range(1, n + 1) for f in (np.sin, np.cos)])

    def predict(self, day: Column) -> Column:
        """The forecast for a column of days since 1970, as an expression."""
        t = (day - self.first) / max(1, self.days)
        g = sum((c * F.greatest(F.lit(0.0), t - b) for c, b in zip(self.trend[2:], self.bends)), self.trend[0] + self.trend[1] * t)
        terms = [F_(2 * math.pi * k * day / period) for period, n in self.cycles.items() for k in range(1, n + 1) for F_ in (F.sin, F.cos)]
        s = sum((c * x for c, x in zip(self.waves, terms)), F.lit(0.0))
        return g * (1 + s) if self.multiplicative else g + s


def _solved(rows: DataFrame, terms, penalty: np.ndarray) -> np.ndarray:
    """Least squares of ``y`` on ``terms(day, y)``, a matrix and a target, with a penalty on each coefficient's square."""
    k = len(penalty)

    def run(batches):
        total = np.zeros(k * k + k)
        for batch in batches:
            if batch.num_rows:
                x, y = terms(*(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (0, 1)))
                total += np.concatenate([(x.T @ x).ravel(), x.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    sums = rows.select("day", "y").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    flat = np.zeros(k * k + k)
    for r in sums.collect():
        flat[r.k] = r.x
    return np.linalg.lstsq(flat[: k * k].reshape(k, k) + np.diag(penalty), flat[k * k :], rcond=None)[0]


def fit_seasonal(days: DataFrame, target: str, cycles: dict[float, int] | None = None, bends: int = BENDS, multiplicative: bool = True, rounds: int = 6, bending: float = 0.1, waving: float = 0.01) -> SeasonalModel | None:
    """A model of ``target`` in ``days(ds, target)``; None for fewer than ``LEAST_DAYS`` days.

    Days without a value are left out; days that are missing need not be there. ``bending`` and ``waving`` are penalties for a day's share of
    the series: the greater, the straighter the trend and the flatter the cycles. ``rounds`` times trend and cycles are fitted in turn.
    """
    rows = days.select(F.unix_date("ds").cast("double").alias("day"), F.col(target).cast("double").alias("y")).where("day is not null and y is not null")
    n, first, last = rows.agg(F.count_distinct("day"), F.min("day"), F.max("day")).first()
    if n < LEAST_DAYS:
        return None
    places = [BENDS_WITHIN * (k + 1) / (bends + 1) for k in range(bends)]
    m = SeasonalModel(int(first), int(last - first), places, dict(CYCLES if cycles is None else cycles), multiplicative)
    n_waves = 2 * sum(m.cycles.values())
    m.trend, m.waves = [0.0] * (2 + bends), [0.0] * n_waves
    straight, flat = np.array([0.0, 0.0] + [bending] * bends), np.full(n_waves, waving * n)

    def trend(day, y):
        s = m.wave_terms(day) @ np.array(m.waves)
        return (m.trend_terms(day) * (1 + s)[:, None], y) if multiplicative else (m.trend_terms(day), y - s)

    def waves(day, y):
        g = m.trend_terms(day) @ np.array(m.trend)
        return (m.wave_terms(day) * g[:, None], y - g) if multiplicative else (m.wave_terms(day), y - g)

    level = float(rows.agg(F.avg("y")).first()[0]) or 1.0
    for _ in range(rounds):
        m.trend = _solved(rows, trend, straight).tolist()
        # a share of a trend is small where the trend is large: the penalty goes by its square
        m.waves = _solved(rows, waves, flat * (level**2 if multiplicative else 1.0) * 1e-4).tolist()
    return m


def horizon_of(n: int) -> int:
    """How many of ``n`` days are kept back to try a model on."""
    return min(30, max(7, n // 5))


def future_days(days: DataFrame, n: int) -> DataFrame:
    """The ``n`` days after the last one."""
    last = days.agg(F.max("ds").alias("d")).where("d is not null")
    return last.select(F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", n))).alias("ds"))


def forecast_with(model: SeasonalModel, days: DataFrame) -> DataFrame:
    return days.withColumn("yhat", model.predict(F.unix_date("ds")))


def tried(days: DataFrame, target: str, **settings) -> dict | None:
    """``horizon``, ``mae`` and ``rmse`` of a model of all days but the last ones on these; None for fewer than ``LEAST_DAYS``."""
    n, last = days.where(F.col(target).isNotNull()).agg(F.count_distinct("ds"), F.max("ds")).first()
    if n < LEAST_DAYS:
        return None
    horizon = horizon_of(n)
    old = F.col("ds") <= F.date_sub(F.lit(last), horizon)
    model = fit_seasonal(days.where(old), target, **settings)
    if model is None:
        return None
    error = forecast_with(model, days.where(~old)).select((F.col("yhat") - F.col(target)).alias("e"))
    mae, rmse = error.agg(F.avg(F.abs("e")), F.sqrt(F.avg(F.col("e") * F.col("e")))).first()
    return {"horizon": horizon, "mae": mae, "rmse": rmse}
