"""Whitening of embeddings: exact integer means, covariance in two passes, eigenvectors, projection.

Components are taken times 256 and rounded down to integers. The first pass adds them exactly; the second
one multiplies centred matrices; both leave one small partial result a partition, merged in a
tree. What the driver holds is a matrix of the vectors' length squared, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCALE, COMPONENTS = 256, 4
_LONG = np.iinfo(np.int64)


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of an array column, all of one length and without nulls, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def merged(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], object], add: Callable, depth: int = 2):
    """``partial`` of the batches of each partition that has rows, added up in a tree; None without any row."""
    import pickle

    def run(batches):
        found = partial(b for b in batches if b.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["part"])

    both = lambda a, b: b if a is None else a if b is None else add(a, b)
    parts = df.mapInArrow(run, "part binary").rdd.map(lambda row: pickle.loads(row.part))
    return parts.treeAggregate(None, both, both, depth)


def _sums(batches):
    """Rows and exact sums of each dimension, as Python integers."""
    n, total = 0, None
    for batch in batches:
        x = matrix(batch.column(0), np.int64)
        safe = x.size and max(abs(int(x.min())), abs(int(x.max()))) < (1 << 62) // len(x)
        part = (x if safe else x.astype(object)).sum(axis=0).astype(object)
        part = np.array([int(v) for v in part], dtype=object)
        n, total = n + len(x), part if total is None else total + part
    return None if total is None else (n, total)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact: as 64-bit integers where these hold it, else as Python's."""
    most = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    if n * most + max(abs(int(s)) for s in sums) < 1 << 62:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _outer(n: int, sums: np.ndarray):
    def run(batches):
        total = None
        for batch in batches:
            y = centred(matrix(batch.column(0), np.int64), n, sums).astype(np.float64) / n
            total = y.T @ y if total is None else total + y.T @ y
        return total

    return run


def _moments(n: int, sums: np.ndarray, by: np.ndarray):
    """Count, mean and centred products of what the vectors are projected to; two of them merge to one."""

    def run(batches):
        found = None
        for batch in batches:
            w = centred(matrix(batch.column(0), np.int64), n, sums).astype(np.float64) / n @ by
            d = w - (mean := w.mean(axis=0))
            found = _merge(found, (len(w), mean, d.T @ d)) if found else (len(w), mean, d.T @ d)
        return found

    return run


def _merge(a, b):
    (n, p, u), (m, q, v) = a, b
    d = q - p
    return n + m, p + d * (m / (n + m)), u + v + np.outer(d, d) * (n * m / (n + m))


def _integers(batches):
    for batch in batches:
        ids, rows = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            c = None if not v.is_valid else v.values
            if c is None or c.null_count or not len(c):
                continue
            c = c.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(c).all():
                with np.errstate(over="ignore"):
                    x = np.floor(SCALE * c)
                # beyond 64 bits the nearest long stands
                big, small = x >= 2.0**63, x < -(2.0**63)
                x = np.where(big | small, 0, x).astype(np.int64)
                rows.append(np.where(big, _LONG.max, np.where(small, _LONG.min, x)))
                ids.append(i)
        ends = np.cumsum([0] + [len(x) for x in rows]).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["vec_id", "x"])


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict | None:
    """Counts, sums, eigenvalues, unit eigenvectors (columns) and the projection of a table of distinct integer vectors ``x``."""
    found = merged(distinct, _sums, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    if found is None:
        return None
    n, sums = found
    cov = merged(distinct, _outer(n, sums), np.add) / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    values, axes, trace = np.maximum(values[order], 0), axes[:, order], float(np.trace(cov))
    # directions without variance have no scale: they are left out of what is whitened
    real = values > len(cov) * np.finfo(float).eps * max(float(values[0]), 0.0)
    by = axes / np.sqrt(np.where(real, values, 1))
    error = None
    if real.any():
        m, _, products = merged(distinct, _moments(n, sums, by[:, real]), _merge)
        error = float(np.abs(products / m - np.eye(int(real.sum()))).max())
    return {"n": n, "sums": sums, "values": values, "axes": axes, "trace": trace, "real": real, "by": by, "error": error}


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact`` of ``vectors(vec_id, column, ...)``.

    Each row with a usable vector gives one row for each component, at most as many as a vector has
    entries. The fit is over the distinct integer vectors. Defined cases: vectors that are null or empty or hold
    null or non-finite entries are dropped; so are those of another length than most (the longest of
    equally frequent lengths), which have no place in one covariance; entries beyond 64 bits become the
    nearest long. ``deviation`` is null where it does not fit a long, ``deviation_exact`` (decimal digits as
    text) always holds it. A component without variance is null in ``whitened`` and not part of
    ``identity_error``; ``explained`` is null if no component has any. Null and repeated vec_id are passed on;
    an empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    rows = staged(rows.mapInArrow(_integers, "vec_id long, x array<long>"), "integers")
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    most = rows.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    rows = rows.where(F.size("x") == (most["k"] if most else 0))
    model = fit(staged(rows.select("x").distinct(), "distinct"), components) if most else None

    def run(batches):
        n, k = model["n"], len(model["values"])
        explained = [v / model["trace"] if model["trace"] > 0 else None for v in model["values"].tolist()]
        for batch in batches:
            if not batch.num_rows:
                continue
            c = centred(matrix(batch.column(1), np.int64), n, model["sums"])
            w = c.astype(np.float64) / n @ model["by"]
            exact = c.dtype != object and int(np.abs(c).max()) ** 2 * c.shape[1] < 1 << 62
            deviation = ((c if exact else c.astype(object)) ** 2).sum(axis=1).tolist()
            m = len(c)
            long = pa.array([d if d <= _LONG.max else None for d in deviation], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    long.take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel(), mask=np.tile(~model["real"], m)), pa.array(explained * m, pa.float64()),
                    pa.array([model["error"]] * (m * k), pa.float64()), pa.array([str(d) for d in deviation]).take(pa.array(np.repeat(np.arange(m), k))),
                ],
                names=[f.split()[0] for f in out.split(", ")],
            )

    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    return rows.mapInArrow(run, out)
