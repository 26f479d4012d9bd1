"""Document fingerprints: the bottom-k sketch of a text's word shingles.

A sketch holds the K least 48-bit hashes of a set, in order. Sketches of parts merge into the
sketch of their union; two of them estimate resemblance and containment, one the size of its set.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TASK_BYTES, partitions, shingle_set, word_blocks

K, BITS = 128, 48


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of a set of 64-bit hashes."""
    return np.unique(hashes >> np.uint64(64 - BITS))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in all of both; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    least = merge(a, b, k)
    return float(np.isin(least, a, assume_unique=True)[np.isin(least, b, assume_unique=True)].sum() / len(least))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact for sets smaller than the sketch."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[-1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    """A sketch as text: six bytes a hash, in base 64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def sketches(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    return [bottom(shingle_set(w), k) for _, docs in word_blocks(texts, lower=True) for w in docs]


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, fingerprint, distinct_shingles`` of each row; null and empty texts have the empty sketch."""

    def run(batches):
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            found = sketches(texts, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([to_text(x) for x in found]), pa.array([distinct(x, k) for x in found], pa.float64())],
                names=["doc_id", "fingerprint", "distinct_shingles"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string, distinct_shingles double")


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: list[tuple[int, str]], after: str) -> pa.RecordBatch:
    texts = [t for _, t in rows]
    nexts = [*texts[1:], after]
    edited = []
    for t, u in zip(texts, nexts):
        part = len(t) // 3
        edited.append(t[: len(t) - part] + u[:part])
    coded = [t.encode() for t in edited]
    own = sketches([t.encode() for t in [*texts, after]])
    changed = sketches(coded)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
            pa.array([to_text(s) for s in own[:-1]], pa.string()), pa.array([to_text(s) for s in changed], pa.string()),
            pa.array([resemblance(a, b) for a, b in zip(own, changed)], pa.float64()),
            pa.array([resemblance(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ],
        names=[x.split()[0] for x in _COMPARED.split(", ")],
    )


def _in_order(batches):
    """Rows come by range, falling id; the row that closes a range is the head of the next and only lends its text."""
    held: list[tuple[int, str]] = []
    size = 0
    for batch in batches:
        for i, t, border in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "border"))):
            t = t or ""
            if border:
                if held:
                    yield _compared(held, t)
                held, size = [], 0
                continue
            if size > 1 << 20:
                yield _compared(held, t)
                held, size = [], 0
            held.append((i, t))
            size += len(t)


#: Limits of ranges that one pass finds for a range; more are found range by range in further passes.
CUTS = 1_000


def _range_of(limits):
    """A column: the range of each doc_id by the limits of ranges (a broadcast array), and whether it is such a limit."""

    @F.pandas_udf("r long, head boolean")
    def find(ids: pd.Series, missing: pd.Series) -> pd.DataFrame:
        known, value, none = limits.value, ids.to_numpy(), missing.to_numpy()
        r = np.where(none, 0, np.searchsorted(known, value))
        head = ~none & (known[np.minimum(r, len(known) - 1)] == value) if len(known) else np.zeros(len(value), bool)
        return pd.DataFrame({"r": r, "head": head})

    # nulls would turn ids into floats on their way
    return find(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())


def range_limits(rows: DataFrame, ranges: int, least: int, greatest: int) -> np.ndarray:
    """Ids of the table, from ``least`` to ``greatest``, that cut it into about ``ranges`` ranges of as many rows, the greatest id last: eight bytes a range."""
    limits = np.array([greatest], dtype=np.int64)
    held = rows.where("doc_id is not null")
    by_range = lambda: held.groupBy(_range_of(rows.sparkSession.sparkContext.broadcast(limits))["r"].alias("r"))
    while len(limits) < ranges:
        cuts = min(CUTS, -(-ranges // len(limits)))
        at = F.array(*(F.lit(i / cuts) for i in range(1, cuts)))
        # percentiles are floats: counted from the least id they are right for more ids
        found = by_range().agg(F.percentile_approx(F.try_subtract("doc_id", F.lit(least)), at, 20 * cuts).alias("at")).collect()
        limits = np.union1d(limits, np.array([x + least for r in found for x in r.at or ()], dtype=np.int64))
        # each limit is the greatest id of its range, whatever floats made of it
        exact = np.array(sorted(r.top for r in by_range().agg(F.max("doc_id").alias("top")).collect()), dtype=np.int64)
        limits, stuck = exact, len(exact) <= len(found)
        if stuck:
            break  # no range holds ids that can be told apart
    return limits


def compare_with_edits(docs: DataFrame, rows_per_range: int = 4096) -> DataFrame:
    """Each text's fingerprint beside those of its edited copy and of the next document.

    Order: falling doc_id, ties by text; the first document follows the last one. The edited text has its last
    floor(n/3) code points replaced by the next text's first as many, or all of it. Documents are dealt
    out by ranges of doc_id whose limits are ids of the table; the document that opens a range also
    goes, as a border, to the range before. Null texts count as empty; rows without doc_id come last;
    repeated rows each give one; no rows give none; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.count("*"), F.max("doc_id"), F.sum(F.octet_length("text")), F.min("doc_id")).first()
    # a range, and a task, for as many rows or bytes, whichever makes more
    ranges = max(1, total[0] // rows_per_range, (total[2] or 0) // TASK_BYTES)
    heads = range_limits(rows.select("doc_id"), ranges, total[3], total[1]) if total[1] is not None else np.zeros(0, np.int64)
    # The text of the very first document closes the last range; so do the heads of all others: one row a range.
    own = rows.withColumn("f", _range_of(spark.sparkContext.broadcast(heads))).select("doc_id", "text", "f.r", "f.head").withColumn("border", F.lit(False))
    tops = own.where("head") if len(heads) else own
    tops = tops.groupBy("r", "doc_id").agg(F.min("text").alias("text"))
    border = tops.select(
        "doc_id", "text", F.when(F.col("r") < len(heads) - 1, F.col("r") + 1).otherwise(F.lit(0)).cast("long").alias("r"), F.lit(True).alias("border")
    ).where(F.lit(len(heads) > 0))
    if not len(heads):
        border = border.unionByName(rows.groupBy().agg(F.min("text").alias("text")).where("text is not null").select(
            F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("r"), F.lit(True).alias("border")))
    dealt = own.select("r", "doc_id", "text", "border").unionByName(border.select("r", "doc_id", "text", "border"))
    parts = max(1, min(len(heads), partitions(spark, total[2] or 0)))
    ordered = dealt.repartition(parts, "r").sortWithinPartitions("r", "border", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_in_order, _COMPARED)
