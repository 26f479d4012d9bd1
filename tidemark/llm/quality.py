"""Quality scores from a generalised additive model with pairwise interactions.

Features come from the bytes and words of a text. Cyclic boosting of shallow trees learns one
table of additions per feature, then tables for the pairs of features that explain most of what
is left; a score is the sum of the table entries of a text's bins. The labelled rows it fits on are bounded by
``MOST_LABELS``; scoring is a sum of vectorised look-ups on the executors.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, text_bytes, word_blocks

#: Labelled rows that a fit takes at most (those of the least hashes of doc_id).
MOST_LABELS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_LEAF, RIDGE = 60, 30, 0.15, 10, 2.0
FEATURES = (
    "log_bytes", "log_words", "bytes_a_word", "letters", "upper", "digits", "blanks", "lines", "other_bytes", "symbols", "marks",
    "bars", "bangs", "commas", "stops", "distinct_words", "top_word", "distinct_pairs", "distinct_fours", "short_words", "long_words",
)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, np.float64)
    m[list(chars)] = 1
    return m


_UPPER, _LOWERS = bytes(range(65, 91)), bytes(range(97, 123))
_KINDS = np.column_stack([
    _mask(_UPPER + _LOWERS), _mask(_UPPER), _mask(b"0123456789"), _mask(b" \t"), _mask(b"\n"), _mask(bytes(range(128, 256))), _mask(b"#$%&*@^~"),
    _mask(b"\"'()-/:;?[]_{}<>="), _mask(b"|"), _mask(b"!"), _mask(b","), _mask(b"."),
])


def features_of(data: bytes, words: np.ndarray) -> list[float]:
    """The features of one text, from its bytes and its word hashes."""
    n, m = len(data), len(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = count @ _KINDS / max(n, 1)
    lengths = np.fromiter(map(len, data.split()), np.int64, m) if m else np.zeros(1, np.int64)
    per_word, tops = (np.unique(words, return_counts=True)[1] if m else np.zeros(0)), 0.0
    if m:
        tops = per_word.max() / m
    grams = []
    for k in (2, 4):
        g = gram_hashes(words, k)
        grams.append(len(np.unique(g)) / len(g) if len(g) else 1.0)
    return [
        float(np.log1p(n)), float(np.log1p(m)), n / max(m, 1), *shares, len(per_word) / max(m, 1), tops, *grams,
        float((lengths <= 2).mean()), float((lengths >= 12).mean()),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    rows = [features_of(texts[at + i], w) for at, docs in word_blocks(texts, lower=True) for i, w in enumerate(docs)]
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[b[:, i] * PAIR_BINS // BINS, b[:, j] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g, h):
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins: what it adds to each."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth == 0 or len(g) < 2:
        return out
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch)
    gain[(cn < LEAST_LEAF) | (n.sum() - cn < LEAST_LEAF)] = -1
    k = int(np.argmax(gain))
    if gain[k] <= _gain(g.sum(), h.sum()):
        return out
    return np.concatenate([_tree(g[: k + 1], h[: k + 1], n[: k + 1], depth - 1), _tree(g[k + 1 :], h[k + 1 :], n[k + 1 :], depth - 1)])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on a matrix of features and labels 0 and 1. With no rows or one label the base rate alone is learnt."""
    rate = (y.sum() + 1) / (len(y) + 2)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = Model(float(np.log(rate / (1 - rate))), cuts, [np.zeros(BINS) for _ in FEATURES], [], [])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    f = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    counts = [np.bincount(b[:, j], minlength=BINS) for j in range(len(FEATURES))]
    for _ in range(ROUNDS):
        for j in range(len(FEATURES)):
            g, h = slopes()
            add = RATE * _tree(np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS), counts[j])
            model.tables[j] += add
            f += add[b[:, j]]
    # pairs that explain most of what is left
    small = b * PAIR_BINS // BINS
    g, h = slopes()
    gains = []
    for i in range(len(FEATURES)):
        for j in range(i):
            cell = small[:, i] * PAIR_BINS + small[:, j]
            gains.append((float(_gain(np.bincount(cell, g), np.bincount(cell, h)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            cell = small[:, i] * PAIR_BINS + small[:, j]
            g, h = slopes()
            sums = [np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h, np.ones(len(y)))]
            # a tree that first cuts one feature, then the other within each side
            best, choice = -np.inf, None
            for axis in (0, 1):
                s = sums if axis == 0 else [v.T for v in sums]
                for k in range(1, PAIR_BINS):
                    parts = [(slice(0, k), [v[:k].sum(axis=0) for v in s]), (slice(k, None), [v[k:].sum(axis=0) for v in s])]
                    leaves = [(at, _tree(*v, depth=1), v) for at, v in parts]
                    gain = sum(float((2 * leaf * v[0] - leaf**2 * (v[1] + RIDGE / PAIR_BINS)).sum()) for _, leaf, v in leaves)
                    if gain > best:
                        best, choice = gain, (axis, leaves)
            add = np.zeros_like(t)
            for at, leaf, _ in choice[1]:
                add[at] = leaf
            add = RATE * (add if choice[0] == 0 else add.T)
            t += add
            f += add[small[:, i], small[:, j]]
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, train: str, most: int = MOST_LABELS) -> DataFrame:
    """Texts and labels to learn from: at most ``most`` labelled ids (least hashes) for which ``train`` holds."""
    own = labels.where("doc_id is not null and quality in (0, 1)").where(train).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # of texts that repeat an id the least is read, so there is one row for each id
    return text.join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("quality").alias("quality")).select("text", "quality")


def train_model(docs: DataFrame, labels: DataFrame, train: str = "true") -> Model:
    """Features are made on the executors; at most ``MOST_LABELS`` rows of them are fitted on the driver."""

    def run(batches):
        for batch in batches:
            x = matrix(text_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"]
            )

    rows = labelled_rows(docs, labels, train).mapInArrow(run, "x array<double>, y int").toPandas()
    rows["key"] = rows.x.map(lambda v: np.asarray(v).tobytes())
    rows = rows.sort_values(["key", "y"])  # the same fit in whatever order tasks end
    x = np.stack(rows.x.tolist()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows.y.to_numpy(np.float64))


def scored(docs: DataFrame, model: Model, cutoff: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, in place of columns of these names; null texts count as empty."""
    docs = docs.drop("score", "predicted")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `score` double, `predicted` int"
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            score = model.score(matrix(text_bytes(batch.column(at))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= cutoff).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"]
            )

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, cutoff: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``cutoff`` or more, whatever other columns there are; null texts count as empty."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(matrix(text_bytes(batch.column(at)))) >= cutoff, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Rows kept apart for measuring: crc32 of the id as text, modulo 5, is 0.
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)"


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs(doc_id, text, ...)``.

    Learns only from labels of rows that are not held out. Null and empty texts get a score too; rows
    without doc_id are not held out; repeated rows each give one; without labels the score is 0.5's
    prior; no rows give none; other columns are ignored, as inputs too.
    """
    model = train_model(docs, labels, f"not {HELD_OUT}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lean = scored(rows, model, cutoff)
    return lean.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
