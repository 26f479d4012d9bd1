"""Benchmark decontamination: rare word n-grams seed alignments of passages with benchmark items.

One scan counts, for every n-gram of the items, the documents that hold it. An item's rare n-grams, and the rarest of each of its stretches,
become seeds; a second scan finds them in the texts, lays the item along the diagonal of its seeds
and scores the passage there by Smith-Waterman alignment of words. Both scans are map-side and
shuffle only counts and findings. Items are taken in blocks of bounded size, so what a task is sent
does not grow with the benchmark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, staged, text_bytes, word_blocks

SEED_WORDS = 3
#: A seed is held by at most this share of the documents, or is among the rarest of a stretch of its item.
RARE_SHARE, RARE_LEAST = 0.001, 3
#: What alignment pays for another word and for a missing one; a full match counts 1 a word.
OTHER, GAP = 0.5, 0.5
THRESHOLD = 0.5
#: Words of the items that one block of the benchmark holds at most; some 30 bytes for each are sent to tasks.
BLOCK_WORDS = 4_000_000
#: Stretches of an item that are compared together.
STRETCHES = 256
#: Alignments that are computed together.
TOGETHER = 256
#: Passages aligned together hold at most so many words, padding included; a longer one is aligned alone.
CELLS = 1 << 20

# Letters, digits and all bytes of other scripts make words; A-Z count as a-z, the rest separates.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass
class Items:
    """A block of items: ids, the word hashes of all of them in one array, and where each item's end.

    An item of at least ``SEED_WORDS`` words is searched by n-grams of that length, a shorter one by itself.
    For each length ``grams`` are sorted and distinct; gram ``i`` is held from ``first[i]`` up to ``first[i + 1]`` of ``item`` and ``place``.
    """

    ids: list
    flat: np.ndarray
    ends: np.ndarray

    def __post_init__(self) -> None:
        self.sizes = np.diff(self.ends, prepend=0)
        self.grams, self.first, self.item, self.place = {}, {}, {}, {}
        for n in range(1, SEED_WORDS + 1):
            mine = np.flatnonzero(np.minimum(self.sizes, SEED_WORDS) == n)
            if not len(mine):
                continue
            counts = self.sizes[mine] - n + 1
            item = np.repeat(mine, counts).astype(np.int32)
            place = (np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
            grams = gram_hashes(self.flat, n)[(self.ends - self.sizes)[item] + place]
            order = np.argsort(grams, kind="stable")
            self.grams[n], first = np.unique(grams[order], return_index=True)
            self.first[n] = np.append(first, len(grams)).astype(np.int32)
            self.item[n], self.place[n] = item[order], place[order]

    def words(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] - self.sizes[k] : self.ends[k]]


def _hits(words: np.ndarray, n: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` of known n-grams, and which ones they are."""
    own = gram_hashes(words, n)
    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
    place = np.flatnonzero(grams[at] == own)
    return place, at[place]


def _documents(texts: list[bytes]):
    """Index and word hashes of each text."""
    for at, docs in word_blocks([t.translate(_PLAIN) for t in texts], lower=False):
        for k, words in enumerate(docs):
            yield at + k, words


def gram_counts(docs: DataFrame, items: Items) -> dict[int, np.ndarray]:
    """For each n, the number of documents that hold each n-gram of the items."""
    known = items.grams  # all that tasks of this scan are sent

    def run(batches):
        counts = {n: np.zeros(len(g), np.int64) for n, g in known.items()}
        for batch in batches:
            for _, words in _documents(text_bytes(batch.column(0))):
                for n, grams in known.items():
                    counts[n][np.unique(_hits(words, n, grams)[1])] += 1
        for n, c in counts.items():
            i = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n, np.int32)), pa.array(i), pa.array(c[i])], names=["n", "i", "c"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "n int, i long, c long").groupBy("n", "i").agg(F.sum("c").alias("c"))
    out = {n: np.zeros(len(g), np.int64) for n, g in items.grams.items()}
    for r in rows.toLocalIterator():  # as many rows as the block has n-grams
        out[r.n][r.i] = r.c
    return out


def rare_grams(items: Items, counts: dict[int, np.ndarray], total: int) -> dict[int, np.ndarray]:
    """Which n-grams are seeds: rare ones, and in each stretch of an item those about as rare as its rarest quarter.

    A stretch has the n-grams inside of ``THRESHOLD`` of the item's words, the least that a finding
    copies, so each has seeds however many documents hold it.
    """
    rare = {n: c <= max(RARE_LEAST, RARE_SHARE * total) for n, c in counts.items()}
    for n, held in items.item.items():
        order = np.lexsort((items.place[n], held))
        index = np.repeat(np.arange(len(items.grams[n])), np.diff(items.first[n]))[order]
        turn = np.flatnonzero(np.diff(held[order], prepend=-1))
        for k, i in zip(held[order][turn].tolist(), np.split(index, turn[1:])):
            span = min(len(i), max(1, int(np.ceil(THRESHOLD * items.sizes[k])) - n + 1))
            view = np.lib.stride_tricks.sliding_window_view(counts[n][i], span)
            # the rarest quarter by rank, so that no stretch is without
            for at in range(0, len(view), STRETCHES):
                part = view[at : at + STRETCHES]
                bound = np.partition(part, (span - 1) // 4, axis=1)[:, (span - 1) // 4]
                row, column = np.nonzero(part <= 2 * bound[:, None])
                rare[n][i[at + row + column]] = True
    return rare


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of rows of word hashes (0 and 1 pad them), and where in the passage each alignment ends."""
    b, m = items.shape
    w = passages.shape[1]
    slope = GAP * np.arange(1, w + 1, dtype=np.float32)
    above = np.zeros((b, w + 1), np.float32)
    best, end = np.zeros(b, np.float32), np.zeros(b, np.int64)
    for i in range(m):
        fit = np.where(items[:, i : i + 1] == passages, np.float32(1), np.float32(-OTHER))
        now = np.maximum(above[:, :-1] + fit, above[:, 1:] - GAP)
        np.maximum(now, 0, out=now)
        # gaps along the passage: the best earlier cell less its distance
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        above[:, 1:] = now
        j = np.argmax(now, axis=1)
        top = now[np.arange(b), j]
        better = top > best
        best[better], end[better] = top[better], j[better] + 1
    return best, end


def _passages(words: np.ndarray, items: Items, seeds: dict[int, np.ndarray]):
    """``(item, start, end)`` of each stretch where seeds of an item lie near one diagonal."""
    for n, grams in items.grams.items():
        place, i = _hits(words, n, grams)
        place, i = place[seeds[n][i]], i[seeds[n][i]]
        if not len(i):
            continue
        first, held = items.first[n][i], np.diff(items.first[n])[i]
        at = np.arange(int(held.sum())) + np.repeat(first - (np.cumsum(held) - held), held)
        k, start = items.item[n][at], np.repeat(place, held) - items.place[n][at]
        order = np.lexsort((start, k))
        k, start = k[order], start[order]
        slack = items.sizes[k] // 2 + 2
        turn = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (np.diff(start) > slack[1:])))
        last = np.append(turn[1:], len(k)) - 1
        low, high = start[turn] - slack[turn], start[last] + items.sizes[k[turn]] + slack[turn]
        yield from zip(k[turn].tolist(), np.maximum(low, 0).tolist(), np.minimum(high, len(words)).tolist())


def _scored(queue: list[tuple], items: Items) -> list[tuple]:
    """Rows above the threshold of a queue of ``(doc_id, item, start, words of the passage)``."""
    rows = []
    queue.sort(key=lambda q: (len(q[3]), items.sizes[q[1]]))
    at = 0
    while at < len(queue):
        # passages come by width: as many together as keep to CELLS, one at least
        end = at + 1
        while end < min(len(queue), at + TOGETHER) and (end + 1 - at) * len(queue[end][3]) <= CELLS:
            end += 1
        part, at = queue[at:end], end
        a = np.zeros((len(part), max(int(items.sizes[q[1]]) for q in part)), np.uint64)
        b = np.ones((len(part), max(len(q[3]) for q in part)), np.uint64)
        for r, (_, k, _, p) in enumerate(part):
            a[r, : items.sizes[k]], b[r, : len(p)] = items.words(k), p
        best, end = align(a, b)
        for (doc, k, start, _), s, e in zip(part, best.tolist(), end.tolist()):
            score = s / int(items.sizes[k])
            if score >= THRESHOLD:
                rows.append((doc, k, score, start + e))
    return rows


def _find(docs: DataFrame, items: Items, seeds: dict[int, np.ndarray], item_field) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, rows, queue = batch.column(0).to_pylist(), [], []
            for k, words in _documents(text_bytes(batch.column(1))):
                queue += [(ids[k], item, a, words[a:b]) for item, a, b in _passages(words, items, seeds)]
                if len(queue) >= 8 * TOGETHER:
                    rows += _scored(queue, items)
                    queue = []
            rows += _scored(queue, items)
            best: dict[tuple, tuple] = {}
            for doc, k, score, end in rows:
                best[doc, k] = max(best.get((doc, k), (0, 0)), (score, -end))
            found = [(doc, items.ids[k], round(s, 6), -e) for (doc, k), (s, e) in best.items()]
            cols = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "score", "end_word"]
            )

    return docs.mapInArrow(run, f"doc_id long, item_id {item_field}, score double, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, end_word``: texts that hold a benchmark item, as a copy or an edited one.

    ``score`` is the best alignment's over the item's number of words (1 for a copy), at least
    ``THRESHOLD``; ``end_word`` counts the text's words up to where it ends. Null, empty and wordless texts and items match nothing; rows
    without item_id are ignored; rows without doc_id are found under a null id; repeated rows give
    one row with the best score; no rows on either side give none; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total, found = rows.count(), None
    for block in _blocks(items):
        counts = gram_counts(rows, block)
        part = _find(rows, block, rare_grams(block, counts, total), "long")
        part = staged(part, "leaks")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
    # an id's rows may lie in several batches
    best = F.max(F.struct("score", (-F.col("end_word")).alias("e"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.e")).alias("end_word"))


def _blocks(items: DataFrame):
    """The benchmark in blocks of at most ``BLOCK_WORDS`` words (one item at least), in order of id."""
    ids, words, size = [], [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        w = next((w for _, w in _documents([r.text.encode()])), np.zeros(0, np.uint64))
        if not len(w):
            continue
        if ids and size + len(w) > BLOCK_WORDS:
            yield Items(ids, np.concatenate(words), np.cumsum([len(x) for x in words]))
            ids, words, size = [], [], 0
        ids.append(r.item_id), words.append(w)
        size += len(w)
    if ids:
        yield Items(ids, np.concatenate(words), np.cumsum([len(x) for x in words]))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less those that hold a benchmark item; rows without doc_id stay."""
    leaks = contaminated(docs, benchmark).select(F.col("doc_id").alias("_leak")).where("_leak is not null").distinct()
    return docs.join(leaks, docs["doc_id"] == leaks["_leak"], "left_anti")
