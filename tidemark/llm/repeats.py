"""Removal of repeated passages by recompression.

Recompression names runs of one token, then, round by round, pairs of neighbouring symbols: a pair is
joined where its left symbol falls in one half of all names and its right one in the other. Names are hashes of
what they stand for, so all tasks give equal runs and pairs equal names. A
symbol depends on the words of its closure alone - its own words and those neighbours that decide
whether it is joined - so every symbol whose closure lies inside a passage stands in each copy of it.

A window is 20 words. It shows the longest symbol that it determines, named with its closure; equal windows show the same one at the
same place. Spark counts the symbols shown in all documents, and windows whose symbol is shown once are done. The
windows left are compared by their words, as two independent 64-bit hashes: Spark finds the first place
of each, and all other places are removed. Copies of whole texts are settled before, by SHA-256.

Rows of hot symbols are not shuffled by them, and first places are combined before their shuffle, so passages that
many documents share gather nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, join_counted, mix64, partitions, signed, staged, text_bytes, word_blocks

WINDOW = 20
#: Rounds of pairs; symbols of about five words come of them. More rounds add longer symbols to show, but more of them.
ROUNDS = 4
#: A span of windows is one number: the first one times this, and how many follow. A symbol is shown by 20 windows at most.
SPAN = 32
#: Ids of documents with repeats are broadcast up to this number, 8 bytes each; beyond it both sides are shuffled.
MOST_IDS = 1_000_000
_RUN, _PAIR = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: More than a window: what depends on a text's end is determined by no window.
_FAR = 100


def symbols(words: np.ndarray, ends: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The symbols that each round names: starts, ends, closures' starts and ends, names.

    ``ends`` marks the places between texts, which belong to none.
    """
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | ends[1:] | ends[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(words))
    name, out = words[start], ends[start]
    run = end - start > 1
    name = np.where(run, mix64(name + (end - start).astype(np.uint64) * _RUN), name)
    low, high = np.where(out, start - _FAR, start - 1), np.where(out, end + _FAR, end + 1)
    yield start[run], end[run], low[run], high[run], name[run]
    for r in range(rounds):
        right = mix64(name ^ (_PAIR + np.uint64(r))) >> np.uint64(63) == 1
        left = ~right & ~out
        right &= ~out
        at = np.flatnonzero(left[:-1] & right[1:])
        # what is not joined depends on the neighbour that it could have been joined with
        wide_low, wide_high = low.copy(), high.copy()
        k = np.flatnonzero(right[1:]) + 1
        wide_low[k] = low[k - 1]
        k = np.flatnonzero(left[:-1])
        wide_high[k] = high[k + 1]
        wide_low[at], wide_high[at] = low[at], high[at + 1]
        end, name = end.copy(), name.copy()
        end[at] = end[at + 1]
        name[at] = mix64(name[at] * np.uint64(3) + name[at + 1] * _PAIR + np.uint64(1))
        yield start[at], end[at], wide_low[at], wide_high[at], name[at]
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        start, end, name, out, low, high = (x[keep] for x in (start, end, name, out, wide_low, wide_high))


class _Spans:
    """Names of spans of words of any length, by sums of words with powers for weights."""

    def __init__(self, words: np.ndarray) -> None:
        base = int(_PAIR) | 1
        up, self.down = (np.full(len(words) + 1, np.uint64(b)) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = self.down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(self.down)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])

    def names(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix64((self.total[high] - self.total[low]) * self.down[low] + (high - low).astype(np.uint64) * _RUN)


def shown(words: np.ndarray, ends: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The closure of the longest symbol that each window determines, by name, and where the symbol starts; a window without one shows itself."""
    n = len(words) - WINDOW + 1
    best, place, name_of = np.zeros(n, np.uint64), np.full(n, -1, np.int64), np.zeros(n, np.uint64)
    closures = _Spans(words)
    for start, end, low, high, name in symbols(words, ends, rounds):
        fits = (high - low <= WINDOW) & (low >= 0) & (high <= len(words))
        start, end, low, high, name = (x[fits] for x in (start, end, low, high, name))
        if not len(start):
            continue
        value = ((end - start).astype(np.uint64) << np.uint64(58)) | (name >> np.uint64(6))
        # of all symbols in order, window i determines those from first[i] up to after[i]
        first = np.cumsum(np.bincount(low + 1, minlength=len(words) + 2))[:n]
        after = np.cumsum(np.bincount(high, minlength=len(words) + 2))[WINDOW : WINDOW + n]
        i = np.flatnonzero(after > first)
        if not len(i):
            continue
        count = (after - first)[i]
        # places of the greatest value (the leftmost among equal ones) of 1, 2, 4, ... symbols from each on
        tables = [np.arange(len(value))]
        while 1 << len(tables) <= count.max():
            t, h = tables[-1], 1 << (len(tables) - 1)
            more = t.copy()
            more[:-h] = np.where(value[t[:-h]] >= value[t[h:]], t[:-h], t[h:])
            tables.append(more)
        size = sum((count >= 1 << b).astype(np.int64) for b in range(1, len(tables))) + np.zeros(len(i), np.int64)
        table = np.stack(tables)
        a, b = table[size, first[i]], table[size, after[i] - (1 << size)]
        most = np.where(value[a] >= value[b], a, b)
        better = value[most] > best[i]
        most, i = most[better], i[better]
        best[i], place[i], name_of[i] = value[most], start[most], closures.names(low[most], high[most])
    none = np.flatnonzero(place < 0)
    if len(none):
        name_of[none], place[none] = gram_hashes(words, WINDOW)[none], none
    return name_of, place


def shown_by(texts: list[np.ndarray], rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: the names that its windows show, in order, and the first and last window of each."""
    between = np.zeros(1, np.uint64)
    words = np.concatenate([x for t in texts for x in (t, between)]) if texts else between
    after = np.cumsum([len(t) + 1 for t in texts])
    ends = np.zeros(len(words), bool)
    ends[after - 1] = True
    if len(words) >= WINDOW:
        best, place = shown(words, ends, rounds)
    for t, stop in zip(texts, after):
        n, at = max(len(t) - WINDOW + 1, 0), stop - 1 - len(t)
        if not n:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        b, p = best[at : at + n], place[at : at + n]
        turn = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (p[1:] != p[:-1])]))
        yield b[turn], turn, np.append(turn[1:], n) - 1


def _parse(batches):
    for batch in batches:
        texts = text_bytes(batch.column(1))
        n, sha, names, spans = [], [], [], []
        for at, docs in word_blocks(texts, lower=False):
            for k, (words, (name, first, last)) in enumerate(zip(docs, shown_by(docs, ROUNDS))):
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(texts[at + k].split())).hexdigest())
                names.append(signed(name))
                spans.append(first * SPAN + last - first)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(names, pa.list_(pa.int64())),
                pa.array(spans, pa.list_(pa.int64())),
            ],
            names=["doc_id", "version", "n_words", "sha", "names", "spans"],
        )


def _stretches(spans) -> list[tuple[int, int]]:
    """First and last windows of the stretches that sorted spans of windows cover."""
    out: list[tuple[int, int]] = []
    for first, more in (divmod(x, SPAN) for x in spans.values.to_pylist()):
        last = first + more
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _windows(batches):
    """Both hashes of each window left, with the earliest place it has in the batch."""
    for batch in batches:
        ids, versions, texts = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy(), text_bytes(batch.column("text"))
        spans = batch.column("spans")
        rows, starts, keys = [], [], ([], [])
        for (at, one), (_, two) in zip(word_blocks(texts, False), word_blocks(texts, False, 1)):
            for k in range(len(one)):
                for first, last in _stretches(spans[at + k]):
                    rows.append(np.full(last - first + 1, at + k))
                    starts.append(np.arange(first, last + 1))
                    for words, hashes in zip((one, two), keys):
                        hashes.append(gram_hashes(words[k][first : last + WINDOW], WINDOW))
        if not rows:
            continue
        row, start, a, b = (np.concatenate(x) for x in (rows, starts, *keys))
        order = np.lexsort((start, versions[row], ids[row], b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        at = order[new]
        columns = [signed(a[at]), signed(b[at]), ids[row[at]], versions[row[at]], start[at].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "two", "doc_id", "version", "start"])


def _cut(batches):
    """Texts less the windows left that are not their own words' first place."""
    for batch in batches:
        n, sha, own_sha, kept_texts = [], [], [], []
        for text, spans, own in zip(text_bytes(batch.column("text")), batch.column("spans"), batch.column("own")):
            words = text.split()
            again = np.zeros(len(words) + 1, bool)
            for first, last in _stretches(spans):
                again[first : last + 1] = True
            again[own.values.to_numpy()] = False
            s = np.flatnonzero(again)
            turn = np.zeros(len(words) + 1, np.int64)
            np.add.at(turn, s, 1)
            np.add.at(turn, s + WINDOW, -1)
            gone = np.cumsum(turn)[:-1] > 0
            kept = b" ".join([w for w, g in zip(words, gone) if not g])
            n.append(int(gone.sum()))
            own_sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode("utf-8"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(own_sha, pa.string()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_texts, pa.string())],
            names=["doc_id", "sha", "cut_words", "cut_sha", "kept_text"],
        )


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row of ``docs(doc_id, text, ...)``.

    Words covered by a window of 20 words that also starts earlier (smaller doc_id, or same text and
    an earlier word) are removed; windows are judged on the input. ``with_text`` adds the kept words (null where nothing was removed).
    Null and empty texts have no words; rows without doc_id lose nothing and take nothing from
    others; rows that repeat an id with the same text are one document; with other texts, each is a document of its own
    and the order among them is that of their hashes. An empty table gives no rows; other columns are ignored.
    Windows are told apart by 128 bits of hashes of their words: two that differ are taken for one with a chance of 2^-128 a pair.
    """
    text = _versions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    fields = "doc_id long, version long, n_words long, sha string, names array<long>, spans array<long>"
    parsed = staged(text.mapInArrow(_parse, fields), "parsed")
    lean = parsed.select("doc_id", "version", "n_words", "sha")
    long_ = parsed.where(f"doc_id is not null and n_words >= {WINDOW}")
    owner = staged(long_.groupBy("sha").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1"), "owner")
    shared = join_counted(lean.where("doc_id is not null"), owner, ["sha"])
    # of texts of an id that differ in blanks only, the least version is read
    least = shared.where("owner = doc_id").groupBy("doc_id", "sha").agg(F.min("version").alias("least"), F.max("version").alias("greatest")).where("least < greatest")
    blanks = shared.join(least, ["doc_id", "sha"]).where("version > least").select("doc_id", "sha", "version")
    past = shared.where("owner < doc_id").select("doc_id", "sha", "version").withColumn("copied", F.lit(True)).unionByName(blanks.withColumn("copied", F.lit(False)))
    past = staged(past.distinct(), "past")
    small = past.count() <= MOST_IDS
    keys = past.select("doc_id", "version")
    own = long_.select("doc_id", "version", "names", "spans").join(F.broadcast(keys) if small else keys, ["doc_id", "version"], "left_anti")
    own = own if small else staged(own, "own")

    # first round: the symbols that windows show
    shows = own.select("doc_id", "version", F.inline(F.arrays_zip("names", "spans"))).withColumnsRenamed({"names": "name", "spans": "span"})
    again = staged(shows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "again")
    left = join_counted(shows, again, ["name"]).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    left = staged(left, "left")

    # second round: the windows left; of equal ones the first stays, so all else that is left in a document goes
    parts = partitions(docs.sparkSession, 6 * (parsed.agg(F.sum("n_words")).first()[0] or 0))
    windows = _texts_of(text, left, parts).mapInArrow(_windows, "one long, two long, doc_id long, version long, start int")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "version", "start")).alias("p")).groupBy("p.doc_id", "p.version").agg(F.collect_list("p.start").alias("own"))
    both = left.join(first, ["doc_id", "version"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
    n_left = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + F.pmod(x, F.lit(SPAN)) + 1)
    cuts = staged(both.where(n_left > F.size("own")), "cuts")
    cut = _texts_of(text, cuts, parts).mapInArrow(_cut, "doc_id long, sha string, cut_words long, cut_sha string, kept_text string")
    cut = cut if with_text else cut.drop("kept_text")
    nothing = hashlib.sha256(b"").hexdigest()
    gone = past.where("copied").select("doc_id", "sha").distinct().withColumns({"cut_words": F.lit(None).cast("long"), "cut_sha": F.lit(nothing)} | ({"kept_text": F.lit("")} if with_text else {}))
    changed = staged(cut.dropDuplicates(["doc_id", "sha"]).unionByName(gone), "changed")
    out = lean.drop("version").join(changed, ["doc_id", "sha"], "left")
    removed = F.when(F.col("cut_sha").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("cut_words", "n_words"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), *(["kept_text"] if with_text else []))


def _versions(text: DataFrame) -> DataFrame:
    """``text`` with ``version``: 0, or where an id has more rows than one, the hash of their texts."""
    several = staged(text.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("several")), "several")
    if several.isEmpty():
        return text.withColumn("version", F.lit(0).cast("long"))
    several = F.broadcast(several) if several.count() <= MOST_IDS else several
    version = F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return text.join(several, "doc_id", "left").select("doc_id", "text", version.alias("version"))


def _texts_of(text: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """``wanted`` with the texts of its ids and versions, reading past other texts before any shuffle where ids are few."""
    if wanted.count() <= MOST_IDS:
        text = text.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")
    keys = ["doc_id", "version"]
    return text.repartition(parts, *keys).join(wanted.repartition(parts, *keys), keys)
