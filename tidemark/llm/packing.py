"""Packing of tokenised documents into sequences of a fixed capacity by harmonic classes.

Lengths fall into reciprocal classes: class m holds lengths in (C/(m+1), C/m], and each of its
sequences takes exactly m pieces, so workers fill their sequences alone. A remainder that would
leave more than ``WASTE`` of a sequence empty is cut at the next class's full length first.
Pieces of sequences that a worker could not fill go on to a wider group of workers, class by
class; the last group's, a number that does not grow with the input, are placed by first fit.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, cut_text, staged, text_bytes
from .tokens import load

CAPACITY, END_ID, WASTE = 2048, 1, 0.02
#: Groups of workers that pool their open sequences at each further level.
FAN_IN = 64
#: Words whose ids a task keeps before it forgets them all, and bytes of words and ids together.
KNOWN_WORDS, KNOWN_BYTES = 300_000, 32 << 20
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long"


def cut(length: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Lengths of a document's pieces, in order; each fills its class's sequences but for ``waste``."""
    out = [capacity] * (length // capacity)
    left = length % capacity
    while left:
        m = capacity // left
        take = left if left * m >= (1 - waste) * capacity else capacity // (m + 1)
        out.append(take)
        left -= take
    return out


# Kinds of bytes: 1 ASCII letters, 2 digits, 3 ASCII signs but the apostrophe, 0 all others.
_KINDS = np.array([2 if 48 <= c < 58 else 1 if chr(c).isalpha() and c < 128 else 3 if 33 <= c < 127 and c != 39 else 0 for c in range(256)], np.uint8)
#: Pairs of kinds, the first four times over, between which words are cut.
_CUT = np.array([(a, b) in {(1, 2), (2, 1), (2, 2), (1, 3), (3, 1), (2, 3), (3, 2)} for a in range(4) for b in range(4)])
#: Letters from U+00C0 to U+00FF: the byte 0xC3, then one of these.
_LATIN = np.array([c in range(0x80, 0xC0) and c not in (0x97, 0xB7) for c in range(256)])
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class WordIds:
    """Ids of texts by a tokenizer that drops white space and never joins across it: words are encoded once.

    Words are first cut where the tokenizer cuts them anyway: between a letter (A to Z, U+00C0 to U+00FF) and an ASCII
    sign or digit, about digits; A-Z are lower-cased as it does. Words are known by their bytes. A new word of such letters
    alone is one pre-token, so it goes to the tokenizer's model as that; other new words are encoded many at a time, with
    a mark between them that has an id of its own; words that hold the mark are encoded alone.
    """

    MARK, TOGETHER = b"~", 256

    def __init__(self, path: str) -> None:
        self.tok = load(path)
        self.model = self.tok.model
        # in lower case, as blocks are looked at
        self.special = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = self.tok.encode(self.MARK.decode(), add_special_tokens=False).ids
        # what the model is given for each letter
        letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100)) if chr(c).isalpha()]
        self.letters = {ord(c): "".join(x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(c.lower())) for c in letters}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def _alone(self, words: list[bytes]) -> list[bytes]:
        return [_raw(e.ids) for e in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        if len(self.mark) != 1:
            return self._alone(words)
        own = [k for k, w in enumerate(words) if self.MARK in w]
        out: list = [None] * len(words)
        for k, ids in zip(own, self._alone([words[k] for k in own])):
            out[k] = ids
        rest = [k for k in range(len(words)) if out[k] is None]
        parts = [rest[k : k + self.TOGETHER] for k in range(0, len(rest), self.TOGETHER)]
        texts = [(b"\n" + self.MARK + b"\n").join([words[k] for k in part]).decode() for part in parts]
        for part, e in zip(parts, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(ids == self.mark[0])
            if len(cut) != len(part) - 1:
                found = self._alone([words[k] for k in part])
            else:
                edges = [-1, *cut.tolist(), len(ids)]
                found = [ids[x + 1 : y].tobytes() for x, y in zip(edges[:-1], edges[1:])]
            for k, x in zip(part, found):
                out[k] = x
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Makes new words known."""
        known, tokenize, others = self.known, self.model.tokenize, []
        for w in words:
            if w.isalpha():
                text = w.lower().decode()
            elif _LETTERS.fullmatch(w):
                text = w.decode().translate(self.letters)
            else:
                others.append(w)
                continue
            known[w] = ids = _raw([t.id for t in tokenize(text)])
            self.size += len(w) + len(ids)
        for w, ids in zip(others, self._encoded(others)):
            known[w] = ids
            self.size += len(w) + len(ids)

    def _block(self, data: bytes, offsets: list[int]) -> list[bytes]:
        """Ids of each text of a block, where texts start at ``offsets`` and white space stands between."""
        if len(self.known) > KNOWN_WORDS or self.size > KNOWN_BYTES:
            self._forget()
        # special tokens are cut by nothing and looked for as they are; marks could join a letter differently by case
        low = data.lower()
        if not any(x in low for x in (*self.special, b"\xcc", b"\xcd")):
            buf = np.frombuffer(low, np.uint8)
            kinds = _KINDS[buf]
            lead = np.flatnonzero(buf[:-1] == 0xC3)
            lead = lead[_LATIN[buf[lead + 1]]]
            kinds[lead] = kinds[lead + 1] = 1
            cuts = np.flatnonzero(_CUT[kinds[:-1] * 4 + kinds[1:]]) + 1
            data = np.insert(buf, cuts, 32).tobytes()
            offsets = (offsets + np.searchsorted(cuts, offsets)).tolist()
        texts = [data[x:y].split() for x, y in zip(offsets, [*offsets[1:], len(data)])]
        self._learn(set(chain.from_iterable(texts)).difference(self.known))
        return [b"".join(map(self.known.__getitem__, words)) for words in texts]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK_BYTES):
                size += len(texts[end]) + 1
                end += 1
            if end == at + 1:
                out.append(b"".join(self._block(part, [0])[0] for part in cut_text(texts[at])))
            else:
                offsets = np.cumsum([0] + [len(t) + 1 for t in texts[at : end - 1]])
                out += self._block(b" ".join(texts[at:end]), offsets.tolist())
            at = end
        return out


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _fill(rows: list[tuple], key, number) -> tuple[list[tuple], list[tuple]]:
    """Fill each class's sequences with its fixed count: placed rows, and those of open sequences."""
    by: dict[int, list[tuple]] = {}
    for r in rows:
        by.setdefault(CAPACITY // r[key], []).append(r)
    done, rest = [], []
    for m in sorted(by):
        own = by[m]
        full = len(own) // m * m
        for at in range(0, full, m):
            seq, offset = number(), 0
            for r in own[at : at + m]:
                done.append((*r, seq, offset))
                offset += r[key]
        rest += own[full:]
    return done, rest


def _first_fit(rows: list[tuple], key, number) -> list[tuple]:
    done, bins = [], []
    for r in sorted(rows, key=lambda r: -r[key]):
        b = next((b for b in bins if b[1] + r[key] <= CAPACITY), None)
        if b is None:
            b = [number(), 0]
            bins.append(b)
        done.append((*r, b[0], b[1]))
        b[1] += r[key]
    return done


def _numbers(level: int, group: int):
    at = (level << 58) | (group << 32)

    def number() -> int:
        nonlocal at
        at += 1
        return at - 1

    return number


def _batch(rows: list[tuple], names: list[str], ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if ids and n == "ids" else pa.int64()) for n, c in zip(names, cols)], names=names)


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of packed ``docs(doc_id, text, ...)``.

    A document is its ids by the ``.json`` tokenizer at ``path`` (one that drops white space), then
    id 1. Each id lies in one piece; a sequence's pieces follow each other from 0 and hold at most
    2048 ids. ``with_ids`` adds each piece's ids (little-endian unsigned 32-bit, binary). Null and empty
    texts are the end id alone; doc_id is passed on, null or repeated; an empty table gives no rows;
    other columns are ignored. Sequence ids are unique, not consecutive.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kinds = _PIECE + ", ids binary" * with_ids
    columns = [*names, "sequence_id", "offset", "part"]
    order = [x.split()[0] for x in kinds.split(", ")]

    def first(batches):
        words, part = WordIds(path), TaskContext.get().partitionId()
        number, open_ = _numbers(0, part), []
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for at in range(0, len(texts), 256):
                rows = []
                for doc_id, coded in zip(doc_ids[at : at + 256], words.encode(texts[at : at + 256])):
                    coded += END_ID.to_bytes(4, "little")
                    total, start = len(coded) // 4, 0
                    for length in cut(total):
                        own = coded[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(own), total, *([own] * with_ids)))
                        start += length
                done, open_ = _fill(open_ + rows, 2, number)
                yield _batch([(*r, part) for r in done], columns, with_ids).select(order)
        yield _batch([(*r, None, None, part) for r in open_], columns, with_ids).select(order)

    def pooled(level: int, last: bool):
        def run(group_key, table):
            group = group_key[0].as_py()
            rows = sorted(zip(*(table.column(n).to_pylist() for n in names)), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
            number = _numbers(level, group)
            done, rest = _fill(rows, 2, number)
            if last:
                done, rest = done + _first_fit(rest, 2, number), []
            out = [(*r, group) for r in done] + [(*r, None, None, group) for r in rest]
            return pa.Table.from_batches([_batch(out, columns, with_ids).select(order)])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = staged(rows.mapInArrow(first, kinds), "pieces")
    done, open_ = placed.where("sequence_id is not null"), placed.where("sequence_id is null")
    parts, level = (open_.agg(F.max("part")).first()[0] or 0) + 1, 1
    while True:
        parts = -(-parts // FAN_IN)
        pool = open_.withColumn("g", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("g")
        placed = pool.applyInArrow(pooled(level, parts == 1), kinds)
        if parts == 1:
            break
        placed = staged(placed, "pieces")
        done, open_ = done.unionByName(placed.where("sequence_id is not null")), placed.where("sequence_id is null")
        level += 1
    return done.unionByName(placed).drop("part")
