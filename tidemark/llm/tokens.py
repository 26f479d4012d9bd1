"""Token counts with a public tokenizer; huge texts are encoded in overlapping chunks.

Each chunk is encoded with offsets. Two neighbours are spliced at a boundary that both have and
that no context can move: a blank after a character that is no white space, or a sign after a letter or digit. Pre-tokens of
these tokenizers take a blank only as their first character, and a run of letters or digits ends before a sign, so
every pre-token ends there, and what follows depends on what follows alone. The overlap reaches back to such a place; where
alignment fails it is widened, at last to the whole of both chunks. Text without any such place
(one endless word) is encoded as a whole, in steps that double.
"""

from __future__ import annotations

import os
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, TOGETHER = 1 << 16, 256, 64
_LOADED: dict[str, object] = {}


def load(path: str):
    """The library's tokenizer of a file, once for each worker: tokenizers for .json, sentencepiece for .model."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _stable(text: str, at: int) -> bool:
    now, before = text[at], text[at - 1]
    if now == " ":
        return not before.isspace()
    return not now.isspace() and category(before)[0] in "LN" and category(now)[0] not in "LNM"


def _last_stable(text: str, low: int, high: int) -> int | None:
    return next((p for p in range(high - 1, low, -1) if _stable(text, p)), None)


def _encode(tok, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    e = tok.encode(text[start:end], add_special_tokens=False)
    return e.ids, [start + a for a, _ in e.offsets]


def encode_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text of any length, equal to those of one call over the whole text."""
    end = min(len(text), chunk)
    ids, at = _encode(tok, text, 0, end)
    done: list[int] = []
    while end < len(text):
        more, low = min(len(text), end + chunk), at[0]
        # an overlap without a stable place is of no use: reach back to the last one at least
        last = _last_stable(text, low, end - 1)
        wide, place = overlap if last is None else max(overlap, end - last + 1), None
        while last is not None:
            start = max(low, end - wide)
            next_ids, next_at = _encode(tok, text, start, more)
            both = {p for p in at if p > start} & set(next_at)
            # the last token before the end may still grow
            place = next((p for p in sorted(both) if p < end - 1 and _stable(text, p)), None)
            if place is not None or start == low:
                break
            wide *= 2
        if place is None:
            # nothing to splice at: take as much again, so that all such attempts together stay linear
            more = min(len(text), low + max(2 * (end - low), chunk))
            ids, at = _encode(tok, text, low, more)
        else:
            done += ids[: at.index(place)]
            k = next_at.index(place)
            ids, at = next_ids[k:], next_at[k:]
        end = more
    return done + ids


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, with the tokenizer of the file ``path``.

    No begin, end or added special tokens, no truncation. Null and empty texts have no bytes and no
    tokens; doc_id is passed on as it is, null or repeated; an empty table gives no rows; other
    columns are ignored. ``.model`` files are encoded whole, ``.json`` in chunks of ``chunk`` characters.
    """

    def run(batches):
        tok = load(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [0] * len(texts)
            if path.endswith(".model"):
                counts = [len(tok.encode(x, num_threads=1)) for x in texts]
            else:
                short = [i for i, x in enumerate(texts) if 0 < len(x) <= chunk]
                for k in range(0, len(short), TOGETHER):
                    part = short[k : k + TOGETHER]
                    for i, e in zip(part, tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                        counts[i] = len(e)
                for i, x in enumerate(texts):
                    if len(x) > chunk:
                        counts[i] = len(encode_long(tok, x, chunk))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
