"""Shared pieces: table access, staged tables, word and shingle hashing, connected components.

Words are maximal runs of bytes outside ``0x20, 0x09-0x0D``. Hashing works on whole Arrow
batches with numpy, the words of a block of texts at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19
SHINGLE_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one is set for a local session; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: What a task should read of a shuffle whose rows Python works on, where executors have about 1 GB a core.
TASK_BYTES = 16 << 20


def partitions(spark: SparkSession, size: int) -> int:
    """How many partitions ``size`` bytes make: as many as the session shuffles to, more where they would be large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


#: A key with more than one in ``HOT_SHARE`` of all rows is hot; there are fewer than that many.
HOT_SHARE = 5_000


def _hot(counted: DataFrame) -> tuple[int, DataFrame]:
    """The number of rows from which a key of ``counted(key, n, ...)`` is hot, and the hot keys."""
    bound = (counted.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    return bound, F.broadcast(counted.where(F.col("n") > bound))


def join_counted(rows: DataFrame, counted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` joined with the few of ``counted(key, n, ...)``, a staged table, that share their key; ``n`` counts the rows of each key.

    Hot keys, at most ``HOT_SHARE`` by the way they are chosen, are broadcast, so none of their rows is
    shuffled; all others meet in a shuffle in which no key is large.
    """
    bound, hot = _hot(counted)
    rest = rows.join(hot.select(*key), key, "left_anti").join(counted.where(F.col("n") <= bound), key)
    return rows.join(hot, key).unionByName(rest)


def without_counted(rows: DataFrame, counted: DataFrame, key: list[str]) -> DataFrame:
    """The ``rows`` that ``join_counted`` finds nothing for, with as little moved of hot keys."""
    return rows.join(_hot(counted)[1].select(*key), key, "left_anti").join(counted.select(*key), key, "left_anti")


#: A key with no more rows than this is never a hub.
HUB_ROWS = 1_000


def hubs(rows: DataFrame, key: str) -> DataFrame:
    """``(key, _parts)`` for each hub of ``rows``, a staged table: keys of very many rows, and the parts to deal those into."""
    counted = staged(rows.groupBy(key).agg(F.count("*").alias("n")).where(f"n > {HUB_ROWS}"), "hubs")
    bound = max(HUB_ROWS, (counted.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    return counted.where(F.col("n") > bound).select(key, F.ceil(F.col("n") / bound).cast("int").alias("_parts"))


def join_dealt(rows: DataFrame, side: DataFrame, key: str, by: str, found: DataFrame) -> DataFrame:
    """``rows`` joined with ``side(key, ...)``, whose rows may be large and are few for each key.

    The rows of each hub of ``found`` are dealt into its parts by column ``by``, and each part gets a copy of what
    ``side`` has for it. There are fewer than ``HOT_SHARE`` hubs, and fewer than twice as many copies in all;
    only hubs and their numbers of parts are broadcast.
    """
    parts, hot = F.coalesce("_parts", F.lit(1)), F.broadcast(found)
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.hash(by), parts)).drop("_parts")
    copies = side.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- hashing -----------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: Families of word hashes, by seed; two of them tell words apart by 128 bits.
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_COEF = _stream(64, 12) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def hash_block(data: bytes, lower: bool, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of a block of bytes.

    A word is read eight bytes at a time. Each eight are mixed with their place before they are added, so
    that no order or exchange of parts of long words cancels out.
    """
    buf = np.frombuffer(data, dtype=np.uint8)
    n = len(buf)
    gap = np.ones(n + 2, dtype=np.int8)
    gap[1:-1] = _SPACE[buf]
    turn = np.diff(gap)
    starts, ends = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[buf] if lower else buf
    eights = np.ndarray(n, "<u8", padded, strides=(1,))
    size = ends - starts
    parts = (size + 7) >> 3
    first = np.cumsum(parts) - parts
    k = np.arange(int(parts.sum())) - np.repeat(first, parts)
    at = np.repeat(starts, parts) + 8 * k
    values = eights[at] & _KEEP[np.minimum(np.repeat(ends, parts) - at, 8)]
    places = mix64((k.astype(np.uint64) + np.uint64(1)) * np.uint64(_SEEDS[family]))
    h = np.add.reduceat(mix64(values ^ places), first)
    return starts, ends, mix64(h + size.astype(np.uint64) * _COEF[2 * family])


def cut_text(data: bytes) -> Iterator[bytes]:
    """A long text in blocks that end in white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def word_blocks(texts: list[bytes], lower: bool, family: int = 0) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For consecutive texts: the index of the first one, and the word hashes of each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK_BYTES):
            size += len(texts[end]) + 1
            end += 1
        if end == at + 1:
            parts = [hash_block(b, lower, family)[2] for b in cut_text(texts[at])]
            yield at, [np.concatenate(parts) if parts else np.zeros(0, np.uint64)]
        else:
            starts, _, h = hash_block(b" ".join(texts[at:end]), lower, family)
            offsets = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
            cut = np.searchsorted(starts, offsets)
            yield at, [h[cut[i] : cut[i + 1]] for i in range(end - at)]
        at = end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, in order; empty where there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = words[:m] * _COEF[1]
    for j in range(1, n):
        total += words[j : m + j] * _COEF[1 + j]
    return mix64(total)


def shingle_set(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than ``n`` words make one shingle, no words none."""
    if 0 < len(words) < n:
        return gram_hashes(words, len(words)) ^ _COEF[40 + len(words)]
    return np.unique(gram_hashes(words, n))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- graphs ------------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for each end of an edge ``(a, b)``; component is the smallest id reachable.

    Each round hangs every node on the first of itself and its neighbours and contracts the graph to
    what nodes hang on, until no edge is left. First is the least id in the first two rounds, which
    settles stars, then in turn by a hash, which shortens chains by a share of their length, and by id.
    Minimum and join are apart, so a hub with very many edges is never gathered in one group. Null ends
    and loops are ignored; no edges give no rows.
    """
    now, hung = staged(edges.where("a <> b").select("a", "b"), "edges"), []
    while not now.isEmpty():
        salt = F.lit(len(hung))
        order = (lambda c: F.lit(0).cast("long")) if len(hung) < 2 or len(hung) % 2 else (lambda c: F.xxhash64(c, salt))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(order(F.col(c)).alias("k"), F.col(c).alias("id"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("u"), F.least(rank("a"), "m")["id"].alias("m"))
        first = staged(first, "hung")
        hung.append(first)
        ends = now.join(first.toDF("a", "ma"), "a").join(first.toDF("b", "mb"), "b").where("ma <> mb")
        now = staged(ends.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "edges")
    if not hung:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    label = hung[-1]
    for first in reversed(hung[:-1]):
        label = first.join(label.toDF("m", "next"), "m", "left").select("u", F.coalesce("next", "m").alias("m"))
    least = label.groupBy("m").agg(F.min("u").alias("component"))
    return label.join(least, "m").select(F.col("u").alias("id"), "component")
