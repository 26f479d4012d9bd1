"""Near-duplicate detection with HyperMinHash registers.

Each text's set of word shingles is cut into ``REGISTERS`` equal parts of the hash range; a part's
smallest hash is kept as the count of its leading zeros and the mantissa bits after them. Bands of
registers propose pairs, the share of equal registers less the expected accidental ones estimates
the resemblance, and the full shingle sets decide.

Texts with equal sets form one class and are searched once, by their smallest id. Within a band
value the members are first compared with its first and its last one; only members that this leaves in
different components are then compared with each other, so large groups of copies stay linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, connected_components, hubs, join_counted, join_dealt, mix64, shingle_set, signed, staged, text_bytes, word_blocks

REGISTERS, BAND, MANTISSA = 128, 4, 24
#: A pair is dropped unread only when its estimate lies this many standard deviations below the threshold.
SIGMAS = 6.0
#: Bands of at most this many members are compared pair by pair where components differ.
FEW = 16
#: Members on each side of a cell of a larger band.
CELL = 2048
#: 64-bit words of the map that tells members of larger bands apart.
WORDS = 16
_MARKS = ["n", "lacks", "lacks_hidden", "more", "more_hidden", *(f"w{k}" for k in range(WORDS))]
_STARTS = np.array([-(-i * (1 << 64) // REGISTERS) for i in range(REGISTERS)], dtype=np.uint64)
_SKETCH = "doc_id long, n_shingles long, c1 long, c2 long, registers binary, bands array<long>"


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least hash of each part, as 32 bits; 0 for an empty part."""
    at = np.searchsorted(hashes, _STARTS)
    have = at < np.append(at[1:], len(hashes))
    rest = (hashes[np.minimum(at, len(hashes) - 1)] - _STARTS) * np.uint64(REGISTERS)
    zeros = np.uint64(64) - np.frexp(np.maximum(rest, 1).astype(np.float64))[1].astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(60))
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(have, (zeros << np.uint64(MANTISSA)) + mantissa + np.uint64(1), 0).astype(np.uint32)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key for each band that has a filled register."""
    r = regs.astype(np.uint64).reshape(-1, BAND)
    key = np.arange(1, len(r) + 1, dtype=np.uint64) << np.uint64(40)
    for j in range(BAND):
        key = mix64(key + r[:, j])
    return key[r.any(axis=1)]


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Resemblance from register rows, corrected for accidental equality, and the registers it rests on."""
    filled = (a > 0) | (b > 0)
    used = np.maximum(filled.sum(axis=1), 1)
    equal = ((a == b) & filled).sum(axis=1)
    ratio = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
    accident = used * 0.17 * (4 * ratio / (1 + ratio) ** 2) / (1 << MANTISSA)
    return np.clip((equal - accident) / used, 0, 1), used


def _sketch(batches):
    for batch in batches:
        ids, texts = batch.column(0), text_bytes(batch.column(1))
        n, c1, c2, regs, bands = [], [], [], [], []
        for _, docs in word_blocks(texts, lower=True):
            for words in docs:
                s = shingle_set(words)
                n.append(len(s))
                if not len(s):
                    c1.append(0), c2.append(0), regs.append(b""), bands.append([])
                    continue
                c1.append(int(signed(s.sum(keepdims=True))[0]))
                c2.append(int(signed(np.bitwise_xor.reduce(mix64(s), keepdims=True))[0]))
                r = registers(s)
                regs.append(r.tobytes())
                bands.append(signed(band_keys(r)))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "c1", "c2", "registers", "bands"],
        )


def _sets(batches):
    for batch in batches:
        sets = [shingle_set(w).tobytes() for _, docs in word_blocks(text_bytes(batch.column(1)), lower=True) for w in docs]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])


def _plausible(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {k: batch.column(k) for k in batch.schema.names}
            a, b = (np.frombuffer(b"".join(cols[k].to_pylist()), dtype=np.uint32).reshape(-1, REGISTERS) for k in ("ra", "rb"))
            est, used = estimate(a, b, cols["na"].to_numpy(), cols["nb"].to_numpy())
            t = percent / 100
            keep = est >= t - SIGMAS * np.sqrt(t * (1 - t) / used)
            yield pa.RecordBatch.from_arrays([cols["a"], cols["b"]], names=["a", "b"]).filter(pa.array(keep))

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _marks(batches):
    """What each set lacks of its pivot's and has besides: how many shingles, how many share a bit of the map, and both maps."""
    half = 32 * WORDS
    for batch in batches:
        counts, maps = [], []
        for x, y in zip(batch.column("hashes"), batch.column("ph")):
            own, pivot = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            lacks, more = np.setdiff1d(pivot, own, assume_unique=True), np.setdiff1d(own, pivot, assume_unique=True)
            bits = np.zeros((2, half), np.uint8)
            # what it lacks by its place in the pivot's set, what it has besides by hash
            bits[0, np.searchsorted(pivot, lacks) * half // max(len(pivot), half)] = 1
            bits[1, (mix64(more) % np.uint64(half)).astype(np.int64)] = 1
            counts.append((len(own), len(lacks), len(lacks) - int(bits[0].sum()), len(more), len(more) - int(bits[1].sum())))
            maps.append(np.packbits(bits).view(np.int64))
        columns = [*np.array(counts, np.int64).reshape(-1, 5).T, *np.array(maps, np.int64).reshape(-1, WORDS).T]
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("id"), *map(pa.array, columns)], names=["pivot", "id", *_MARKS])


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one band that lie in different components and could still be linked.

    Bands of up to ``FEW`` members give all such pairs. In larger ones two texts are paired only where
    what sets them apart from a common pivot overlaps enough: with D the symmetric difference to the
    pivot, the difference of two texts is ``|D1| + |D2| - 2 |D1 & D2|``, and bit maps of D bound the
    overlap from above. Families whose members differ from a common source in places of
    their own are thereby told apart without comparing them in pairs, and no link is lost.
    """
    split = rest.groupBy("band").agg(F.min("comp").alias("pivot"), F.max("comp").alias("d"), F.count("*").alias("n")).where("pivot <> d")
    open_ = staged(join_counted(rest, staged(split.drop("d"), "split"), ["band"]).withColumnRenamed("n", "m"), "open")
    few = open_.where(f"m <= {FEW}").select("band", "id", "comp")
    pairs = few.alias("x").join(few.alias("y"), "band").where("x.comp < y.comp").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    many = open_.where(f"m > {FEW}").select("band", "m", "id", "comp", "pivot")
    own = staged(many.select("pivot", "id").distinct(), "pivots")
    both = join_dealt(own, sets.toDF("pivot", "ph"), "pivot", "id", hubs(own, "pivot")).join(sets.toDF("id", "hashes"), "id")
    fields = "pivot long, id long, " + ", ".join(f"{c} long" for c in _MARKS)
    marked = many.join(staged(both.mapInArrow(_marks, fields), "marks"), ["pivot", "id"]).drop("pivot")

    def shared(count: str, hidden: str, words: range) -> str:
        bits = " + ".join(f"bit_count(x.w{k} & y.w{k})" for k in words)
        return f"least(x.{count}, y.{count}, {bits} + least(x.{hidden}, y.{hidden}))"

    common = f"{shared('lacks', 'lacks_hidden', range(WORDS // 2))} + {shared('more', 'more_hidden', range(WORDS // 2, WORDS))}"
    # the members of a band are cut into cells, and each two cells, in one order, are a task's work
    cells = F.ceil(F.col("m") / CELL).cast("int")
    celled = marked.withColumn("cell", F.pmod(F.hash("id"), cells))
    x = celled.withColumnRenamed("cell", "row").withColumn("column", F.explode(F.sequence("row", cells - 1)))
    y = celled.withColumnRenamed("cell", "column").withColumn("row", F.explode(F.sequence(F.lit(0), "column")))
    # the maps of one side unfold to far more than their compressed size says: never a broadcast
    far = x.alias("x").join(y.hint("merge").alias("y"), ["band", "row", "column"]).where(
        f"x.comp <> y.comp and (row < column or x.comp < y.comp) and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and "
        f"(100 + {percent}) * (x.lacks + x.more + y.lacks + y.more - 2 * ({common})) <= (100 - {percent}) * (x.n + y.n)"
    )
    return pairs.unionByName(far.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text, ...)``.

    Words are lower-cased (A-Z); a set holds the distinct shingles of five words, or the whole
    sequence of a shorter text. Two texts are linked when 100 x common >= ``percent`` x all of
    their shingles. ``component_id`` is the least doc_id that links reach, ``kept`` marks it.
    Defined cases: null, empty and blank texts have no shingles and are linked with nothing;
    rows without doc_id are linked with nothing, have a null component and are kept; repeated
    rows each get their row; an empty table gives none; other columns are ignored.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = staged(text.mapInArrow(_sketch, _SKETCH), "sketch")
    filled = sketch.where("doc_id is not null and n_shingles > 0")
    key = ["c1", "c2", "n_shingles"]
    classes = filled.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    # A repeated id may carry several texts; each of its sets is searched under its own key.
    followers = join_counted(filled.select("doc_id", *key), staged(classes, "classes"), key).where("doc_id <> rep")
    followers = staged(followers.select("doc_id", *key, "rep").distinct(), "followers")
    reps = staged(
        filled.join(followers, ["doc_id", *key], "left_anti").dropDuplicates(["doc_id", *key]).select("doc_id", *key, "registers", "bands"), "reps"
    )
    entries = reps.select(F.explode("bands").alias("band"), F.col("doc_id").alias("id"))
    crowded = entries.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low <> high")
    members = staged(join_counted(entries, staged(crowded, "crowded"), ["band"]).drop("n"), "members")
    seen = members.select("id").distinct()
    sets = staged(
        text.join(seen.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, hashes binary"),
        "sets",
    )
    regs = reps.select("doc_id", "n_shingles", "registers")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = staged(pairs, "pairs")
        # the first and the last id of a crowded band are in pairs with all its members
        many_a, many_b = hubs(pairs, "a"), hubs(pairs, "b")

        def with_both(rows: DataFrame, side: DataFrame, a: list[str], b: list[str]) -> DataFrame:
            return join_dealt(join_dealt(rows, side.toDF("a", *a), "a", "b", many_a), side.toDF("b", *b), "b", "a", many_b)

        sized = with_both(pairs, regs, ["na", "ra"], ["nb", "rb"]).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        likely = sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_plausible(percent), "a long, b long")
        full = with_both(likely, sets, ["ha"], ["hb"])
        return full.mapInArrow(_confirmed(percent), "a long, b long")

    def labelled(links: DataFrame) -> DataFrame:
        """Members with a label that only texts of one component share: the least id one link away."""
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp"))
        return members.join(label, "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))

    first = members.select(F.col("low").alias("a"), F.col("id").alias("b")).unionByName(
        members.select(F.col("high").alias("a"), F.col("id").alias("b"))
    )
    links = staged(verify(first), "links")
    links = links.unionByName(verify(_across(staged(labelled(links), "labelled"), sets, percent)))
    found = staged(connected_components(links), "components")
    # Rows of one id with different texts are one document: its smallest label holds for all of them.
    led = followers.groupBy("rep").agg(F.count("*").alias("n")).join(found.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    label = (
        reps.select("doc_id").join(found.toDF("doc_id", "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
        .unionByName(join_counted(followers.select("doc_id", "rep"), staged(led, "led"), ["rep"]).select("doc_id", "component"))
        .groupBy("doc_id").agg(F.min("component").alias("component_id"))
    )
    out = sketch.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
