"""Links between embeddings of high cosine: an epsilon grid order join over sorted sequence intervals.

Two unit vectors have a cosine of at least c where they are at most eps = sqrt(2 - 2c) apart. Equal vectors are
one class, searched once. Classes are sorted by the cells, eps wide, of their leading principal
coordinates, and the sequence is cut into leaves, leaves into pages, pages into ever larger intervals.
Intervals are joined from the whole sequence down: a pair whose boxes or balls lie further apart than
eps is skipped with all that is in it, a pair whose balls lie together within eps is linked as a
whole. What is left are pairs of pages, which tasks join leaf by leaf: leading coordinates first, then
the cosine in double precision. A task returns counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_counted, partitions, staged, without_counted
from .whitening import matrix, merged

#: Vectors of a leaf, leaves of a page, intervals of an interval one level up.
LEAF, LEAVES, FAN = 256, 32, 16
#: Leading principal coordinates: of the sort order, and of boxes and first comparisons.
SORTED, LEADING = 8, 16
#: Room for rounding in what is decided without the cosine itself.
SLACK = 1e-6
_SLOT = 16
_PLACED = "place binary, dim int, rep long, n long, v binary"
_STATS = "dim int, n long, centre array<double>, radius double, low array<double>, high array<double>"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their size; none may be zero."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _basis(classes: DataFrame, dim: int) -> np.ndarray:
    """The leading principal directions of unit vectors of one length, as columns."""

    def outer(batches):
        n, total, products = 0, 0, 0
        for batch in batches:
            u = unit(matrix(batch.column(0), np.float64))
            n, total, products = n + len(u), total + u.sum(axis=0), products + u.T @ u
        return (n, total, products) if n else None

    n, total, products = merged(classes.where(F.size("v") == dim).select("v"), outer, lambda a, b: tuple(x + y for x, y in zip(a, b)))
    mean = total / n
    return np.linalg.eigh(products / n - np.outer(mean, mean))[1][:, ::-1][:, :LEADING]


def _leading(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Leading coordinates: by the basis where it is for vectors of this length, else the first ones as they are; padded with zeros."""
    p = u @ basis if u.shape[1] == len(basis) else u[:, :LEADING]
    return np.pad(p, ((0, 0), (0, LEADING - p.shape[1])))


def _placed(basis: np.ndarray, eps: float, kind: str):
    """Each class with its place in grid order: length, cells, then the coordinates themselves, as bytes that sort alike."""

    def run(batches):
        for batch in batches:
            dims = _lengths(batch.column(2))
            places, data = [None] * len(dims), [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                raw = matrix(batch.column(2).take(pa.array(at)), np.dtype(kind))
                p = _leading(unit(raw), basis)[:, :SORTED]
                cells = (np.floor(p / max(eps, 1 / 128)).astype(np.int64) + (1 << 15)).astype(">u2")
                fine = ((p + 2) * (1 << 30)).astype(np.int64).clip(0, (1 << 32) - 1).astype(">u4")
                head = int(dim).to_bytes(4, "big")
                for k, i in enumerate(at):
                    places[i], data[i] = head + cells[k].tobytes() + fine[k].tobytes(), raw[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.binary()), pa.array(dims, pa.int32()), batch.column(0), batch.column(1), pa.array(data, pa.binary())],
                names=["place", "dim", "rep", "n", "v"],
            )

    return run


def _ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    centre = points.mean(axis=0)
    return centre, float(np.sqrt(((points - centre) ** 2).sum(axis=1)).max())


def _leaves(basis: np.ndarray, kind: str):
    """Runs of at most ``LEAF`` sorted classes of one length, numbered within the partition."""

    def run(batches):
        import pyspark

        part, count, held = pyspark.TaskContext.get().partitionId(), 0, []

        def leaf(rows):
            nonlocal count
            u = unit(np.frombuffer(b"".join(r["v"] for r in rows), dtype=kind).reshape(len(rows), -1))
            p = _leading(u, basis)
            centre, radius = _ball(u)
            weights = [r["n"] for r in rows]
            count += 1
            return {
                "part": part, "ordinal": count - 1, "reps": [r["rep"] for r in rows], "weights": weights, "v": b"".join(r["v"] for r in rows), "dim": rows[0]["dim"],
                "n": sum(weights), "centre": centre.tolist(), "radius": radius, "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist(),
            }

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and (len(held) == LEAF or held[0]["dim"] != row["dim"]):
                    out.append(leaf(held))
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_LEAF_SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([leaf(held)], schema=_LEAF_SCHEMA)

    return run


_LEAF_FIELDS = "part int, ordinal long, reps array<long>, weights array<long>, v binary, " + _STATS
_DOUBLES = pa.list_(pa.float64())
_LEAF_SCHEMA = pa.schema(
    [("part", pa.int32()), ("ordinal", pa.int64()), ("reps", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("v", pa.binary()),
     ("dim", pa.int32()), ("n", pa.int64()), ("centre", _DOUBLES), ("radius", pa.float64()), ("low", _DOUBLES), ("high", _DOUBLES)]
)


def _merged_stats(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """Box and ball around those of an interval's parts, at most ``LEAVES`` rows; none where lengths differ."""
    (up,) = key
    n = int(parts["n"].sum())
    if parts["dim"].nunique(dropna=False) > 1 or parts["centre"].isna().any():
        return pd.DataFrame([[up, None, n, None, None, None, None]], columns=_COLUMNS)
    c, r = np.stack(parts["centre"]), parts["radius"].to_numpy()
    centre = np.average(c, axis=0, weights=parts["n"])
    radius = float((np.sqrt(((c - centre) ** 2).sum(axis=1)) + r).max())
    low, high = np.stack(parts["low"]).min(axis=0), np.stack(parts["high"]).max(axis=0)
    return pd.DataFrame([[up, int(parts["dim"].iloc[0]), n, centre, radius, low, high]], columns=_COLUMNS)


_COLUMNS = ["id", *[f.split()[0] for f in _STATS.split(", ")]]


def _levels(pages: DataFrame) -> list[DataFrame]:
    """Pages, then intervals of ``FAN`` intervals each, up to the one interval that holds the sequence."""
    found = [staged(pages, "pages")]
    while found[-1].agg(F.max("id")).first()[0]:
        up = found[-1].withColumn("id", F.expr(f"id div {FAN}"))
        found.append(staged(up.groupBy("id").applyInPandas(_merged_stats, f"id long, {_STATS}"), "intervals"))
    return found


def _interval_pairs(levels: list[DataFrame], eps: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of pages to be compared, and pairs ``(level, a, b, na, nb)`` of intervals that are linked as a whole."""
    gap = f"sqrt(aggregate(sequence(0, {LEADING - 1}), 0D, (s, i) -> s + pow(greatest(0D, x.low[i] - y.high[i], y.low[i] - x.high[i]), 2)))"
    apart = "sqrt(aggregate(sequence(0, x.dim - 1), 0D, (s, i) -> s + pow(x.centre[i] - y.centre[i], 2)))"
    open_, whole = None, []
    for level in range(len(levels) - 1, -1, -1):
        part = levels[level].withColumn("up", F.expr(f"id div {FAN}"))
        x, y = part.withColumnRenamed("up", "up_a").alias("x"), part.withColumnRenamed("up", "up_b").alias("y")
        if open_ is None:
            # the one interval that holds the sequence, with itself
            met = x.join(y, F.col("x.id") == F.col("y.id"))
        else:
            met = open_.join(x, "up_a").join(y, "up_b").where("x.id <= y.id")
        # lengths that differ within an interval leave its ball unknown: such a pair goes on
        judged = met.select(
            F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"),
            F.expr(f"coalesce(x.dim <> y.dim, false) or coalesce({gap} > {eps + SLACK!r} or {apart} - x.radius - y.radius > {eps + SLACK!r}, false)").alias("distant"),
            F.expr(f"coalesce(x.dim = y.dim and if(x.id = y.id, 2 * x.radius, {apart} + x.radius + y.radius) <= {eps - SLACK!r}, false)").alias("near"),
        )
        judged = staged(judged.where("not distant"), "interval-pairs")
        whole.append(judged.where("near").select(F.lit(level).alias("level"), "a", "b", "na", "nb"))
        open_ = judged.where("not near").select(F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    for more in whole[1:]:
        whole[0] = whole[0].unionByName(more)
    return open_.toDF("a", "b"), whole[0]


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each link one label, the smaller one, in place."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


#: Pairs whose vectors are gathered at once.
_GATHER = 1 << 15


def _join_pages(eps: float, least: float, basis: np.ndarray, kind: str):
    """Links between the leaves of two pages: how many rows each class is linked with, and a forest that spans them."""

    def leaf_pairs(stats: dict, one: np.ndarray, two: np.ndarray):
        """Whether leaves are distant, and whether they are near as a whole."""
        c, r, low, high = stats["centre"], stats["radius"], stats["low"], stats["high"]
        apart = np.sqrt(np.maximum(((c[one][:, None] - c[two][None]) ** 2).sum(axis=2), 0))
        gap = np.sqrt((np.maximum(0, np.maximum(low[one][:, None] - high[two][None], low[two][None] - high[one][:, None])) ** 2).sum(axis=2))
        both = r[one][:, None] + r[two][None]
        span = np.where(one[:, None] == two[None], both, apart + both)
        return (gap > eps + SLACK) | (apart - both > eps + SLACK), span <= eps - SLACK

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("leaf")
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        leaf = table.column("leaf").to_numpy()
        dims, weight = table.column("dim").to_numpy(), [np.array(w, dtype=np.int64) for w in table.column("weights").to_pylist()]
        size = np.array([len(w) for w in weight])
        first = np.concatenate([[0], np.cumsum(size)])
        count, label = np.zeros(first[-1], np.int64), np.arange(first[-1])
        for dim in np.unique(dims):
            of = np.flatnonzero(dims == dim)
            u = {k: unit(np.frombuffer(table.column("v")[int(k)].as_py(), dtype=kind).reshape(size[k], -1)) for k in of}
            lead = {k: _leading(u[k], basis).astype(np.float32) for k in of}
            stats = {"centre": np.zeros((len(leaf), dim)), "radius": np.zeros(len(leaf)), "low": np.zeros((len(leaf), LEADING)), "high": np.zeros((len(leaf), LEADING))}
            for name, values in stats.items():
                values[of] = np.array([table.column(name)[int(k)].as_py() for k in of])
            one, two = (of[leaf[of] // LEAVES == page] for page in (a, b))
            if not len(one) or not len(two):
                continue
            distant, near = leaf_pairs(stats, one, two)
            for row, p in enumerate(one):
                here = np.arange(first[p], first[p + 1])
                later = two >= p if a == b else np.ones(len(two), bool)
                for q in two[near[row] & later]:
                    there = np.arange(first[q], first[q + 1])
                    count[here] += weight[q].sum()
                    if p != q:
                        count[there] += weight[p].sum()
                    _unite(label, np.append(here[1:], there), np.append(here[:-1], np.full(len(there), here[0])))
                left = two[~near[row] & ~distant[row] & later]
                if not len(left):
                    continue
                near_lead = np.concatenate([lead[q] for q in left])
                square = (lead[p] ** 2).sum(axis=1)[:, None] + (near_lead**2).sum(axis=1)[None] - 2 * (lead[p] @ near_lead.T)
                maybe = square <= np.float32(eps * eps + 1e-4)
                ends = np.cumsum([0] + [size[q] for q in left])
                for k, q in enumerate(left):
                    block = maybe[:, ends[k] : ends[k + 1]]
                    i, j = np.nonzero(block)
                    if not len(i):
                        continue
                    if len(i) * 16 > block.size:
                        i, j = np.nonzero(u[p] @ u[q].T >= least)
                    else:
                        cos = np.concatenate([np.einsum("ij,ij->i", u[p][i[s : s + _GATHER]], u[q][j[s : s + _GATHER]]) for s in range(0, len(i), _GATHER)])
                        i, j = i[cos >= least], j[cos >= least]
                    if p == q:
                        # a vector is always linked with itself, whatever rounding makes of it
                        i, j = np.append(i[i != j], np.arange(size[p])), np.append(j[i != j], np.arange(size[p]))
                    np.add.at(count, first[p] + i, weight[q][j])
                    if p != q:
                        np.add.at(count, first[q] + j, weight[p][i])
                    _unite(label, first[p] + i, first[q] + j)
        node = np.repeat(leaf << _SLOT, size) + np.arange(first[-1]) - np.repeat(first[:-1], size)
        found = count > 0
        return pa.table({"node": node[found], "linked": count[found], "root": node[label][found]})

    return run


def _whole_links(whole: DataFrame, nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Counts and edges of intervals that are linked as a whole: a row for each node and level, never for each pair."""
    counts, edges = [], []
    for level in range(depth):
        mine = whole.where(F.col("level") == level)
        sides = mine.select(F.col("a").alias("up"), F.col("nb").alias("more")).unionByName(mine.where("a <> b").select(F.col("b").alias("up"), F.col("na").alias("more")))
        bonus = sides.groupBy("up").agg(F.sum("more").alias("linked"))
        wide = LEAVES * FAN**level << _SLOT
        below = nodes.select("node", F.expr(f"node div {wide}L").alias("up")).join(bonus, "up")
        counts.append(below.select("node", "linked"))
        edges.append(below.select(F.col("node").alias("a"), (F.col("up") * wide).alias("b")))
        edges.append(mine.select((F.col("a") * wide).alias("a"), (F.col("b") * wide).alias("b")))
    for more in counts[1:]:
        counts[0] = counts[0].unionByName(more)
    for more in edges[1:]:
        edges[0] = edges[0].unionByName(more)
    return counts[0], edges[0]


def link_vectors(vectors: DataFrame, least: float = 0.95, column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, column, ...)``; links are cosines of ``least`` (0 to 1) and more.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the least vec_id that links
    reach, ``kept`` marks it. Defined cases: vectors that are null, empty or zero or hold null or non-finite
    entries are linked with nothing, nor are vectors of different lengths with each other; rows
    without vec_id are linked with nothing, have a null component and are kept; repeated rows are vectors
    of their own, linked with each other; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    usable = f"{{0}} is not null and vec_id is not null and size({{0}}) > 0 and forall({{0}}, c -> coalesce(abs(c) < double('infinity'), false)) and exists({{0}}, c -> c <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    if rows.schema["v"].dataType.elementType.typeName() != "float":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    good = F.coalesce(F.expr(usable.format("v")), F.lit(False))
    classes = staged(rows.where(good).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "v"), "classes")

    def alone(df: DataFrame) -> DataFrame:
        return df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    most = classes.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return alone(rows)

    eps, basis = math.sqrt(2 - 2 * least), _basis(classes, most["dim"])
    width = 4 if kind == "<f4" else 8
    size, page_bytes = most["count"] * width * most["dim"], LEAVES * LEAF * width * most["dim"]
    ordered = classes.mapInArrow(_placed(basis, eps, kind), _PLACED).repartitionByRange(partitions(spark, 2 * size), "place", "rep", "v").sortWithinPartitions("place", "rep", "v")
    runs = staged(ordered.mapInArrow(_leaves(basis, kind), _LEAF_FIELDS), "leaves")
    # leaves are numbered through: one row for each partition comes to the driver
    before, at = [], 0
    for part, count in sorted(map(tuple, runs.groupBy("part").count().collect())):
        before.append((part, at))
        at += count
    number = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    leaves = runs.join(number, "part").withColumn("leaf", F.col("before") + F.col("ordinal")).withColumn("page", F.expr(f"leaf div {LEAVES}")).drop("part", "before", "ordinal")
    stats = leaves.select(F.col("page").alias("id"), *_COLUMNS[1:]).groupBy("id").applyInPandas(_merged_stats, f"id long, {_STATS}")
    levels = _levels(stats)
    open_, whole = _interval_pairs(levels, eps)

    sides = open_.select("a", "b", F.col("a").alias("page")).unionByName(open_.where("a <> b").select("a", "b", F.col("b").alias("page")))
    tiles = leaves.select("page", "leaf", "weights", "v", "dim", "centre", "radius", "low", "high").join(sides, "page")
    spread = tiles.repartition(partitions(spark, open_.count() * 2 * min(page_bytes, size)), "a", "b")
    joined = staged(spread.groupBy("a", "b").applyInArrow(_join_pages(eps, least, basis, kind), "node long, linked long, root long"), "page-links")

    nodes = leaves.select("leaf", F.posexplode(F.arrays_zip("reps", "weights")).alias("slot", "c")).select(
        (F.shiftleft("leaf", _SLOT) + F.col("slot")).alias("node"), F.col("c.reps").alias("rep"), F.col("c.weights").alias("n")
    )
    nodes = staged(nodes, "nodes")
    more, edges = _whole_links(whole, nodes, len(levels))
    linked = joined.select("node", "linked").unionByName(more).groupBy("node").agg((F.sum("linked") - 1).alias("n_links")).where("n_links > 0")
    component = connected_components(joined.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges).distinct())
    reached = linked.join(component.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node")).join(nodes, "node")
    reached = staged(reached.select("node", "n", "rep", "n_links", "component"), "reached")
    least_id = reached.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = reached.join(least_id, "component").select("node", "n", "n_links", "component_id")
    # from nodes back to their vectors, and from these to rows; hot vectors are few and broadcast
    entry = leaves.select("leaf", "dim", "v").join(named.withColumn("leaf", F.shiftright("node", _SLOT)), "leaf")
    own = F.expr(f"substring(v, int(node % {1 << _SLOT}) * dim * {width} + 1, dim * {width})")
    found = staged(entry.select(own.alias("v"), "n", "n_links", "component_id").mapInArrow(_arrays(kind), f"v {rows.schema['v'].dataType.simpleString()}, n long, n_links long, component_id long"), "found")
    hits = join_counted(rows.where(good), found, ["v"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return hits.unionByName(alone(without_counted(rows.where(good), found, ["v"]))).unionByName(alone(rows.where(~good)))


def _arrays(kind: str):
    def run(batches):
        for batch in batches:
            parts = [np.frombuffer(b, dtype=kind) for b in batch.column(0).to_pylist()]
            ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(flat)), *batch.columns[1:]], names=batch.schema.names)

    return run


#: From the definition: all pairs, then all that is reachable.
ORACLE_SQL = """
with recursive unit as (
  select vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0
), pairs as (
  select x.vec_id as a, y.vec_id as b from unit x join unit y on x.vec_id <> y.vec_id and len(x.v) = len(y.v)
  where list_cosine_similarity(x.v, y.v) >= 0.95
), reach as (
  select vec_id as id, vec_id as r from unit
  union select reach.id, pairs.b from reach join pairs on pairs.a = reach.r
), least_of as (select id, min(r) as r from reach group by id), counted as (select a, count(*) as n from pairs group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(l.r, e.vec_id) as component_id, coalesce(e.vec_id = l.r, true) as kept
from embeddings e left join least_of l on l.id = e.vec_id left join counted c on c.a = e.vec_id
"""
