"""Fill-in-the-middle, whitening and vector links against brute force, on a small folder and on hand-made edge cases."""

import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, same_rows
from tidemark.llm import entries, middle, vectors, whitening

VECTORS = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def unit_list(text):
    """Units one character after another, without the regex library."""
    out, run = [], []
    for c in text:
        if "a" <= c <= "z" or "A" <= c <= "Z":
            run.append(c)
            continue
        out += (["".join(run)] if run else []) + [c]
        run = []
    return out + (["".join(run)] if run else [])


def rewritten(doc_id, text):
    units, h = unit_list(text), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_middle(spark, duck):
    name = "op11_fill_in_middle"
    none = lambda df: df.astype(object).where(df.notna(), None)
    got = none(entries.queries()[name](spark, SMALL).toPandas())
    same_rows(got, none(duck.execute(entries.oracle_sql()[name]).df()))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in got.itertuples():
        *want, output = rewritten(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == want
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(texts[r.doc_id]))
    assert set(got.form) == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(spark):
    texts = [None, "", "a", "<<<", "<S<M><P", "x<P>y", "日本 word\r\né", "a" * 20_000, "1 " * 5_000, "< <S", "<"]
    rows = [(i, t, 1) for i in range(40) for t in texts] + [(None, "no id", 1), (5, "a", 1), (5, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({"form": F.lit("x"), "output": F.lit(2)})
    found = middle.fill_in_middle(docs).withColumn("back", middle.restored("output", "form"))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found.collect()), key=repr)
    want = sorted(((i, *rewritten("" if i is None else i, t or ""), t or "") for i, t, _ in rows), key=repr)
    assert got == want
    assert middle.middle_digests(docs.limit(0)).count() == 0


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


def check_whitened(rows, vecs, components=4):
    """All columns of a result against exact integers, Fraction sums and numpy's singular vectors."""
    kept = [(i, tuple(int(np.floor(256 * np.float64(c))) for c in v)) for i, v in vecs]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    _, s, axes = np.linalg.svd(centre, full_matrices=False)
    values, trace = s**2 / n, (centre**2).sum() / n
    assert len(rows) == len(kept) * min(components, len(sums))
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, x in kept:
        y = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, sums)])
        for k in range(min(components, len(sums))):
            found = by[i, k + 1]
            exact = sum((n * a - b) ** 2 for a, b in zip(x, sums))
            assert all((r.n, r.deviation_exact) == (n, str(exact)) and r.deviation == (exact if exact < 1 << 63 else None) for r in found)
            if values[k] < 1e-9 * trace:
                assert all(r.whitened is None for r in found)
                continue
            want = y @ axes[k] / np.sqrt(values[k])
            if abs(want) > 1e-3 and k not in signs and len(found) == 1:
                signs[k] = np.sign(want) * np.sign(found[0].whitened)
            assert any(abs(r.whitened - want * signs.get(k, 1)) < 1e-6 * max(1, abs(want)) for r in found)
            assert all(abs(r.explained - values[k] / trace) < 1e-4 * values[k] / trace and r.identity_error < 1e-4 for r in found)


def test_whitening(spark):
    got = entries.queries()["op12_embedding_whitening"](spark, SMALL).collect()
    check_whitened(got, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()])


def test_whitening_edges(spark):
    r = np.random.default_rng(1)
    good = [(k, (r.normal(size=5) * [5, 4, 3, 2, 1]).tolist()) for k in range(60)] + [(60, [1e3, -1e3, 0.0, -0.0, 3.0])]
    repeated = good + [(100 + k, good[0][1]) for k in range(50)] + [(100, good[0][1])]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [NAN, 1.0, 2.0, 3.0, 4.0]), (904, [INF, 1.0, 2.0, 3.0, 4.0]), (905, [1.0, 2.0])]
    rows = [(i, v, 0) for i, v in repeated + bad]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"n": F.lit("x"), "x": F.lit(1), "component": F.lit(2)}).repartition(7)
    check_whitened(whitening.whiten(df).collect(), repeated)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id in (900, 901, 903)")).count() == 0
    # exact where 64 bits do not hold the squares, and the nearest long where they do not hold the entry
    wide = [(1, [1e15, 2.0]), (2, [-1e15, 1.0]), (3, [0.0, 0.5])]
    check_whitened(whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in wide], VECTORS), components=1).collect(), wide, 1)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300], 0), (2, [0.0], 0)], VECTORS)).collect()
    assert {r.deviation_exact for r in huge} == {str((2**63 - 1) ** 2)} and all(r.deviation is None for r in huge)
    # one vector only: no direction has variance
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 4


def brute_links(rows, least=0.95):
    """``(vec_id, n_links, component_id, kept)`` of each row, from all pairs."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and usable(v) and any(v)]
    scaled = {k: np.array(rows[k][1], dtype=float) / max(map(abs, rows[k][1])) for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in scaled.items()}
    near = {k: [] for k in range(len(rows))}
    for dim in {len(unit[k]) for k in ok}:
        of = [k for k in ok if len(unit[k]) == dim]
        cos = np.stack([unit[k] for k in of]) @ np.stack([unit[k] for k in of]).T
        assert not (np.abs(cos - least) < 1e-12).any()
        for x, y in zip(*np.nonzero(cos >= least)):
            if x != y:
                near[of[x]].append(of[y])
    label = {k: k for k in ok}
    changed = True
    while changed:
        changed = False
        for k in ok:
            low = min([label[k], *(label[j] for j in near[k])])
            changed, label[k] = changed or low < label[k], low
    least_id = {}
    for k in ok:
        least_id[label[k]] = min(least_id.get(label[k], rows[k][0]), rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        component = least_id[label[k]] if k in label else i
        out.append((i, len(near[k]), component, i is None or component == i))
    return sorted(out, key=repr)


def linked(df, **kw):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.link_vectors(df, **kw).collect()), key=repr)


def test_links_on_given_tables(spark, duck):
    name = "op13_embedding_near_dedup"
    same_rows(entries.queries()[name](spark, SMALL).toPandas(), duck.execute(entries.oracle_sql()[name]).df())


@pytest.fixture(scope="module")
def families():
    """Background, tight and loose groups, chains, equal vectors (a third of all), scaled ones, and what links with nothing."""
    r = np.random.default_rng(7)
    normal = lambda m: r.normal(size=(m, 24)) / np.sqrt(24)
    base = normal(6)
    groups = [base[0] + normal(300) * 0.02, base[1] + normal(150) * 0.22, base[2] + normal(200) * 0.3]
    steps = np.linspace(0, 1, 40)[:, None]
    chain = base[3] * (1 - steps) + base[4] * steps
    floats = np.concatenate([normal(500), *groups, chain, base[:1] * [[3.0]], base[:1] * 1e-200, base[5:] * 1e200, np.repeat(base[5:], 600, axis=0)])
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(len(floats)), floats)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [NAN] + [1.0] * 23, [INF] + [1.0] * 23, [1.0, 2.0], [1.0, 2.0], [2.0, 1.0], [1.0]]
    return rows + [(5000 + k, v) for k, v in enumerate(odd)] + [(None, floats[0].tolist()), (7, floats[3].tolist()), (7, floats[3].tolist())]


def test_links_of_families(spark, families, monkeypatch):
    df = spark.createDataFrame([(i, v, 0) for i, v in families], VECTORS).withColumns({"v": F.lit("x"), "n": F.lit(1), "rep": F.lit(2), "page": F.lit(3)})
    want = brute_links(families)
    assert max(n for _, n, _, _ in want) >= 600
    assert linked(df) == want
    # leaves, pages and intervals so small that all levels of the recursion have work to do
    for name, value in (("LEAF", 8), ("LEAVES", 2), ("FAN", 3)):
        monkeypatch.setattr(vectors, name, value)
    assert linked(df.repartition(9)) == want
    assert linked(df, least=0.6) == brute_links(families, 0.6)


def test_intervals_linked_as_a_whole(spark, monkeypatch):
    """A tight group of thousands is linked by intervals: no page pairs are left of it."""
    r = np.random.default_rng(3)
    rows = [(k, (np.ones(8) + r.normal(size=8) * 0.01).tolist(), 0) for k in range(3000)]
    monkeypatch.setattr(vectors, "LEAF", 16)
    seen = []
    real = vectors._interval_pairs
    monkeypatch.setattr(vectors, "_interval_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    got = linked(spark.createDataFrame(rows, VECTORS))
    assert [(n, c) for _, n, c, _ in got] == [(2999, 0)] * 3000
    assert seen[0][0].count() == 0 and seen[0][1].count() < 10


def test_links_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 0), (None, [1.0], 0)], VECTORS)
    assert linked(df) == [(1, 0, 1, True), (None, 0, None, True)]
    assert linked(df.limit(0)) == []
