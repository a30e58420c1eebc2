"""Hard negatives and vector codes against plain loops over all rows."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from lodestack.llm import negatives, quantize
from lodestack.llm.queries import oracle_sql, queries
from lodestack.llm.tables import table

FIELDS = "vec_id long, embedding array<float>, label int, q string, code int, block long"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], n, "x", 1, 2) for i, v, n in rows], FIELDS)


def sample(seed, n=700, size=16, labels=4):
    """Clusters, copies of one vector for a third of the rows, and ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (6, size))
    x = (centres[rng.integers(0, 6, n)] + rng.normal(0, 0.1, (n, size))).astype(np.float32)
    x[::3] = x[0]
    x[1::50] = np.round(x[1::50] * 2) / 2
    return [(int(i), x[j].tolist(), int(rng.integers(0, labels))) for j, i in enumerate(rng.permutation(3 * n)[:n])]


ODD = [(None, [1.0, 2.0], 1), (5, None, 1), (6, [1.0, None], 1), (8, [NAN, 1.0], 1), (9, [INF, 0.0], 2), (10, [], 1), (11, [0.5], None), (100, [0.5, 0.25, 1e30], 1), (200, [0.5, 0.25], 1), (200, [0.5, 0.25], 1), (13, [0.5, 0.25], 2), (15, [0.4, 0.25], 1), (300, [-1.0, -1.0], 3), (16, [1.0, 1.0], 3)]


def whole(v, scale, size, limit):
    return [int(min(limit, max(-limit, math.floor(min(max(float(np.float32(x)) * scale, -1e300), 1e300))))) for x in v] + [0] * (size - len(v))


def kept(rows):
    return [(i, v, n) for i, v, n in rows if v is not None and all(x is not None and math.isfinite(float(np.float32(x))) for x in v)]


def hard(rows, every=100):
    good = [(i, v, n) for i, v, n in kept(rows) if i is not None and n is not None]
    size = max([1, *(len(v) for _, v, _ in good)])
    one = {}
    for i, v, n in good:
        x = whole(v, 256, size, negatives._limit(size))
        one[i] = min(one.get(i, (n, x)), (n, x))
    one = {i: ((n + 1) % 10 if i % 7 == 0 else n, x) for i, (n, x) in one.items()}
    score = lambda a, b: sum(p * q for p, q in zip(one[a][1], one[b][1], strict=True))
    out = set()
    for a in one:
        if a % every:
            continue
        ranked = sorted((-score(a, b), b) for b in one if b != a)
        for s, p in [(-s, b) for s, b in ranked if one[b][0] == one[a][0]][:5]:
            found = [(b, -t) for t, b in ranked if one[b][0] != one[a][0] and 80 * s <= -100 * t <= 100 * s][:5]
            out |= {(a, p, r, b, s, t) for r, (b, t) in enumerate(found, 1)}
    return out


def mined(spark, rows, **more):
    return {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in negatives.mine(frame(spark, rows), **more).collect()}


@pytest.mark.parametrize(("block", "leaves"), [(1024, 1024), (16, 1024), (8, 4)])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, block, leaves):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "LEAVES", leaves)
    rows = sample(block)
    want = hard(rows, 10)
    assert mined(spark, rows, every=10) == want and len(want) > 500


def test_hard_negatives_of_edge_rows(spark):
    assert mined(spark, ODD) == hard(ODD) and {a for a, *_ in hard(ODD)} >= {100, 200}
    assert mined(spark, []) == set() and mined(spark, ODD[:1]) == set()


def test_the_tree_passes_over_what_cannot_be_among_the_first():
    """Bounds hold for every row, and leave leaves out where vectors lie in clusters."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(0, 1, (12, 8))[rng.integers(0, 12, 4000)] + rng.normal(0, 0.02, (4000, 8))))
    top = float((x * x).sum(1).max())
    tree = negatives.Tree(x[::5], 5, top)
    leaf, way = tree.route(x)
    names = np.unique(leaf)
    ranges = negatives.Ranges(tree, names, *(np.stack([f(way[leaf == n], 0) for n in names]) for f in (np.min, np.max)))
    near, most, last = ranges.bounds(x[:50])
    far = np.sqrt(np.maximum(0, (x[:50] ** 2).sum(1)[:, None] + top - 2 * x[:50] @ x.T))
    for j, n in enumerate(names):
        assert (far[:, leaf == n] >= near[:, j : j + 1] - 1e-3).all() and (far[:, leaf == n] <= most[:, j : j + 1] + 1e-3).all()
    best = np.sort(far, 1)[:, 4]
    assert (near > best[:, None] + 1e-3).mean() > 0.3


def lloyd(rows, rounds=6):
    good = kept(rows)
    if not good:
        return set()
    width = max(1, -(-max(len(v) for _, v, _ in good) // 8))
    x = [whole(v, 4096, 8 * width, quantize._limit(width)) for _, v, _ in good]
    order = sorted(range(len(good)), key=lambda j: (good[j][0] is None, good[j][0] or 0, x[j]))[:16]
    books = [[x[j][p * width : (p + 1) * width] for j in order] for p in range(8)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    assign = lambda: [[min((far(v[p * width : (p + 1) * width], e), j) for j, e in enumerate(books[p])) for p in range(8)] for v in x]
    for _ in range(rounds):
        codes = assign()
        for p in range(8):
            for e in range(len(order)):
                mine = [v[p * width : (p + 1) * width] for v, c in zip(x, codes, strict=True) if c[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    codes = assign()
    error = [sum(d for d, _ in c) for c in codes]
    label = {}
    for (_, _, n), e in zip(good, error, strict=True):
        label[n] = label.get(n, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for _, c in cs), e, label[n], digest) for (i, _, n), cs, e in zip(good, codes, error, strict=True))


def compressed(spark, rows):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in quantize.compress(frame(spark, rows)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_vector_codes_equal_plain_rounds(spark, seed):
    rows = sample(seed, 250)
    assert compressed(spark, rows) == lloyd(rows)


def test_vector_codes_of_edge_rows(spark):
    assert compressed(spark, ODD) == lloyd(ODD)
    assert compressed(spark, []) == [] and compressed(spark, [(1, None, 1), (2, [NAN], 1)]) == []


def test_bounds_are_kept_and_save_distances():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 400, (3000, 8)))
    books = x[:16].copy()
    group = quantize.grouped(books)
    b, done = quantize.first_bounds(x, books, group), 0
    for step in range(12):
        entry = quantize.squares(x, books).argmin(1)
        assert (entry == b.entry).all()
        far = np.sqrt(quantize.squares(x, books))
        assert (b.upper >= far[np.arange(len(x)), entry]).all()
        far[np.arange(len(x)), entry] = np.inf
        assert all((b.lower[:, g] <= far[:, group == g].min(1, initial=np.inf)).all() for g in range(group.max() + 1))
        new = np.stack([np.floor(x[entry == e].mean(0)) if (entry == e).any() else books[e] for e in range(16)])
        done += quantize.moved_bounds(x, new, group, np.sqrt(((new - books) ** 2).sum(1)) * (1 + 1e-12), b)
        books = new
    assert done < 0.9 * 12 * x.shape[0] * 16


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    want = duckdb.sql(oracle_sql()[name])
    found = queries()[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(want.columns) and table(spark, sf_dir, "embeddings").count() > 0
    columns = sorted(want.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want.project(", ".join(columns)).fetchall())
