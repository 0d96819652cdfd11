"""Operators 11 and 13 against brute force in whole numbers, and the bounds they prune by."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cdm_engine.llm import ball_tree, vector_codes
from cdm_engine.llm._vectors import LIMIT, squared
from cdm_engine.llm.ball_tree import BallTree

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, id string, vector string, code string"


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(i, v, k, 7, "x", "y", "z") for i, v, k in rows], SCHEMA)


def _f32(v):
    return np.array(v, np.float32).astype(float).tolist()


def _kept(rows, scale, dims):
    out = []
    for i, v, k in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(max(-LIMIT, min(LIMIT, scale * x))) for x in _f32(v)], k))
    return out


def _means(groups, before):
    return [[sum(c) // len(g) for c in zip(*g)] if g else b for g, b in zip(groups, before)]


def _distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def _nearest(v, entries):
    return min((_distance(v, e), k) for k, e in enumerate(entries))


def _clusters(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = _kept(rows, scale, dims)
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [v for _, v, _ in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v, _ in kept:
            groups[_nearest(v, centroids)[1]].append(v)
        centroids = _means(groups, centroids)
    found = [(i, *_nearest(v, centroids)) for i, v, _ in kept]
    per = [sum(d for _, d, c in found if c == j) for j in range(len(centroids))]
    return sorted(((i, c, d, per[c], sum(per), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found), key=repr)


def _codes(rows, parts=8, entries=16, rounds=6, dims=64, scale=4096):
    kept = _kept(rows, scale, dims)
    w = dims // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for _, v, _ in kept:
                groups[_nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = _means(groups, books[p])
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = []
    for i, v, k in kept:
        near = [_nearest(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), k))
    total = {}
    for _, _, d, k in found:
        total[k] = total.get(k, 0) + d
    return sorted(((i, c, d, total[k], name) for i, c, d, k in found), key=repr)


def _rows(rng, n, spread=0.1):
    """Tight groups, ties, copies, rows to leave out, repeated and null ids."""
    centre = rng.normal(size=(5, 64))
    out = [(i, (centre[i % 5] + rng.normal(size=64) * spread).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    out += [(i % 4, [0.25] * 64, 1) for i in range(n // 3)]  # a hot vector with repeated ids
    out += [(None, [0.5] * 64, 2), (None, [-0.5] * 64, None), (900, None, 1), (901, [], 1), (902, [1.0] * 63, 1), (903, [1.0] * 63 + [None], 1)]
    out += [(904, [math.nan] + [0.0] * 63, 1), (905, [math.inf] + [0.0] * 63, 1), (906, [1e-3] * 64, 1), (907, [0.0] * 65, 2)]
    return out


def _got(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


CLUSTER = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
CODE = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("n,spread", [(150, 0.01), (120, 1.0), (3, 0.1)])
def test_clusters_equal_brute_force(make, n, spread):
    rows = _rows(np.random.default_rng(n), n, spread)
    assert _got(ball_tree.cluster(make(rows).repartition(3)), CLUSTER) == _clusters(rows)


@pytest.mark.parametrize("n,spread", [(150, 0.01), (120, 1.0), (3, 0.1)])
def test_codes_equal_brute_force(make, n, spread):
    rows = _rows(np.random.default_rng(n), n, spread)
    assert _got(vector_codes.encode(make(rows).repartition(3)), CODE) == _codes(rows)


def test_clusters_over_several_trees(make, monkeypatch):
    monkeypatch.setattr(ball_tree, "BLOCK", 40)
    rows = _rows(np.random.default_rng(1), 200, 0.02)
    assert _got(ball_tree.cluster(make(rows).repartition(2)), CLUSTER) == _clusters(rows)


def test_huge_components_are_held(make):
    rows = [(i, [3e38 * (-1) ** (i + j) for j in range(64)], 1) for i in range(20)] + [(20 + i, [float(i)] * 64, 1) for i in range(20)]
    found = _clusters(rows)
    assert _got(ball_tree.cluster(make(rows)), CLUSTER) == found
    assert _got(vector_codes.encode(make(rows)), CODE) == _codes(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [1.0], 1), (3, [math.nan] * 64, None)]])
def test_nothing_usable(make, rows):
    assert ball_tree.cluster(make(rows)).collect() == []
    out = vector_codes.encode(make(rows))
    assert out.collect() == [] and set(CODE) <= set(out.columns)


def test_other_lengths_of_codes(make):
    rows = [(i, [i / 8 + j for j in range(16)], None) for i in range(40)]
    assert _got(vector_codes.encode(make(rows)), CODE) == _codes(rows, dims=16)
    rows += [(99, [0.0] * 24, 1)]  # another length than that of the smallest vec_id
    assert _got(vector_codes.encode(make(rows)), CODE) == _codes(rows, dims=16)


def test_many_labels_are_joined_by_a_shuffle(make, monkeypatch):
    monkeypatch.setattr(vector_codes, "SMALL", 0)
    rows = _rows(np.random.default_rng(5), 60)
    assert _got(vector_codes.encode(make(rows)), CODE) == _codes(rows)


def test_tight_balls_go_whole():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-5, 5, (200, 8)) + c for c in (-1000, 0, 1000)])
    tree, order = BallTree.build(points)
    assert sorted(order.tolist()) == list(range(600)) and (tree.points == points[order]).all()
    assert tree.count[0] == 600 and (tree.sums[0] == points.sum(axis=0)).all()
    label, count, total, in_balls = tree.assign(np.array([[-1000] * 8, [0] * 8, [1000] * 8]))
    assert in_balls > 500 and count.tolist() == [200, 200, 200]
    assert (label == squared(tree.points, np.array([[-1000] * 8, [0] * 8, [1000] * 8])).argmin(axis=1)).all()


vectors = st.lists(st.lists(st.integers(-20, 20), min_size=3, max_size=3), min_size=1, max_size=90)


@settings(max_examples=60, deadline=None)
@given(vectors, vectors)
def test_trees_assign_like_all_distances(points, centroids):
    points, centroids = np.array(points), np.array(centroids[:6])
    tree, _ = BallTree.build(points)
    label, count, total, _ = tree.assign(centroids)
    right = np.array([_nearest(p, centroids.tolist())[1] for p in tree.points.tolist()])
    assert (label == right).all()
    for c in range(len(centroids)):
        assert count[c] == (right == c).sum() and (total[c] == tree.points[right == c].sum(axis=0)).all()


@settings(max_examples=60, deadline=None)
@given(vectors, vectors, st.integers(1, 5))
def test_bounds_hold_and_cells_decide_like_all_distances(entries, pieces, bits):
    entries, pieces = np.array(entries), np.array(pieces)
    cells = vector_codes.Cells(entries, bits)
    least, most = cells.bounds(pieces)
    away = squared(pieces, entries)
    assert (least <= away).all() and (away <= most).all()
    index, error, compared = cells.nearest(pieces)
    assert (index == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all() and compared <= away.size


def test_cells_filter():
    rng = np.random.default_rng(2)
    entries, pieces = rng.integers(-2000, 2000, (16, 8)), rng.integers(-2000, 2000, (500, 8))
    assert vector_codes.Cells(entries).nearest(pieces)[2] < 500 * 16 / 2
