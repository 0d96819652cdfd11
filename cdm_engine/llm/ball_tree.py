"""Centroid clustering by ball-tree filtering (operator 11).

Each task builds metric trees over its own vectors, up to ``BLOCK`` in a tree, and the trees are written once. A node is a
ball: radius, count and integer sum of its vectors (the centre is sum / count); its two children are the
halves along the line between two far points. In a round a tree is walked from its root with all centroids: if, by the
triangle inequality, one centroid is nearer to every point of a ball than any other, the whole ball goes to it
with its count and sum; otherwise its children are tried, and what reaches the leaves is assigned vector by vector by
exact integer distances. Balls are given away only when one centroid is strictly nearer by more than rounding, so that ties are always
judged exactly (the smaller number wins).

A round sends ``k`` sums and counts from each task to a partial aggregate; the driver holds the ``k`` centroids. Rounds end
early when no centroid moves, as nothing would change any more.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out. Rows
with the same vec_id are vectors of their own; a null vec_id is never a first centroid unless there are too few others. First centroids with equal
hashes are ordered by their components. With fewer than ``k`` vectors there are as many centroids; without any the result
is empty. Components beyond +-2^27 after scaling are held there; inertias beyond 2^63 - 1 are that number. Other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release
from ._text import tidied
from ._vectors import LIMIT, group_sums, squared, usable, whole, whole_numbers

#: Vectors in a tree, and in a leaf at most.
BLOCK, LEAF = 2048, 16
TREE = "ids array<long>, points binary, radius binary, sums binary"
LONGEST = 2**63 - 1


def levels(n: int) -> int:
    """Levels below the root of a tree of n vectors."""
    return max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))


def ranges(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the vectors of each node begin and end; node j has the children 2j + 1 and 2j + 2."""
    lo, hi = [np.zeros(1, np.int64)], [np.full(1, n, np.int64)]
    for _ in range(levels(n)):
        middle = (lo[-1] + hi[-1] + 1) // 2
        a, b = np.stack([lo[-1], middle], axis=1).ravel(), np.stack([middle, hi[-1]], axis=1).ravel()
        lo.append(a)
        hi.append(b)
    return np.concatenate(lo), np.concatenate(hi)


class BallTree:
    """``points`` in the order of the leaves, ``radius`` and integer ``sums`` of the nodes."""

    def __init__(self, points: np.ndarray, radius: np.ndarray, sums: np.ndarray):
        self.points, self.radius, self.sums = points, radius, sums
        self.lo, self.hi = ranges(len(points))
        self.count = self.hi - self.lo
        self.first_leaf = 2 ** levels(len(points)) - 1

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[BallTree, np.ndarray]:
        """(a tree of at least one integer point, the points' new order)."""
        x = points.astype(np.float64)  # sums of a tree are exact in doubles
        order = np.arange(len(x))
        lo, hi = ranges(len(x))
        inner = 2 ** levels(len(x)) - 1
        radius, sums = np.zeros(len(lo)), np.zeros((len(lo), x.shape[1]), np.int64)
        for node, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            own = x[order[a:b]]
            total = own.sum(axis=0)
            sums[node] = total.astype(np.int64)
            away = ((own - total / (b - a)) ** 2).sum(axis=1)
            radius[node] = np.sqrt(away.max())
            if node < inner:
                one = own[away.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                half = (b - a + 1) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (other - one), half - 1)]
        return cls(points[order], radius, sums), order

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(nearest centroid of each point, count and sum of each centroid's points, points that went in whole balls)."""
        k = len(centroids)
        label = np.zeros(len(self.points), np.int64)
        count, total = np.zeros(k, np.int64), np.zeros((k, self.points.shape[1]), np.int64)
        nodes, leaves, in_balls = np.zeros(1, np.int64), [], 0
        c = centroids.astype(np.float64)
        while len(nodes):
            centre = self.sums[nodes] / self.count[nodes, None]
            away = np.sqrt(((centre[:, None, :] - c) ** 2).sum(axis=2))
            best = away.argmin(axis=1)
            near = away[np.arange(len(nodes)), best]
            away[np.arange(len(nodes)), best] = np.inf
            second = away.min(axis=1)
            slack = 1e-6 + 1e-9 * (near + np.abs(centre).max(axis=1) + self.radius[nodes])  # more than rounding
            clear = near + self.radius[nodes] + slack < second - self.radius[nodes]
            for node, owner in zip(nodes[clear].tolist(), best[clear].tolist(), strict=True):
                label[self.lo[node] : self.hi[node]] = owner
                count[owner] += self.count[node]
                total[owner] += self.sums[node]
                in_balls += int(self.count[node])
            nodes = nodes[~clear]
            leaves += nodes[nodes >= self.first_leaf].tolist()
            nodes = nodes[nodes < self.first_leaf]
            nodes = np.concatenate([2 * nodes + 1, 2 * nodes + 2])
        if leaves:
            at = np.concatenate([np.arange(self.lo[n], self.hi[n]) for n in leaves])
            own = self.points[at]
            label[at] = squared(own, centroids).argmin(axis=1)
            more, sums = group_sums(own, label[at], k)
            count += more
            total += sums
        return label, count, total, in_balls


def _build(dims: int, scale: int):
    def row(ids: list, points: np.ndarray) -> pa.RecordBatch:
        tree, order = BallTree.build(points)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([[ids[i] for i in order.tolist()]], pa.list_(pa.int64())),
                pa.array([tree.points.astype("<i4").tobytes()], pa.binary()),
                pa.array([tree.radius.astype("<f8").tobytes()], pa.binary()),
                pa.array([tree.sums.astype("<i8").tobytes()], pa.binary()),
            ],
            names=["ids", "points", "radius", "sums"],
        )

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held = np.zeros((0, dims), np.int64)
        for batch in batches:
            mask, points = whole_numbers(batch.column(1), dims, scale)
            ids += batch.column(0).filter(pa.array(mask)).to_pylist()
            held = np.concatenate([held, points])
            full = len(held) - len(held) % BLOCK
            for a in range(0, full, BLOCK):
                yield row(ids[a : a + BLOCK], held[a : a + BLOCK])
            ids, held = ids[full:], held[full:]
        if ids:
            yield row(ids, held)

    return run


def trees_of(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """A row for each tree over the usable vectors of (id, vector)."""
    return rows.mapInArrow(_build(dims, scale), TREE)


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, BallTree]]:
    ids, *blobs = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "points", "radius", "sums"))
    for i in range(batch.num_rows):
        points, radius, sums = (np.frombuffer(b[i].as_buffer(), kind) for b, kind in zip(blobs, ("<i4", "<f8", "<i8"), strict=True))
        yield ids[i].values, BallTree(points.reshape(-1, dims), radius, sums.reshape(-1, dims))


def _totals(centroids: np.ndarray):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        count, total, balls = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for batch in batches:
            for _, tree in _read(batch, dims):
                _, n, s, b = tree.assign(centroids)
                count, total, balls = count + n, total + s, balls + b
        cluster, place = np.divmod(np.arange(k * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(count[cluster]), pa.array(total.ravel())], names=["cluster", "place", "n", "total"])

    return run


def _labels(centroids: np.ndarray):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _read(batch, centroids.shape[1]):
                label = tree.assign(centroids)[0]
                away = np.empty(len(label), np.int64)
                for c in np.unique(label).tolist():
                    away[label == c] = squared(tree.points[label == c], centroids[c : c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(away)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The vectors of (id, vector) whose ids have the k smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    kept = rows.where(usable("vector", dims)).select(name.alias("name"), whole("vector", scale).alias("v"))
    found = kept.orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, cluster_size of each usable vector."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("vector"))
    centroids = first_centroids(rows, k, dims, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    trees = materialize(trees_of(rows, dims, scale), "ball-trees")
    for _ in range(rounds):
        sums = trees.select("ids", "points", "radius", "sums").mapInArrow(_totals(centroids), "cluster int, place int, n long, total long")
        moved = centroids.copy()
        for r in sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect():  # k rows of dims
            moved[r.cluster, r.place] = r.total // r.n
        if (moved == centroids).all():
            break
        centroids = moved
    labels = materialize(trees.mapInArrow(_labels(centroids), "vec_id long, cluster int, distance long"), "clusters")
    release(trees)
    capped = lambda c: F.least(c, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    per = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum"), F.count(F.lit(1)).alias("cluster_size")).collect()  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = sum(r["sum"] for r in per)
    small = vectors.sparkSession.createDataFrame([(r.cluster, r["sum"], total, names[r.cluster], r.cluster_size) for r in per], "cluster int, a decimal(38,0), b decimal(38,0), centroid_sha256 string, cluster_size long")
    small = small.select("cluster", capped(F.col("a")).alias("cluster_inertia"), capped(F.col("b")).alias("inertia"), "centroid_sha256", "cluster_size")
    return labels.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")


assert BLOCK * LIMIT < 2**53
