"""Product codes of vectors with VA-file filtering (operator 13).

Vectors of whole numbers are cut into ``parts`` equal pieces, and each part position has a codebook. To find a piece's
nearest entry, the coordinates of the entries are quantised to ``bits`` bits: along each dimension the range of the entries is cut into cells.
For each piece a lookup table holds, per dimension and cell, the least and the greatest squared distance that a coordinate in the
cell can have; their sums over an entry's cells bound its distance from below and above. Only entries whose lower bound is
not above the least upper bound are compared by exact integer distances (ties to the lower index).

Training is ``rounds`` passes over the vectors; each task sends count and sums per (part, entry) to a partial aggregate, and
the driver holds the codebooks (parts x entries x dimensions). Tasks hold a batch of rows.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped, and so are empty vectors and those
of another length than the first usable vector (that of the smallest vec_id, null last; then the shortest) whose length ``parts`` divides. Rows with the same vec_id are vectors
of their own; equal vec_ids among the first entries are ordered by their components. With fewer vectors than entries there are as many entries; without any
the result is empty. Components beyond +-2^27 after scaling are held there. Null labels are one group; label sums
beyond 2^63 - 1 are that number. Other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import materialize, release
from ._text import tidied
from ._vectors import group_sums, integers, number_kind, usable, whole, whole_numbers

#: Bits of a cell, and pieces whose tables are held at a time.
BITS, HELD = 3, 4096
#: Labels up to which their sums are broadcast (16 bytes and the label each); above, they are joined by a shuffle.
SMALL = 100_000
LONGEST = 2**63 - 1


class Cells:
    """The entries of one codebook (integers, a row each), with their coordinates in cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries.astype(np.int64)
        n, dims = entries.shape
        cells = 2**bits
        low, high = self.entries.min(axis=0), self.entries.max(axis=0)
        edges = low[:, None] + (high - low + 1)[:, None] * np.arange(cells + 1) // cells  # dims x (cells + 1)
        self.first, self.last = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
        cell = np.stack([np.searchsorted(edges[j, 1:], self.entries[:, j], side="right") for j in range(dims)], axis=1)
        self.pick = np.zeros((dims * cells, n))  # which cells an entry lies in
        self.pick[(np.arange(dims) * cells + cell).ravel(), np.repeat(np.arange(n), dims)] = 1

    def bounds(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance that each entry (column) can have, by way of the pieces' tables."""
        kind = number_kind(pieces, self.entries)
        x = pieces.astype(kind)[:, :, None]
        below, above = self.first.astype(kind) - x, x - self.last.astype(kind)
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(-below, -above)  # to the farther end of the cell
        pick = self.pick.astype(kind)
        return (least * least).reshape(len(x), -1) @ pick, (most * most).reshape(len(x), -1) @ pick

    def nearest(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, exact squared distance, distances computed)."""
        index, error, compared = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64), 0
        for a in range(0, len(pieces), HELD):
            own = pieces[a : a + HELD].astype(np.int64)
            least, most = self.bounds(own)
            row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
            gap = own[row] - self.entries[entry]
            away = np.full(least.shape, LONGEST, np.int64)
            away[row, entry] = np.einsum("ij,ij->i", gap, gap)
            index[a : a + HELD] = best = away.argmin(axis=1)
            error[a : a + HELD] = away[np.arange(len(own)), best]
            compared += len(row)
        return index, error, compared


def _books(codebooks: np.ndarray) -> list[Cells]:
    return [Cells(b) for b in codebooks]


def _whole(dims: int, scale: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, points = whole_numbers(batch.column(2), dims, scale)
            rows = batch.filter(pa.array(mask))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, dims, dtype=np.int32)), pa.array(points.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), flat], names=["vec_id", "label", "v"])

    return run


def _totals(codebooks: np.ndarray):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = codebooks.shape
        books = _books(codebooks)
        count, total = np.zeros((parts, entries), np.int64), np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            v = integers(batch.column(0), parts * width)
            for p, book in enumerate(books):
                pieces = v[:, p * width : (p + 1) * width]
                n, s = group_sums(pieces, book.nearest(pieces)[0], entries)
                count[p] += n
                total[p] += s
        part, entry, place = (a.ravel() for a in np.indices(codebooks.shape, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place), pa.array(count[part, entry]), pa.array(total.ravel())], names=["part", "entry", "place", "n", "total"])

    return run


def _encode(codebooks: np.ndarray):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = codebooks.shape
        books = _books(codebooks)
        for batch in batches:
            v = integers(batch.column(2), parts * width)
            code, error = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
            for p, book in enumerate(books):
                code[:, p], e, _ = book.nearest(v[:, p * width : (p + 1) * width])
                error += e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def encode(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label of each usable vector; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{label_column}`").alias("label"), F.col(f"`{vector_column}`").alias("vector"))
    kept = rows.where(usable("vector") & (F.size("vector") % parts == 0))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.size("vector")).select(F.size("vector").alias("n")).first()
    out = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    result = ["vec_id", "code", "error", "label_error", "codebooks_sha256", "label"]
    if first is None:
        return spark.createDataFrame([], out).withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")}).select(*result)
    dims = first.n
    seeds = kept.where(F.size("vector") == dims).select("vec_id", whole("vector", scale).alias("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    codebooks = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2)
    numbers = materialize(rows.mapInArrow(_whole(dims, scale), T.StructType([*out.fields[:2], T.StructField("v", T.ArrayType(T.IntegerType()))])), "whole-vectors")
    for _ in range(rounds):
        sums = numbers.select("v").mapInArrow(_totals(codebooks), "part int, entry int, place int, n long, total long")
        moved = codebooks.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect():  # as many as the codebooks have numbers
            moved[r.part, r.entry, r.place] = r.total // r.n
        if (moved == codebooks).all():
            break
        codebooks = moved
    name = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    coded = materialize(numbers.mapInArrow(_encode(codebooks), out), "vector-codes")
    release(numbers)
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    per_label = materialize(coded.groupBy(F.col("label").alias("same")).agg(total.alias("label_error")), "label-errors")
    few = per_label.count() <= SMALL
    joined = coded.join(F.broadcast(per_label) if few else per_label, F.col("label").eqNullSafe(F.col("same")))
    return joined.withColumn("codebooks_sha256", F.lit(name)).select(*result)
