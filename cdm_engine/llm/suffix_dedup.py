"""Suffix-array dedup by bucket-pointer refinement (operator 9).

Every byte covered by a ``width``-byte string that also starts anywhere else is found. ``_repeats`` describes the
refinement: initial q-gram buckets, refined by the bucket identifiers of later offsets, each level reusing the
identifiers of the one below; buckets with one member drop out at every level.

The published algorithm keeps a bucket pointer for every suffix of one text in memory. Here only the suffixes
that represent windows (some 1.5 % of bytes) become rows of a distributed table, which gives the same spans; README has the
figures of a pointer for each suffix. Identifiers are 64 bits a level; two levels, 128 bits, decide.

Defined cases: null text counts as empty and stays so; texts shorter than ``width`` bytes keep all;
overlapping repeats inside one text count; rows with equal doc_id are separate documents; an empty
table gives an empty table; other columns, whatever their names, pass through ``cut_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import Unit, cover, unpack, with_runs
from ._rows import KEY, keyed, texts_of, whole, with_text
from ._text import buffers, tidied


def _masks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bytes, which of them go) of each row."""
    data, off = buffers(texts_of(batch))
    ptr, lo, n = unpack(batch)
    for i in range(batch.num_rows):
        a, b = ptr[i], ptr[i + 1]
        size = int(off[i + 1] - off[i])
        gone = cover(size, lo[a:b], n[a:b], width) if b > a else np.zeros(size, bool)
        yield i, data[off[i] : off[i + 1]], gone


def _digests(width: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(d), int(g.sum()), int((g[1:] & ~g[:-1]).sum()) + int(g[:1].any()), hashlib.sha256(d[~g].tobytes() if g.any() else d).hexdigest()) for _, d, g in _masks(batch, width)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def _cut(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, pa.Array]:
    """The texts that are left, and their code points. A character goes only if all its bytes do."""
    texts = []
    for _, d, g in _masks(batch, width):
        if g.any():
            head = np.flatnonzero((d & 0xC0) != 0x80)
            d = d[~np.repeat(np.logical_and.reduceat(g, head), np.diff(np.append(head, len(d))))]
        texts.append(d.tobytes().decode("utf-8", "replace"))
    return pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())


def repeat_digests(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    own = keyed(docs.select("doc_id", "text")).select("doc_id", "text", *KEY)
    ready = with_runs(own, Unit("bytes", width)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    return ready.mapInArrow(_digests(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, where there is one) after the repeats are taken out.
    Rows stay, also those of which nothing is left."""
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_text(batch, *_cut(batch, width))

    return with_runs(whole(docs).select("row", *KEY), Unit("bytes", width)).select("row", "runs").mapInArrow(run, docs.schema)
