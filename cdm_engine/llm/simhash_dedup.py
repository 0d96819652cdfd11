"""SimHash near-dedup with Golay-code fuzzy hashing (operator 7).

Fingerprint: ASCII letters in lower case, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``size`` words
(a shorter text: all its words) joined by spaces, XXH64 with seed 42; a bit is 1 if it is set in
more than half of the shingles' hashes, repeats included. No words: zero.

Links: fingerprints that differ in at most 2 bits. Rows are grouped to distinct fingerprints first,
so that exact copies cost nothing. Each fingerprint sends its Golay join keys (``golay``); members of
a key's group are compared in a task, as blocks of numbers, and only the links of a spanning forest
leave it. A group above ``LARGE`` fingerprints is not compared pair by pair: its members send all
fingerprints within 1 bit (two members at most 2 bits apart share one of these), and these become
nodes of the link graph - exact, and linear in the group's size. No cap, no dropped links.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows with
equal doc_id get the same component as their texts say; null doc_ids never name a component unless
all of its doc_ids are null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import near_copies
from ._rows import KEY, KEYS, NO_ID, keyed, whole
from ._store import materialize, release
from ._text import column, is_space, spans, tidied
from .components import components
from .golay import join_keys

LARGE = 2048
RADIUS = 2


def _votes(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Per document and bit, how many of its hashes set the bit."""
    docs = len(ptr) - 1
    out = np.zeros((docs, 64), np.int64)
    row = np.repeat(np.arange(docs), np.diff(ptr)) * 256
    for j in range(8):
        byte = ((hashes >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64)
        counts = np.bincount(row + byte, minlength=docs * 256).reshape(docs, 256)
        out[:, 8 * j : 8 * j + 8] = counts @ _BITS
    return out


_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def _count(waiting: list[tuple[int, np.ndarray]], votes: np.ndarray) -> None:
    """Adds the votes of (document, hashes) to those of the documents, and empties the list."""
    if waiting:
        ptr = np.concatenate([[0], np.cumsum([len(h) for _, h in waiting])])
        np.add.at(votes, [i for i, _ in waiting], _votes(np.concatenate([h for _, h in waiting]), ptr))
        waiting.clear()


#: Bytes of a text above which it is cut into shingles piece by piece.
LONG = 1 << 20


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    return [digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def hash_pieces(text: bytes, size: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles; of a long one some at a time."""
    if len(text) <= LONG:
        yield np.array(shingle_hashes(text, size), np.uint64)
        return
    data = np.frombuffer(text, np.uint8)
    starts, lens, _ = spans(~is_space(data), np.array([0, len(data)]))
    for a in range(0, max(1, len(starts) - size + 1), LONG // 8):
        last = min(len(starts), a + LONG // 8 + size - 1) - 1
        yield np.array(shingle_hashes(text[int(starts[a]) : int(starts[last] + lens[last])], size) if last >= 0 else [], np.uint64)


def _fingerprints(size: int):
    """Appends the fingerprint ``f`` to whatever columns stand before ``text``."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            texts, names = column(batch, "text").cast(pa.binary()), [n for n in batch.schema.names if n != "text"]
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256)
                n, votes = np.zeros(len(part), np.int64), np.zeros((len(part), 64), np.int64)
                waiting: list[tuple[int, np.ndarray]] = []
                for i, t in enumerate(part):
                    for h in hash_pieces(t.as_py(), size):
                        waiting.append((i, h))
                        n[i] += len(h)
                        if sum(len(x) for _, x in waiting[-4:]) > LONG // 8:
                            _count(waiting, votes)
                _count(waiting, votes)
                f = ((2 * votes > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, 256) for k in range(len(names))), pa.array(f.view(np.int64))], names=[*names, "f"])

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(id, ka, kb, f): row keys (see ``keyed``) and a fingerprint's 64 bits as a signed number."""
    return keyed(docs.select("doc_id", "text")).select("id", *KEY, "text").mapInArrow(_fingerprints(size), f"id long, {KEYS}, f long")


@tidied
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            f = batch.column(0).slice(at, 8192).to_numpy()
            rows, keys = join_keys(f.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[rows])], names=["key", "f"])


def _forest(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph on f (sorted) that has a link within RADIUS bits."""
    left = np.arange(1, len(f))
    front = np.array([0])
    a, b = [], []
    u = f.view(np.uint64)
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
            continue
        hit = np.zeros(len(left), bool)
        who = np.zeros(len(left), np.int64)
        for i in front.tolist():
            open_ = np.flatnonzero(~hit)
            near = open_[np.bitwise_count(u[left[open_]] ^ u[i]) <= RADIUS]
            hit[near], who[near] = True, i
        a.append(f[who[hit]])
        b.append(f[left[hit]])
        front, left = left[hit], left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (f[:0], f[:0])


def _ball(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with itself and with all that lie one bit away."""
    u = f.view(np.uint64)
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return np.repeat(f, 65), (u[:, None] ^ flips).ravel().view(np.int64)


@tidied
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: links (a, b), with ``through`` where b is only a neighbour in common."""

    def out(a: np.ndarray, b: np.ndarray, through: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), through))], names=["a", "b", "through"])

    def small(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(f) == 2:
            near = np.bitwise_count(f.view(np.uint64)[:1] ^ f.view(np.uint64)[1:]) <= RADIUS
            return f[:1][near], f[1:][near]
        return _forest(f)

    held_key, held, large = None, np.zeros(0, np.int64), False
    for batch in batches:
        key, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        size = np.diff(cut)
        found_a, found_b = [], []
        for g in range(len(size)):
            if size[g] == 1 and 0 < g < len(size) - 1:
                continue
            part, k = f[cut[g] : cut[g + 1]], int(key[cut[g]])
            if k != held_key:
                if len(held) > 1 and not large:
                    a, b = small(held)
                    found_a.append(a)
                    found_b.append(b)
                held_key, held, large = k, part[:0], False
            held = np.concatenate([held, part])
            if large or len(held) > LARGE:  # what is held goes out as soon as the group is known to be large
                large = True
                for at in range(0, len(held), LARGE):
                    yield out(*_ball(held[at : at + LARGE]), True)
                held = held[:0]
        if found_a:
            yield out(np.concatenate(found_a), np.concatenate(found_b), False)
    if len(held) > 1 and not large:
        yield out(*small(held), False)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (f) that keep its components whole."""
    found = distinct.select("f").mapInArrow(_keys, "key long, f long").repartition("key").sortWithinPartitions("key", "f")
    edges = materialize(found.mapInArrow(_links, "a long, b long, through boolean"), "links")
    ball = edges.where("through").select("a", "b").distinct()
    shared = ball.join(ball.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b"), "b", "left_semi")
    return edges.where("not through").select("a", "b").unionByName(shared.select("a", "b")).distinct()


def _named(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(f, component_id): the smallest id of each fingerprint's component; null doc_ids only where there is no other.
    The links are those of fingerprints, or ``found``."""
    named = F.when(F.col("id") != NO_ID, F.col("id"))
    distinct = rows.groupBy("f").agg(F.min(named).alias("first"))
    label = components(links(distinct) if found is None else found)
    smallest = distinct.join(label, distinct.f == label.node, "left").select("f", "first", F.coalesce("label", "f").alias("label"))
    return smallest.join(smallest.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("f", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id that links reach."""
    rows = materialize(fingerprints(docs, size), "fingerprints")
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    return rows.join(_named(rows), "f").select(doc_id, F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def _first_rows(docs: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    member = rows.join(named, "f").withColumn("component", F.coalesce("component_id", "f"))
    order = F.struct(F.when(F.col("id") == NO_ID, 1).otherwise(0).alias("none"), "id", *KEY)
    chosen = member.groupBy(F.col("component_id").isNull(), "component").agg(F.min(order).alias("best")).select(*[f"best.{k}" for k in KEY])
    chosen = materialize(chosen, "chosen")
    # copies of one row have equal keys; one of them stays (tasks cut to rank 1 before the shuffle)
    once = F.row_number().over(W.partitionBy(*KEY).orderBy("id"))
    return whole(docs).join(chosen, KEY, "left_semi").withColumn("n", once).where("n = 1").select("row.*")


def keep_one(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (a null one only if there is
    no other; of several with that doc_id, one)."""
    rows = materialize(fingerprints(docs, size), "fingerprints")
    kept = _first_rows(docs, rows, _named(rows))
    release(rows)
    return kept


def keep_unlike(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """As ``keep_one``, with the links of ``near_copies``: shingles of ``size`` words, Jaccard ``least`` or more."""
    rows = materialize(near_copies.sketches(docs, size), "sketches")
    chosen = rows.groupBy("f").agg(F.min(F.struct("id", *KEY)).alias("one")).select("f", "one.*")
    distinct = materialize(rows.select("f", "bits").distinct(), "sets")
    found = near_copies.links(distinct, docs, chosen, size, least)
    names = rows.select("id", *KEY, "f")
    kept = _first_rows(docs, names, _named(names, found))
    release(rows)
    return kept
