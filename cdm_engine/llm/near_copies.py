"""Near copies by SimHash, verified: texts whose sets of ``size``-word shingles have a Jaccard similarity of at
least ``least`` (the pipeline's near-dedup stage: 5 words, 0.8).

Words and shingles are those of ``simhash``, here as sets. Rows with equal sets are one node. A node's fingerprint has
``SIGNS`` bits, and 128 more for comparing. Candidates meet by the Golay-code fuzzy hashing of ``golay``: each of ``TABLES`` tables takes 23 + ``EXACT``
bits of its own; the first are one segment with its fuzzy keys (six codewords at most), the others must be equal. Two texts of similarity 0.8
differ in at most 15.15 % of bits (their cosine is at least 2 x 0.8 / 1.8); segments so far apart share a fuzzy key in 60 % (counted on 40,000 random ones),
so that one of 20 tables has a key in common for 99.4 % of such pairs. Pairs of a bucket that differ in more than ``FAR`` of the
105 bits that travel with a key are passed over: at similarity 0.8 these are some 3 in 100,000.

What is left is compared by its whole fingerprints (``NEAR`` of 1152 bits: of pairs of similarity 0.8 one in some millions has more)
and then by its texts, no pair being linked unverified. First the buckets of ``FIRST`` tables each send a spanning forest of their candidates, the nearest pairs
first, so that a group of near copies sends few pairs however large it is. Then, in the buckets of all tables, the candidate pairs that verified links
have not joined already are compared in the bucket's task: first by fingerprints alone; only rows of pairs that these leave
bring their texts to the task, once each. So each candidate pair is verified, or its ends are in one component. Texts that
share a template but are less alike than the threshold cost comparisons of fingerprints, and hardly any of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import KEY, KEYS, keyed
from ._store import materialize, release
from ._text import K1, K3, column, gather, mix, slices, tidied
from .components import components
from .golay import fuzzy_keys
from .simhash import signs, terms

SIGNS, TABLES, EXACT = 1024, 20, 6
#: Tables whose forests are verified before all pairs are looked at; they find most links of large groups.
FIRST = 3
#: Bits of (table, exact bits, codeword) in a row's first number; its other bits and the second number are compared.
HEAD = 23
FAR = 31
#: Of all 1152 bits: at similarity 0.8 pairs differ in 174.5 on average, with a standard deviation of 12.2; sets of few shingles, whose
#: votes are often tied, in up to 216 (four shingles and a fifth), with one of 13.2. So many are near, the second where a set has under ``FEW``.
NEAR, NEAR_FEW, FEW = 250, 290, 64
#: Rows of a bucket above which its pairs are searched row by row.
LARGE = 256
_REST = np.uint64((1 << (64 - HEAD)) - 1)


def sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, in order, of one document after the other; how many stand before each)."""
    h, ptr = terms(data, off, size)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    return h[fresh], np.searchsorted(row[fresh], np.arange(len(ptr)))


def nodes(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of each document's set."""
    sums = np.append(np.uint64(0), np.cumsum(mix(h, np.full(len(h), K1)), dtype=np.uint64))
    return mix(sums[ptr[1:]] - sums[ptr[:-1]], np.diff(ptr).astype(np.uint64)).view(np.int64)


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at in range(0, len(texts), 256):
        for lo, hi, data, off in slices(texts.slice(at, 256), 1 << 19):
            yield at + lo, at + hi, *sets(data, off, size)


def _sketches(size: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, ptr in _slices(column(batch, "text"), size):
                bits = np.concatenate([signs(h, ptr, SIGNS + 128), np.diff(ptr).astype("<u8")[:, None].view(np.uint8)], axis=1)
                s = pa.array([x.tobytes() for x in bits], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(nodes(h, ptr)), s], names=["id", *KEY, "f", "bits"])

    return run


def _numbered(size: int):
    """Adds the node ``f`` to ka, kb, text."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, ptr in _slices(column(batch, "text"), size):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), column(part, "text").cast(pa.string()), pa.array(nodes(h, ptr))], names=[*KEY, "text", "f"])

    return run


def _heads(raw: np.ndarray, first: int, end: int) -> np.ndarray:
    """The six (table, exact bits, codeword) of each fingerprint in each of the tables; some repeat where there are fewer."""
    width = 23 + EXACT
    signs_ = np.unpackbits(np.ascontiguousarray(raw[:, : SIGNS // 64]).view(np.uint8), axis=1, bitorder="little")
    bits = signs_[:, first * width : end * width].reshape(len(raw), end - first, width)
    segment = bits[:, :, :23] @ (1 << np.arange(23))
    exact = bits[:, :, 23:] @ (1 << np.arange(EXACT)) + (np.arange(first, end) << EXACT)
    return (exact[:, :, None] << 12) | fuzzy_keys(segment.ravel()).reshape(*segment.shape, 6)


def _tables(first: int, end: int):
    """(f, bits, label) to (a, b, f, label): table, key and 41 bits; 64 bits; node; label - one row for each key of these tables."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = _raw(part.column(1).to_pylist())
                head = np.sort(_heads(raw, first, end).reshape(len(raw), -1), axis=1)
                row, k = np.nonzero(np.append(np.ones((len(raw), 1), bool), head[:, 1:] != head[:, :-1], axis=1))
                rest = raw[:, SIGNS // 64 : SIGNS // 64 + 2]
                a = (head[row, k].astype(np.uint64) << np.uint64(64 - HEAD)) | (rest[row, 0] & _REST)
                columns = a.view(np.int64), rest[row, 1].view(np.int64), part.column(0).to_numpy()[row], part.column(2).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "f", "label"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole buckets of rows that come sorted: (key, a, b, other columns), some buckets at a time."""
    held: list[np.ndarray] = []
    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(new[0]):
            continue
        key = new[0].view(np.uint64) >> np.uint64(64 - HEAD)
        last = int(np.searchsorted(key, key[-1]))  # keys ascend; the last bucket may go on
        if waiting and (last or waiting[0][0].view(np.uint64)[0] >> np.uint64(64 - HEAD) != key[0]):
            held = [np.concatenate(x) for x in zip(*waiting, [c[:last] for c in new], strict=True)]
            waiting = []
            yield held[0].view(np.uint64) >> np.uint64(64 - HEAD), *held
        elif last:
            yield key[:last], *[c[:last] for c in new]
        waiting.append([c[last:] for c in new])
    if waiting:
        held = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        yield held[0].view(np.uint64) >> np.uint64(64 - HEAD), *held


def _apart(a: np.ndarray, b: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count((a[i] ^ a[j]) & _REST).astype(np.int64) + np.bitwise_count(b[i] ^ b[j])


def _pairs(key: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one bucket with different labels that differ in at most FAR bits. In small buckets the pairs one place apart, two places, ...; in
    large ones row by row, labels of few rows first, so that the rows of the largest are never compared with each other."""
    cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    size = np.diff(cut)
    small = np.flatnonzero(np.repeat(size <= LARGE, size))
    end = np.searchsorted(key[small], key[small], side="right")
    live, step = np.arange(len(small)), 1
    while len(live := live[live + step < end[live]]):
        i, j = small[live], small[live + step]
        new = label[i] != label[j]
        i, j = i[new], j[new]
        near = _apart(a, b, i, j) <= FAR
        if near.any():
            yield i[near], j[near]
        step += 1
    for g in np.flatnonzero(size > LARGE).tolist():
        rows = np.arange(cut[g], cut[g + 1])
        _, which, n = np.unique(label[rows], return_inverse=True, return_counts=True)
        rows = rows[np.lexsort((which, n[which]))]
        for k in range(len(rows) - int(n.max())):
            rest = rows[k + 1 :]
            rest = rest[label[rest] != label[rows[k]]]
            near = rest[_apart(a, b, rest, rows[k]) <= FAR]
            if len(near):
                yield np.full(len(near), rows[k]), near


def _search(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the labels of one bucket."""
    _, which = np.unique(label, return_inverse=True)
    left, front, found = np.arange(len(a)), [], []
    seen = np.zeros(len(a), bool)  # labels
    while len(left):
        if not front:
            seen[which[left[0]]] = True
        else:
            i = front.pop()
            near = left[_apart(a, b, left, i) <= FAR]
            _, once = np.unique(which[near], return_index=True)  # what is left has no label that was seen
            found += [(i, j) for j in near[once].tolist()]
            seen[which[near]] = True
        new = seen[which[left]]
        front += left[new].tolist()
        left = left[~new]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The edges (x, y), which come in order of their weights, of the least spanning forest of n nodes."""
    root, alive, chosen = np.arange(n), np.arange(len(x)), []
    while True:
        alive = alive[root[x[alive]] != root[y[alive]]]
        if not len(alive):
            return np.sort(np.concatenate([*chosen, alive]))
        best = np.full(n, len(x))  # each component's first edge
        np.minimum.at(best, root[x[alive]], alive)
        np.minimum.at(best, root[y[alive]], alive)
        own = np.flatnonzero(best < len(x))
        chosen.append(np.unique(best[own]))
        up = np.arange(n)
        up[own] = root[x[best[own]]] + root[y[best[own]]] - own  # the component at its other end
        up = np.where((up[up] == np.arange(n)) & (np.arange(n) < up), np.arange(n), up)
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def _forest(key: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the labels of small buckets as all candidate pairs do, the nearest first."""
    some = list(_pairs(key, a, b, label))
    if not some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*some, strict=True))
    order = np.argsort(_apart(a, b, i, j), kind="stable")
    i, j = i[order], j[order]
    row = np.lexsort((label, key))
    node = np.empty(len(key), np.int64)
    node[row] = np.cumsum(np.append(False, (key[row][1:] != key[row][:-1]) | (label[row][1:] != label[row][:-1])))
    sent = _spanning(node[i], node[j], len(key))
    return i[sent], j[sent]


@tidied
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, *numbers, f, label in _buckets(batches):
        a, b = (x.view(np.uint64) for x in numbers)
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        size = np.diff(cut)
        at = np.flatnonzero(np.repeat(size <= LARGE, size))
        i, j = _forest(key[at], a[at], b[at], label[at])
        parts = [(at[i], at[j])]
        for g in np.flatnonzero(size > LARGE).tolist():
            own = slice(cut[g], cut[g + 1])
            i, j = _search(a[own], b[own], label[own])
            parts.append((i + cut[g], j + cut[g]))
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(f[i], f[j])), pa.array(np.maximum(f[i], f[j]))], names=["x", "y"])


@tidied
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are in a candidate pair whose ends have different labels."""
    for key, a, b, f, label in _buckets(batches):
        some = np.zeros(len(key), bool)
        for i, j in _pairs(key, a.view(np.uint64), b.view(np.uint64), label):
            some[i] = some[j] = True
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (a, b, f, label)], names=["a", "b", "f", "label"])


def _raw(bits) -> np.ndarray:
    """Fingerprints of rows, as 64-bit numbers, and behind them the number of shingles."""
    return np.frombuffer(b"".join(bits), "<u8").reshape(len(bits), -1)


def _near(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    few = np.minimum(one[:, -1], two[:, -1]) < FEW
    return np.bitwise_count(one[:, :-1] ^ two[:, :-1]).sum(axis=1, dtype=np.int64) <= np.where(few, NEAR_FEW, NEAR)


def _new_pairs(key: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a bucket whose ends have different labels and whole fingerprints that are near. A pair counts at the first key that
    its ends share."""
    for i, j in _pairs(key, a, b, label):
        for at in range(0, len(i), 1 << 12):
            x, y = i[at : at + (1 << 12)], j[at : at + (1 << 12)]
            close = _near(raw[x], raw[y])
            x, y = x[close], y[close]
            one, two = (_heads(raw[z], 0, TABLES) for z in (x, y))
            shared = (one[:, :, :, None] == two[:, :, None, :]).any(axis=3)
            mine = np.where(shared, one, 1 << HEAD).min(axis=(1, 2)) == key[x].astype(np.int64)
            if mine.any():
                yield x[mine], y[mine]


@tidied
def _closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are in such a pair."""
    for key, a, b, f, label, bits in _buckets(batches):
        some = np.zeros(len(key), bool)
        for i, j in _new_pairs(key, a.view(np.uint64), b.view(np.uint64), label, _raw(bits)):
            some[i] = some[j] = True
        if some.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in (a, b, f, label)), pa.array(bits[some].tolist(), pa.binary())], names=["a", "b", "f", "label", "bits"])


def _joined(size: int, least: float):
    """Verified links (a, b) of such rows with their bits and texts: a forest for each bucket. A pair counts in the first
    table in which its ends share a key; no pairs leave the task."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, a, b, f, label, bits, text in _buckets(batches):
            h, ptr = _stacked(pa.array(text, pa.string()), size)
            n = np.diff(ptr)
            up = list(range(len(key)))

            def root(x: int, up: list[int] = up) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            links = []
            for i, j in _new_pairs(key, a.view(np.uint64), b.view(np.uint64), label, _raw(bits)):
                for at in range(0, len(i), 1024):
                    x, y = i[at : at + 1024], j[at : at + 1024]
                    sides = [v for z in (x, y) for v in (gather(h, ptr[z], n[z]), np.append(0, np.cumsum(n[z])))]
                    alike = jaccard(*sides) >= least
                    for one, two in zip(x[alike].tolist(), y[alike].tolist(), strict=True):
                        if root(one) != root(two):
                            up[root(two)] = root(one)
                            links.append((int(f[one]), int(f[two])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([k[side] for k in links], pa.int64()) for side in (0, 1)], names=["a", "b"])

    return run


def jaccard(h: np.ndarray, p: np.ndarray, g: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Similarity of the sets of each row (two empty ones: 1)."""
    n, m = np.diff(p), np.diff(q)
    row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
    both = np.concatenate([h, g])
    order = np.lexsort((both, row))
    both, row = both[order], row[order]
    shared = np.bincount(row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])], minlength=len(n))
    union = n + m - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def _stacked(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [x[2:] for x in _slices(texts, size)]
    return np.concatenate([h for h, _ in parts]), np.append(0, np.cumsum(np.concatenate([np.diff(p) for _, p in parts])))


def _verify(size: int, least: float):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                one, two = (_stacked(column(part, c), size) for c in ("text_x", "text_y"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(jaccard(*one, *two) >= least)], names=["x", "y", "alike"])

    return run


def _texts(nodes: DataFrame, docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """(f, text) of the nodes (f). ``chosen``: a row (ka, kb) for each node f."""
    asked = chosen.join(nodes, "f", "left_semi")
    rows = keyed(docs.select("doc_id", "text")).select(*KEY, "text").join(asked.select(*KEY), KEY, "left_semi")
    numbered = rows.mapInArrow(_numbered(size), f"{KEYS}, text string, f long")
    return materialize(numbered.join(asked, ["f", *KEY], "left_semi").dropDuplicates(["f"]).select("f", "text"), "texts")


@tidied
def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the whole fingerprints of pairs are near."""
    for batch in batches:
        if batch.num_rows:
            one, two = (_raw(batch.column(k).to_numpy(zero_copy_only=False)) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_near(one, two))], names=["x", "y", "near"])


def _judged(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, chosen: DataFrame, size: int, least: float) -> DataFrame:
    """(x, y, alike) for the pairs (x, y)."""
    with_bits = pairs.join(distinct.select(F.col("f").alias("x"), F.col("bits").alias("bits_x")), "x").join(distinct.select(F.col("f").alias("y"), F.col("bits").alias("bits_y")), "y")
    pairs = materialize(with_bits.select("x", "y", "bits_x", "bits_y").mapInArrow(_told_apart, "x long, y long, near boolean"), "pairs")
    near = pairs.where("near").select("x", "y")
    texts = _texts(near.select(F.explode(F.array("x", "y")).alias("f")).distinct(), docs, chosen, size)
    first = texts.select(F.col("f").alias("x"), F.col("text").alias("text_x"))
    second = texts.select(F.col("f").alias("y"), F.col("text").alias("text_y"))
    told = near.join(first, "x").join(second, "y").select("x", "y", "text_x", "text_y").mapInArrow(_verify(size, least), "x long, y long, alike boolean")
    told = materialize(told.unionByName(pairs.where("not near").select("x", "y", F.col("near").alias("alike"))), "judged")
    release(pairs, texts)
    return told


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with their buckets in one task each, in order."""
    head = F.shiftrightunsigned("a", 64 - HEAD)
    return rows.repartition(head).sortWithinPartitions(head, "a", "b", "f")


def links(distinct: DataFrame, docs: DataFrame, chosen: DataFrame, size: int, least: float) -> DataFrame:
    """Verified links (a, b) between the nodes of ``distinct`` (f, bits) that join all verified candidates."""
    numbers = "a long, b long, f long, label long"
    tables = distinct.select("f", "bits", F.col("f").alias("label")).mapInArrow(_tables(0, FIRST), numbers)
    found = materialize(_dealt(tables).mapInArrow(_links, "x long, y long").distinct(), "candidates")
    judged = _judged(found, distinct, docs, chosen, size, least)
    release(found)
    sure = judged.where("alike").select(F.col("x").alias("a"), F.col("y").alias("b"))
    label = components(sure).withColumnRenamed("node", "f")
    again = distinct.join(label, "f", "left").select("f", "bits", F.coalesce("label", "f").alias("label")).mapInArrow(_tables(0, TABLES), numbers)
    others = materialize(_dealt(again).mapInArrow(_across, numbers), "others")
    bits = others.join(distinct, "f").select("a", "b", "f", "label", "bits")
    closer = materialize(_dealt(bits).mapInArrow(_closer, f"{numbers}, bits binary"), "closer")
    release(others)
    texts = _texts(closer.select("f").distinct(), docs, chosen, size)
    whole = closer.join(texts, "f").select("a", "b", "f", "label", "bits", "text")
    more = materialize(_dealt(whole).mapInArrow(_joined(size, least), "a long, b long"), "more")
    release(closer, texts)
    return sure.unionByName(more)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(id, ka, kb, f, bits) of every row: keys, node, and fingerprint with the number of shingles."""
    return keyed(docs.select("doc_id", "text")).select("id", *KEY, "text").mapInArrow(_sketches(size), f"id long, {KEYS}, f long, bits binary")
