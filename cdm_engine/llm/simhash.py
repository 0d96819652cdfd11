"""SimHash document fingerprints (operator 1).

Terms are shingles of ``size`` words (ASCII letters in lower case; a shorter text: all its words),
weighted by 1 + ln(occurrences). Each term's hash votes with its weight for or against each of
``bits`` bits; the sign of the sum is the fingerprint's bit. Votes are whole numbers, so that equal texts have
equal fingerprints wherever they stand. Texts without words have fingerprint zero.

``within`` finds all pairs of a query and a table fingerprint at most ``radius`` bits apart by permuted
block tables: the bits are cut into ``blocks`` blocks, and for each choice of blocks - radius then
spoils - 1 table is keyed by the other blocks' bits, brought to the front; two fingerprints within the
radius agree on at least ``blocks - radius`` blocks, so in one table's key.

``count_within`` counts the rows within a radius (``with_neighbours``: 27 of 256 bits, chosen from distances of near
copies, see README) for the few rows that ask: of 14 blocks one has at most one bit of difference, so that a row's 14
blocks meet those of an asking row or one of their neighbours. All rows within the radius are found.

``with_next`` pairs each row with the next by ascending doc_id without a global window: rows are dealt to
ranges of (doc_id, hash of the text), a task each, and the first row of each range is also sent to the range before it. A doc_id
that many rows share, null included, is cut into ranges like any other stretch (but copies of one row stay together).

Defined cases: null text counts as empty; rows with equal doc_id are ordered by a hash of the text; null doc_ids come
first; a table of one row is its own next; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import NO_ID
from ._store import materialize
from ._text import K3, LOWER, column, hash_spans, is_space, mix, slices, spans, tidied

BITS = 256
SIZE = 2
#: Votes count in units of 1 / UNIT.
UNIT = 1 << 10
#: Bits of difference up to which ``with_neighbours`` counts a text as near.
RADIUS = 27
#: Characters of text that are compared at a time (a pair of rows, if that has more).
HELD = 1 << 22
#: Pairs of fingerprints compared at a time.
PAIRS = 1 << 15

_SIGNS = 2 * ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1) - 1


def terms(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, shingles before each document)."""
    low = LOWER[data]
    starts, lens, ptr = spans(~is_space(low), off)
    words = hash_spans(low, starts, lens)
    n = np.diff(ptr)
    short = np.minimum(n, size)
    h = words.copy()
    for k in range(1, min(size, len(h))):
        h[: len(h) - k] = mix(h[: len(h) - k], words[k:])
    count = np.maximum(n - size + 1, np.minimum(n, 1))
    for i in np.flatnonzero((n > 0) & (n < size)).tolist():  # all words of a short text
        x = words[ptr[i] : ptr[i] + 1]
        for w in range(1, short[i]):
            x = mix(x, words[ptr[i] + w : ptr[i] + w + 1])
        h[ptr[i]] = x[0]
    inside = np.repeat(np.tile([True, False], len(n)), np.column_stack([count, n - count]).ravel())
    return h[inside], np.concatenate([[0], np.cumsum(count)])


def signs(h: np.ndarray, ptr: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints of documents as rows of bytes."""
    docs = len(ptr) - 1
    row = np.repeat(np.arange(docs), np.diff(ptr))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    weight = np.rint(UNIT * (1 + np.log(np.diff(np.append(fresh, len(h)))))) if len(h) else np.zeros(0)
    h, row = h[fresh], row[fresh]
    out = np.zeros((docs, bits // 8), np.uint8)
    for lane in range(bits // 64):
        x = mix(h, np.full(len(h), K3 + np.uint64(lane)))
        for j in range(8):
            byte = ((x >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64)
            counts = np.bincount(row * 256 + byte, weight, minlength=docs * 256).reshape(docs, 256).astype(np.int64)
            out[:, 8 * lane + j] = ((counts @ _SIGNS) > 0) @ (1 << np.arange(8))
    return out


def fingerprint_texts(texts: pa.Array, bits: int = BITS, size: int = SIZE) -> np.ndarray:
    return np.concatenate([signs(*terms(data, off, size), bits) for _, _, data, off in slices(texts, 1 << 19)] or [np.zeros((0, bits // 8), np.uint8)])


def hexed(f: np.ndarray) -> list[str]:
    raw, n = f.tobytes().hex(), 2 * f.shape[1]
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def fingerprints(docs: DataFrame, bits: int = BITS, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint) of every row, as hexadecimal digits."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hexed(fingerprint_texts(column(batch, "text"), bits, size)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def within(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6, bits: int = BITS) -> DataFrame:
    """(query, fingerprint, distance) for all distinct fingerprints of ``queries`` and ``table`` (column
    ``fingerprint``) at most ``radius`` bits apart."""
    if not radius < blocks <= bits // 8:
        raise ValueError("radius < blocks <= bits / 8")
    edges = [round(k * bits / 4 / blocks) for k in range(blocks + 1)]  # in hexadecimal digits

    def keyed(df: DataFrame, name: str) -> DataFrame:
        tables = [
            F.concat(F.lit(f"{no}:"), *[F.substring("fingerprint", edges[b] + 1, edges[b + 1] - edges[b]) for b in kept])
            for no, kept in enumerate(combinations(range(blocks), blocks - radius))
        ]
        return df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), F.explode(F.array(*tables)).alias("key"))

    def lane(c: str, k: int):
        return F.conv(F.substring(c, 1 + 8 * k, 8), 16, 10).cast("long")

    distance = sum((F.bit_count(lane("query", k).bitwiseXOR(lane("fingerprint", k))) for k in range(bits // 32)), F.lit(0))
    pairs = keyed(queries, "query").join(keyed(table, "fingerprint"), "key").withColumn("distance", distance)
    return pairs.where(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()


def _segments(bits: int, blocks: int) -> list[tuple[int, int]]:
    edges = [round(k * bits / blocks) for k in range(blocks + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _tables(bits: int, blocks: int):
    """(key, f, n) of each fingerprint and block, and (key, f, 0) of each asking one's block and of all that lie one
    bit from it. f is the fingerprint's lanes of 64 bits."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = np.frombuffer(bytes.fromhex("".join(part.column(0).to_pylist())), np.uint8).reshape(part.num_rows, bits // 8)
                lanes, each = raw.view("<u8"), np.unpackbits(raw, axis=1, bitorder="little").astype(np.uint64)
                n, asks = part.column(1).to_numpy(), np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                keys, rows, counts = [], [], []
                for b, (lo, hi) in enumerate(_segments(bits, blocks)):
                    place = np.uint64(1) << np.arange(hi - lo, dtype=np.uint64)
                    v = each[:, lo:hi] @ place
                    probes = v[asks, None] ^ np.append(np.uint64(0), place)
                    keys += [mix(x, np.full(len(x), np.uint64(b))) for x in (v, probes.ravel())]
                    rows += [np.arange(len(v)), np.repeat(asks, probes.shape[1])]
                    counts += [n, np.zeros(probes.size, np.int64)]
                row = np.concatenate(rows)
                columns = [np.concatenate(keys).view(np.int64), *(lanes[row, k].view(np.int64) for k in range(bits // 64)), np.concatenate(counts)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", *(f"f{k}" for k in range(bits // 64)), "n"])

    return run


def _counts(bits: int, radius: int, blocks: int):
    """Rows come sorted by key and asking ones (n = 0) first: (fingerprint, rows within the radius that this block
    is the first to find). Held are a key's asking fingerprints; the others stream past them."""
    masks = np.packbits([[lo <= k < hi for k in range(bits)] for lo, hi in _segments(bits, blocks)], axis=1, bitorder="little").view("<u8")

    def met(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which differences are within the radius, and the first block in which each has one bit at most."""
        hit = np.flatnonzero(np.bitwise_count(d).sum(axis=1, dtype=np.int64) <= radius)
        return hit, np.array([np.bitwise_count(d[hit] & m).sum(axis=1) <= 1 for m in masks]).reshape(len(masks), -1).argmax(axis=0)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros((0, bits // 64), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = batch.column(0).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            f = np.column_stack([batch.column(1 + k).to_numpy().view(np.uint64) for k in range(bits // 64)])
            if len(held) and key[0] == held_key:
                key, n, f = np.concatenate([np.full(len(held), held_key), key]), np.concatenate([np.zeros(len(held), np.int64), n]), np.concatenate([held, f])
            asking = np.flatnonzero(n == 0)
            there = np.flatnonzero(n > 0)
            first, end = (np.searchsorted(key[asking], key[there], side=x) for x in ("left", "right"))
            some = end > first
            there, first, many = there[some], first[some], (end - first)[some]
            total, at = np.append(0, np.cumsum(many)), 0
            while at < len(there):  # about PAIRS of them at a time
                to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
                size = many[at:to]
                t = np.repeat(there[at:to], size)
                a = asking[np.repeat(first[at:to] - (total[at:to] - total[at]), size) + np.arange(len(t))]
                hit, block = met(f[a] ^ f[t])
                # only under that block's key does a pair count
                x = f[t[hit]]
                own = np.zeros(len(hit), bool)
                for b, (lo, hi) in enumerate(_segments(bits, blocks)):
                    mine = np.flatnonzero(block == b)
                    if len(mine):
                        v = np.unpackbits(np.ascontiguousarray(x[mine]).view(np.uint8), axis=1, bitorder="little")[:, lo:hi].astype(np.uint64) @ (np.uint64(1) << np.arange(hi - lo, dtype=np.uint64))
                        own[mine] = mix(v, np.full(len(v), np.uint64(b))).view(np.int64) == key[t[hit[mine]]]
                hit = hit[own]
                if len(hit):
                    who, which = np.unique(a[hit], return_inverse=True)
                    found = np.bincount(which, n[t[hit]]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hexed(np.ascontiguousarray(f[who]).view(np.uint8)), pa.string()), pa.array(found)], names=["fingerprint", "n_within"])
                at = to
            held_key = key[-1]
            held = f[(key == held_key) & (n == 0)]

    return run


def count_within(rows: DataFrame, asks, radius: int = RADIUS, blocks: int = 0, bits: int = BITS) -> DataFrame:
    """(fingerprint, n_within): for the fingerprints of rows for which ``asks`` holds, how many of all rows
    lie at most ``radius`` bits away, themselves included. Rows are grouped to distinct fingerprints first; no
    pairs leave a task. With more than ``radius`` / 2 ``blocks``, one has at most one bit of difference: rows are sent
    once for each block, and the few that ask also to all blocks one bit away."""
    blocks = blocks or radius // 2 + 1
    if not radius < 2 * blocks or bits % 64 or bits > 64 * blocks:
        raise ValueError("radius < 2 * blocks, and blocks of 64 bits at most")
    distinct = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(asks), F.lit(False)).alias("asks"))
    lanes = "".join(f"f{k} long, " for k in range(bits // 64))
    dealt = distinct.mapInArrow(_tables(bits, blocks), f"key long, {lanes}n long").repartition("key").sortWithinPartitions("key", "n")
    return dealt.mapInArrow(_counts(bits, radius, blocks), "fingerprint string, n_within long").groupBy("fingerprint").agg(F.sum("n_within").alias("n_within"))


def _ranges(own: DataFrame) -> list[tuple[int, int]]:
    """The first (id, tie) of each of a number of ranges: as many ranges as shuffle partitions."""
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = own.select("id", "tie").repartitionByRange(n, "id", "tie")
    firsts = places.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "tie")).alias("first"))
    return sorted({(r.first.id, r.first.tie) for r in firsts.collect()})


def with_next(docs: DataFrame) -> DataFrame:
    """(part, ghost, doc_id, text), dealt and sorted so that each row's next row follows it; ``ghost`` rows
    are only there to be somebody's next."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "tie": F.xxhash64("text")})
    firsts = _ranges(own)
    if not firsts:
        return own.select(F.lit(0).alias("part"), F.lit(False).alias("ghost"), "doc_id", "text").where(F.lit(False))
    step, place = max(1, math.isqrt(len(firsts))), F.struct("id", "tie")

    def bounds(some: list[tuple[int, int]]):  # one literal, however many there are
        return F.from_json(F.lit(json.dumps([{"id": i, "tie": t} for i, t in some])), "array<struct<id: bigint, tie: bigint>>")

    # the last bound that isn't above the place: first among every step-th, then among the ``step`` from there
    coarse = F.size(F.filter(bounds(firsts[::step]), lambda b: b <= place)) - 1
    part = coarse * step + F.size(F.filter(F.slice(bounds(firsts), coarse * step + 1, step), lambda b: b <= place)) - 1
    # a range's first row also goes to the range before
    back = F.when(F.element_at(bounds(firsts), F.col("part") + 1) == place, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dealt = own.withColumn("part", part).select("*", F.explode(back).alias("ghost"))
    dealt = dealt.withColumn("part", F.when(F.col("ghost"), F.pmod(F.col("part") - 1, F.lit(len(firsts)))).otherwise(F.col("part")))
    return dealt.repartitionById(len(firsts), "part").sortWithinPartitions("part", "ghost", "id", "tie").select("part", "ghost", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(bits: int, size: int):
    def rows(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        new = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        f, g, h = (fingerprint_texts(pa.array(x, pa.string()), bits, size) for x in (texts, new, nexts))
        like = lambda a, b: np.maximum(np.cos(np.pi * np.bitwise_count(a ^ b).sum(axis=1) / bits), 0.0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                pa.array(hexed(f), pa.string()),
                pa.array(hexed(g), pa.string()),
                pa.array(like(f, g)),
                pa.array(like(f, h)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the last row that waits for its next one
        ready: list[tuple] = []
        size = 0
        for batch in batches:
            for p, ghost, i, t in zip(*batch.columns, strict=True):  # a row at a time: texts may be long
                p, t = p.as_py(), t.as_py()
                if held and held[0] == p:
                    ready.append((held[1], held[2], t))
                    size += len(held[2]) + len(t)
                held = [] if ghost.as_py() else [p, i.as_py(), t]
                if len(ready) == 256 or size > HELD:
                    yield rows(*map(list, zip(*ready, strict=True)))
                    ready, size = [], 0
        if ready:
            yield rows(*map(list, zip(*ready, strict=True)))

    return run


def compare_edits(docs: DataFrame, bits: int = BITS, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are: the cosine that the
    share of differing bits stands for, 0 to 1."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_compare(bits, size), schema)


def with_neighbours(compared: DataFrame, every: int = 100, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """Adds n_within for the rows whose doc_id is divisible by ``every`` (others: null): how many other rows'
    fingerprints lie at most ``radius`` bits away, among all rows."""
    table = materialize(compared, "compared", tidy=True)  # its shuffle moved all texts
    asks = F.col("doc_id") % every == 0
    counts = count_within(table.select("doc_id", "fingerprint"), asks, radius, bits=bits)
    asking = table.where(asks).join(counts, "fingerprint", "left").withColumn("n_within", F.col("n_within") - 1)
    rest = table.where(~F.coalesce(asks, F.lit(False))).withColumn("n_within", F.lit(None).cast("long"))
    return asking.select(rest.columns).unionAll(rest)
