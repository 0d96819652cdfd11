"""Benchmark decontamination by a distributed positional inverted index (operator 10).

*Index.* Documents are cut into segments of about ``SEGMENT_BYTES``; each segment is a row of the index
table, written once to the shared folder: its documents, their numbers of words, and for every term that stands in
them the sorted list of its places (places of neighbouring documents are more
than a phrase apart). A term's postings thus lie in many segments, and no term, however common,
gathers in one task; nothing but small rows is shuffled.

*Search.* For each phrase a segment starts from the postings of the phrase's rarest term there,
subtracts the term's offset, and intersects with the offset-adjusted postings of the next rarer
terms, one after the other. With ``slop`` above 0 (proximity) each term may stand so many places from where an exact match
with that start would have it.

*Phrases.* A window is ``width`` consecutive words of an item; an item of fewer words, but not none,
is one window. Tasks turn items into word identifiers and cut long ones into pieces of ``PIECE_WINDOWS`` windows; pieces that an
item has more than once, in repeated rows or within it, count once. They are dealt to blocks of about ``BLOCK_BYTES`` of identifiers, so
that what the driver holds and sends to every task has a bound whatever the benchmark's size, its longest item's and its
repeated rows'. Every block is looked up in the same index; with more than one, the hits of each are written and its broadcast
destroyed before the next is read.

Words: ASCII letters in lower case, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Defined cases: null texts
have no words; items without words never match; a null item_id prints as an empty string; rows with
equal doc_id are judged one by one; an empty table of either kind gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import fresh_path
from ._rows import KEY, KEYS, NO_ID, keyed, whole
from ._store import materialize, materialize_each, release
from ._text import LOWER, column, gather, hash_spans, slices, spans, tidied

#: Bytes of word identifiers (8 for each word of the benchmark) in a block, on average.
BLOCK_BYTES = 2 << 20
#: Windows of a piece, far fewer than a block's.
PIECE_WINDOWS = 1 << 13
SEGMENT_BYTES = 1 << 19
#: Places between the last word of a document and the first of the next are more than this.
GAP = 1 << 10

#: Candidate places that a search holds at a time (those of one phrase, if these are more).
CANDIDATES = 1 << 17

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term identifiers of all words, words before each document)."""
    low = LOWER[data]
    starts, lens, ptr = spans(_WORD[low], off)
    return hash_spans(low, starts, lens), ptr


class Phrases:
    """A block of the benchmark, from (item, word identifiers) of its pieces: sorted terms, and phrases as rows of term
    numbers (-1: no more)."""

    def __init__(self, pieces: list[tuple[str, list[int]]], width: int):
        found: dict[tuple[int, ...], set[str]] = {}
        for item, terms in pieces:
            own = np.array(terms, np.int64).view(np.uint64).tolist()
            for k in range(max(1, len(own) - width + 1)):
                found.setdefault(tuple(own[k : k + width]), set()).add(item)
        self.width = width
        self.items = [sorted(x) for x in found.values()]
        self.terms = np.unique(np.array([t for p in found for t in p], np.uint64))
        self.phrases = np.full((len(found), width), -1, np.int64)
        for r, p in enumerate(found):
            self.phrases[r, : len(p)] = np.searchsorted(self.terms, np.array(p, np.uint64))
        self.sizes = np.array([len(p) for p in found], np.int64)


SEGMENT = "id array<long>, ka array<long>, kb array<long>, n_words array<long>, terms array<long>, counts array<int>, gaps array<int>"


@tidied
def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(x: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(kind, copy=False)))

    for batch in batches:
        own = [batch.column(k).to_numpy() for k in range(3)]
        for lo, hi, data, off in slices(column(batch, "text"), SEGMENT_BYTES):
            words, ptr = tokens(data, off)
            order = np.argsort(words, kind="stable")
            at = order + (np.searchsorted(ptr, order, side="right") - 1) * GAP
            term, first = np.unique(words[order], return_index=True)
            gap = np.diff(at, prepend=0)  # within a term; its first place stands as it is
            gap[first] = at[first]
            columns = [*((x[lo:hi], np.int64) for x in own), (np.diff(ptr), np.int64), (term.view(np.int64), np.int64), (np.diff(np.append(first, len(at))), np.int32), (gap, np.int32)]
            yield pa.RecordBatch.from_arrays([one(*c) for c in columns], names=["id", *KEY, "n_words", "terms", "counts", "gaps"])


def build_index(docs: DataFrame) -> DataFrame:
    """The index table over every word of every row of ``docs`` (id, ka, kb, text): one row per segment."""
    return materialize(docs.select("id", *KEY, "text").mapInArrow(_segments, SEGMENT), "postings", wide=True)


def postings(block: Phrases, terms: np.ndarray, counts: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term numbers of the block, their counts, their places) in a segment."""
    terms = terms.view(np.uint64)
    no = np.minimum(np.searchsorted(block.terms, terms), max(len(block.terms) - 1, 0))
    have = np.flatnonzero(block.terms[no] == terms) if len(block.terms) else no[:0]
    count = counts[have].astype(np.int64)
    first = (np.cumsum(counts, dtype=np.int64) - counts)[have]
    total = np.cumsum(gather(gaps, first, count).astype(np.int64))
    before = np.append(0, total)[np.cumsum(count) - count]
    return no[have], count, total - np.repeat(before, count)


def intersect(block: Phrases, term: np.ndarray, count: np.ndarray, place: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase numbers, places of their first words, places of their rarest words) of all matches in a segment."""
    none = np.zeros(0, np.int64)
    if not len(term) or not len(block.phrases):
        return none, none, none
    n = np.zeros(len(block.terms) + 1, np.int64)
    n[term] = count
    first = np.zeros(len(block.terms) + 1, np.int64)
    first[term] = np.cumsum(count) - count
    n[-1] = np.iinfo(np.int64).max  # the mark for "no more words"
    have = n[block.phrases]
    alive = np.flatnonzero(have.min(axis=1) > 0)
    if not len(alive):
        return none, none, none
    rare = np.argsort(have[alive], axis=1, kind="stable")
    seed = block.phrases[alive, rare[:, 0]]
    posting = (np.repeat(term, count).astype(np.int64) << 32) + place
    shifts = np.arange(-slop, slop + 1)
    found, starts, seeds = [none], [none], [none]
    edge = np.searchsorted(np.cumsum(n[seed]), np.arange(CANDIDATES, int(n[seed].sum()) + CANDIDATES, CANDIDATES))
    for a, b in zip(np.append(0, edge[:-1] + 1).tolist(), (edge + 1).tolist(), strict=True):
        part = slice(a, b)  # phrases with about CANDIDATES candidates, so that memory stays bounded
        at = np.repeat(gather(place, first[seed[part]], n[seed[part]]), len(shifts))
        row = np.repeat(np.arange(len(alive))[part], n[seed[part]] * len(shifts))
        start = at - rare[row, 0] + np.resize(shifts, len(at))
        for k in range(1, block.width):
            offset = rare[row, k]
            want = block.phrases[alive[row], offset]
            lowest = (want << 32) + np.maximum(start + offset - slop, 0)
            to = np.minimum(np.searchsorted(posting, lowest), len(posting) - 1)
            ok = (want < 0) | ((posting[to] >= lowest) & (posting[to] <= (want << 32) + start + offset + slop))
            row, start, at = row[ok], start[ok], at[ok]
        found.append(alive[row])
        starts.append(start)
        seeds.append(at)
    return np.concatenate(found), np.concatenate(starts), np.concatenate(seeds)


HITS = f"{KEYS}, starts array<long>, lens array<long>, items array<string>, near array<string>"


def _search(shared, slop: int):
    """Rows of the documents in which phrases match; ``near``: the items with a match within ``slop`` places."""

    def strings(block: Phrases, phrase: np.ndarray, doc: np.ndarray, docs: np.ndarray) -> pa.Array:
        which = np.searchsorted(doc, docs, side="left"), np.searchsorted(doc, docs, side="right")
        return pa.array([sorted({x for p in np.unique(phrase[a:b]).tolist() for x in block.items[p]}) for a, b in zip(*which, strict=True)], pa.list_(pa.string()))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ka, kb, words, *stored = (batch.column(k)[i].values.to_numpy() for k in range(1, 7))
                here = postings(block, *stored)
                base = np.concatenate([[0], np.cumsum(words + GAP)])
                phrase, start, at = intersect(block, *here)
                doc = np.searchsorted(base, at, side="right") - 1
                order = np.argsort(doc, kind="stable")
                phrase, start, doc = phrase[order], start[order], doc[order]
                close, _, at = intersect(block, *here, slop) if slop else (phrase, start, base[doc])
                other = np.searchsorted(base, at, side="right") - 1
                order = np.argsort(other, kind="stable")
                close, other = close[order], other[order]
                docs = np.union1d(doc, other)
                edge = pa.array(np.append(np.searchsorted(doc, docs), len(doc)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ka[docs]),
                        pa.array(kb[docs]),
                        pa.ListArray.from_arrays(edge, pa.array(start - base[doc])),
                        pa.ListArray.from_arrays(edge, pa.array(block.sizes[phrase])),
                        strings(block, phrase, doc, docs),
                        strings(block, close, other, docs),
                    ],
                    names=[*KEY, "starts", "lens", "items", "near"],
                )

    return run


def _pieces(width: int, windows: int):
    """(item, terms) of pieces of at most so many windows; each window of an item with words is in one of them."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, off in slices(column(batch, "text")):
                terms, ptr = tokens(data, off)
                n = np.diff(ptr)
                parts = -(-np.maximum(n - width + 1, np.minimum(n, 1)) // windows)
                row = np.repeat(np.arange(len(n)), parts)
                start = ptr[row] + windows * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
                size = np.minimum(start + windows + width - 1, ptr[row + 1]) - start
                for at in range(0, len(row), 256):
                    some = slice(at, at + 256)
                    edge = np.append(0, np.cumsum(size[some])).astype(np.int32)
                    words = pa.array(gather(terms, start[some], size[some]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row[some])), pa.ListArray.from_arrays(pa.array(edge), words)], names=["item", "terms"])

    return run


def blocks(benchmark: DataFrame, width: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(the pieces of each block, at least one; the tables that they are read from)."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    items = benchmark.select(item, F.coalesce("text", F.lit("")).alias("text"))
    pieces = materialize(items.mapInArrow(_pieces(width, PIECE_WINDOWS), "item string, terms array<long>").distinct(), "benchmark")
    total = 8 * (pieces.agg(F.sum(F.size("terms"))).first()[0] or 0)
    n = -(-total // BLOCK_BYTES)
    if n <= 1:
        return [pieces], [pieces]
    path = fresh_path(pieces.sparkSession, "blocks")
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "terms"), F.lit(n)))
    dealt.repartition("part").write.partitionBy("part").parquet(path)
    dealt = pieces.sparkSession.read.parquet(path)
    dealt._stored_at = path
    release(pieces)
    return [dealt.where(F.col("part") == k).select("item", "terms") for k in range(n)], [dealt]


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows, hits, the tables that they are read from). rows: id, ka, kb, n_words of every row of ``docs`` (with id, ka, kb, text). hits: ka, kb, starts,
    lens, items, near - the words where phrases start, their numbers of words, the item_ids, and those within ``slop`` - of those that match."""
    if not 0 < width + slop < GAP:
        raise ValueError(f"width and slop stay below {GAP}")
    context = docs.sparkSession.sparkContext
    index = build_index(docs)
    rows = index.select(F.explode(F.arrays_zip("id", *KEY, "n_words")).alias("d")).select("d.*")
    parts, source = blocks(benchmark, width)

    def found() -> Iterator[DataFrame]:
        for part in parts:
            shared = context.broadcast(Phrases([(r.item, r.terms) for r in part.collect()], width))
            yield index.mapInArrow(_search(shared, slop), HITS)
            shared.destroy()  # only once the next is asked for

    if len(parts) == 1:
        hits, held = next(found()), [index]
    else:
        hits = materialize_each(found(), "hits")
        held = [index, hits]
    release(*source)
    # copies of one row share a key
    return rows, hits.groupBy(*KEY).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "lens", "items", "near")]), held


@tidied
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, n_near, sha = [], [], [], []
        for n, starts, lens, items, near in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
            mark = np.zeros(n + 1, np.int32)
            np.add.at(mark, starts or [], 1)
            np.add.at(mark, [s + x for s, x in zip(starts or [], lens or [], strict=True)], -1)
            n_hit.append(int((np.cumsum(mark)[:n] > 0).sum()))
            own = sorted(set(items or []))
            n_items.append(len(own))
            n_near.append(len(set(near or [])))
            sha.append(hashlib.sha256(",".join(own).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(n_near, pa.int64())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"],
        )


def hit_digests(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 1) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a window within ``slop`` places) of every row."""
    rows, hits, _ = matches(keyed(docs.select("doc_id", "text")), benchmark, width, slop)
    doc_id = F.when(F.col("id") != F.lit(NO_ID), F.col("id")).alias("doc_id")
    return (
        rows.join(hits, KEY, "left")
        .select(doc_id, "n_words", "starts", "lens", "items", "near")
        .mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs."""
    own = whole(docs)
    _, hits, held = matches(own.select("id", *KEY, F.col("row.text").alias("text")), benchmark, width)
    hits = materialize(hits.select(*KEY), "hits")
    release(*held)
    return own.join(hits, KEY, "left_anti").select("row.*")
