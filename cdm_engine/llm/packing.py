"""Best-fit packing planned on a histogram of lengths (operator 4).

1. Every text is tokenised once, whole; a document's ids are cut into pieces of ``capacity`` only if
   there are more. The piece table (no text, no ids unless asked for) goes to the shared folder.
2. The plan works on counts per length, not on documents: lengths in falling order, each count put
   into the open sequences with the least sufficient room, as many at a time as there are. It has a
   few rows per length, whatever the number of documents.
3. Pieces get ranks within their length: a running number in their task plus the counts of the tasks
   before it, so that no length, however common, gathers in one task. Joining length and rank with
   the plan's rank ranges gives sequence and offset.

Tokens: where a tokenizer's own pattern cuts texts into the words that ``cut_words`` finds (``WORDS``; ``word_bpe_49k`` is of this
kind), each distinct word is encoded once in a task and its ids are reused. Any other tokenizer encodes whole texts.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; an empty table
gives an empty table; clashing extra columns aren't read.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import materialize
from ._text import column, cut_words, gather, hash_spans, slices, tidied

# The parts of a tokenizer's description that make it cut words as ``cut_words`` does.
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def by_words(vocabulary: str) -> bool:
    """Whether texts can be encoded word by word."""
    told = json.loads(vocabulary)
    model = told.get("model", {})
    return all(told.get(k) == v for k, v in WORDS.items()) and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix")


#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 200_000


class WordEncoder:
    """Token ids of texts by way of their distinct words.

    Plain words (``cut_words``) end where this vocabulary's own pattern ends them; each has one token with
    the end mark, its last. Any other chunk is encoded as it stands.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_str(vocabulary), by_words(vocabulary)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lens, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], plain: list[bool], keys: list[int]) -> None:
        order = sorted(range(len(words)), key=plain.__getitem__, reverse=True)
        n = sum(plain)
        ids, lens = [], []
        for a in range(0, n, 4096):
            part = [words[k] for k in order[a : min(a + 4096, n)]]
            (own,) = self._ids([" ".join(part)])
            stops = np.flatnonzero(self.ends[own])
            if len(stops) == len(part):
                ids.append(own)
                lens.append(np.diff(stops, prepend=-1))
            else:
                each = self._ids(part)
                ids += each
                lens.append(np.array([len(x) for x in each], np.int64))
        each = self._ids([words[k] for k in order[n:]])
        new = np.concatenate([*ids, *each, np.zeros(0, np.uint32)])
        lens = np.concatenate([*lens, np.array([len(x) for x in each], np.int64)])
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        self.known.update(zip((keys[k] for k in order), range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.used += len(new)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, ids before each document)."""
        if not self.by_words:
            raw = data.tobytes()
            each = self._ids([raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        if len(self.known) > REMEMBERED:
            self.forget()
        low, starts, lens, ptr, plain = cut_words(data, off)
        key, first, which = np.unique(hash_spans(low, starts, lens), return_index=True, return_inverse=True)
        key = key.tolist()
        new = [k for k, x in enumerate(key) if x not in self.known]
        if new:
            raw, at = low.tobytes(), first[new]
            words = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), (starts[at] + lens[at]).tolist(), strict=True)]
            self._learn(words, plain[at].tolist(), [key[k] for k in new])
        at = np.fromiter(map(self.known.__getitem__, key), np.int64, len(key))[which]
        n = self.lens[at]
        return gather(self.flat, self.starts[at], n), np.concatenate([[0], np.cumsum(n)])[ptr]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"


def _pieces(vocabulary: str, capacity: int, end_id: int, keep_ids: bool):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = WordEncoder(vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, data, off in slices(column(batch, "text")):
                flat, ptr = encoder.encode(data, off)
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for i in range(hi - lo):
                    own = np.append(flat[ptr[i] : ptr[i + 1]], np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        doc.append(lo + i)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            ids.append(part.astype(np.int32))
                n = np.array(length)
                order = np.argsort(n, kind="stable")
                fresh = np.flatnonzero(np.append(True, n[order][1:] != n[order][:-1]))
                run_no = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(n))))
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - fresh[run_no] + seen[n[order]]
                np.add.at(seen, n, 1)
                cols = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), task, np.int64)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names=names + ["ids"] * keep_ids)

    return run


@dataclass(frozen=True)
class Plan:
    """Slots: ranks [rank, rank + bins * each) of a length lie ``each`` to a sequence, from ``sequence``
    and ``offset`` on. Sorted by length and rank."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces with these ranks within their lengths."""
        key = (self.length << 44) + self.rank
        at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
        i = rank - self.rank[at]
        return self.sequence[at] + i // self.each[at], self.offset[at] + i % self.each[at] * length


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit on counts: longest pieces first, each into the open sequence with the least sufficient room."""
    room: dict[int, list[tuple[int, int]]] = {}  # free places -> runs of sequences (first, number)
    sizes: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(free: int, first: int, number: int) -> None:
        if free and number:
            if free not in room:
                room[free] = []
                bisect.insort(sizes, free)
            room[free].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                free = sizes[k]
                first, number = room[free].pop()
                if not room[free]:
                    del room[free], sizes[k]
            else:
                free, first = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            each = free // length
            full = min(number, left // each)
            if full:
                slots.append((length, rank, each, first, capacity - free))
                leave(free - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < number:
                if left:  # fewer than a sequence would take
                    slots.append((length, rank, left, first + full, capacity - free))
                    leave(free - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                leave(free, first + full, number - full)
    slots.sort()
    cols = np.array(slots, np.int64).reshape(-1, 5).T
    return Plan(*cols, sequences=opened)


def _placed(p: Plan):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            sequence, offset = p.place(batch.column(at["length"]).to_numpy(), batch.column(at["place"]).to_numpy())
            keep = [n for n in batch.schema.names if n not in ("task", "place")]
            yield pa.RecordBatch.from_arrays([batch.column(at[n]) for n in keep] + [pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    more = ", ids array<int>" if keep_ids else ""
    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(vocabulary, capacity, end_id, keep_ids), PIECES + more), "pieces")
    counts = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base.hint("merge"), ["length", "task"]).withColumn("place", F.col("base") + F.col("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * keep_ids)]
    schema = PIECES.split(", task")[0] + more + ", sequence_id long, offset long"
    return ranked.select(*names, "task", "place").mapInArrow(_placed(plan(histogram, capacity)), schema)
