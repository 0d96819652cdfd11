"""Substring dedup by repeated-phrase automata (operator 8).

1. *Confirm recurring passages.* ``_repeats`` finds the windows of ``width`` words whose word sequence also starts
   in a document with a smaller doc_id, and where the document with the smallest has it. Windows
   that follow each other in both documents join into one passage, named by its place in the *first* document.
2. *Compile sharded automata.* A shard serves a block of documents. The texts of the passages that recur in the block are fetched
   from their first documents, wherever these are, and compiled into an Aho-Corasick automaton; no more is known
   about the block's own documents. So a shard's size follows the block and not the corpus, and no document has
   to pass through the shards of passages that it can't hold.
3. *Stream all documents* of the block through its automaton. What it locates, compared byte by byte, word edges included,
   is removed where the passage's first document comes before the one at hand. Nothing else decides.

Long documents pass in parts of ``PART`` words, each with an automaton of its own, and in automata a word above ``WORD`` bytes is
spelled by its 128-bit digest, so that memory and time per byte stay bounded. Defined cases: null text has no words; fewer words than ``width`` keep all; rows with equal doc_id
are not earlier than each other; a null doc_id comes before all others; an empty table gives an
empty table; in ``cut_repeats`` other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import Unit, repeated
from ._rows import KEY, keyed, texts_of, whole
from ._store import materialize, release
from ._text import gather, is_space, slices, spans, tidied

#: Bytes of text in a block of documents, on average.
BLOCK = 1 << 19
#: Words of a document that pass through an automaton at a time.
PART = 1 << 16
#: Bytes of a word that automata spell out.
WORD = 1 << 10


def chained(lo: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, place in the first document, windows) of each maximal run of windows that follow each other both here
    (``lo``) and there (``at``), cut where a part of the document ends."""
    order = np.lexsort((lo, lo - at))
    lo, at, n = lo[order], at[order], n[order]
    head = np.flatnonzero(np.append(True, (lo[1:] - at[1:] != lo[:-1] - at[:-1]) | (lo[1:] > lo[:-1] + n[:-1])))
    end = (lo + n)[np.append(head[1:], len(lo)) - 1]
    first = lo[head]
    pieces = (end - 1) // PART - first // PART + 1
    which = np.repeat(np.arange(len(head)), pieces)
    part = gather(np.arange(int((first // PART + pieces).max())), first // PART, pieces)
    start = np.maximum(first[which], part * PART)
    return part, at[head][which] + start - first[which], np.minimum(end[which], (part + 1) * PART) - start


@tidied
def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(4)
        flat, ptr = found.flatten(), found.offsets.to_numpy()
        ptr = ptr - ptr[0]
        lo, at, n = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
        out = [chained(lo[a:b], at[a:b], n[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
        row = pa.array(np.repeat(np.arange(len(out)), [len(x[0]) for x in out]))
        part, start, many = (pa.array(np.concatenate([x[k] for x in out] or [lo]).astype(np.int32)) for k in range(3))
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(4)), part, start, many], names=["block", "id", *KEY, "part", "at", "n"])


def normal(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of the words, a space after each."""
    padded = np.where(is_space(data), np.uint8(32), data)  # the byte after a word is white space or padding
    out = gather(padded, starts, lens + 1)
    out[np.cumsum(lens + 1) - 1] = 32
    return out


def spelled(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the words as automata see them, a space after each; their lengths there)."""
    long = np.flatnonzero(lens > WORD)
    if not len(long):
        return normal(data, starts, lens).tobytes(), lens
    out, seen, at = [], lens.copy(), 0
    for i in long.tolist():
        word = data[starts[i] : starts[i] + lens[i]]
        out += [normal(data, starts[at:i], lens[at:i]).tobytes(), b"\0", hashlib.blake2b(word, digest_size=16).hexdigest().encode(), b" "]
        seen[i], at = 33, i + 1
    out.append(normal(data, starts[at:], lens[at:]).tobytes())
    return b"".join(out), seen


def _phrases(width: int):
    """(ka, kb, at, n, phrase) of the passages asked of a document: its words from ``at`` on, a space around each."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb = (batch.column(batch.schema.get_field_index(k)) for k in KEY)
            asked = batch.column(batch.schema.get_field_index("asked"))
            for first, end, data, off in slices(texts_of(batch)):
                starts, lens, ptr = spans(~is_space(data), off)
                for i in range(first, end):
                    pairs = asked[i].values
                    at, n = (pairs.field(k).to_numpy() for k in (0, 1))
                    base, texts = int(ptr[i - first]), []
                    for a, m in zip(at.tolist(), n.tolist(), strict=True):
                        s = slice(base + a, base + a + m + width - 1)
                        lo, hi = int(starts[s][0]), int(starts[s][-1] + lens[s][-1])
                        texts.append(spelled(data[lo : hi + 8], starts[s] - lo, lens[s])[0])
                    each = pa.array(np.full(len(texts), i))
                    yield pa.RecordBatch.from_arrays([ka.take(each), kb.take(each), pairs.field(0), pairs.field(1), pa.array(texts, pa.binary())], names=[*KEY, "at", "n", "phrase"])

    return run


def _placed(own: DataFrame, width: int) -> DataFrame:
    """Rows by block: first the passages that recur in it (kind 0: id of the first document, part, windows, phrase), then its
    documents (kind 1: id and the columns of ``own``)."""
    text = "text" if "text" in own.columns else "row.text"
    blocks = own.agg(F.sum(F.octet_length(text))).first()[0] or 0
    block = F.pmod("ka", F.lit(blocks // BLOCK + 1)).alias("block")
    found, tables = repeated(own, Unit("words", width), True)
    chains = found.groupBy(block, *[F.col(f"rep.{k}").alias(k + "_first") for k in ("id", *KEY)], *KEY).agg(F.collect_set(F.struct("lo", F.col("rep.lo").alias("at"), "n")).alias("found"))
    chains = chains.select("block", "id_first", "ka_first", "kb_first", "found")
    routes = chains.mapInArrow(_routes, "block long, id long, ka long, kb long, part int, at int, n int").distinct()
    routes = materialize(routes, "routes")
    release(*tables)
    asked = materialize(routes.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("asked")), "asked")
    phrases = own.join(asked, KEY).mapInArrow(_phrases(width), "ka long, kb long, at int, n int, phrase binary")
    phrases = materialize(phrases, "phrases")
    known = routes.join(phrases, [*KEY, "at", "n"]).select("block", F.lit(0).alias("kind"), "part", "id", "phrase")
    rest = [c for c in own.columns if c not in ("id", *KEY)]
    docs = own.select(block, F.lit(1).alias("kind"), F.lit(0).alias("part"), "id", *rest)
    return known.unionByName(docs, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")


class Shard:
    """The passages of a block, and their automata by part."""

    def __init__(self):
        self.known: dict[int, dict[str, int]] = {}
        self.ready: dict[int, ahocorasick.Automaton] = {}

    def add(self, part: int, phrase: bytes, first: int) -> None:
        known, text = self.known.setdefault(part, {}), " " + phrase.decode("latin-1")  # a character for each byte
        known[text] = min(first, known.get(text, first))

    def automaton(self, part: int) -> ahocorasick.Automaton | None:
        if part not in self.known:
            return None
        if part not in self.ready:
            if part:  # of the later parts one at a time
                self.ready = {k: a for k, a in self.ready.items() if not k}
            made = ahocorasick.Automaton()
            for text, first in self.known[part].items():
                made.add_word(text, (first, len(text)))
            made.make_automaton()
            self.ready[part] = made
        return self.ready[part]

    def located(self, number: int, part: int, text: bytes, edge: np.ndarray) -> np.ndarray:
        """Which words of a document's part go. ``edge``: the place of the space after each word."""
        made = self.automaton(part)
        at = [] if made is None else [(end - size + 1, end) for end, (first, size) in made.iter(" " + text.decode("latin-1")) if first < number]
        d = np.zeros(len(edge) + 1, np.int32)
        if at:
            start, end = np.array(at).T
            np.add.at(d, np.searchsorted(edge, start - 1, side="right"), 1)  # the space before the first word
            np.add.at(d, np.searchsorted(edge, end - 1) + 1, -1)
        return np.cumsum(d[:-1]) > 0


def _judged(shard: Shard, number: int, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, Iterator[bytes]]:
    """(which words go, the kept words, a space after each, in pieces)."""
    gone = np.zeros(len(starts), bool)
    for part, a in enumerate(range(0, len(starts), PART)):
        if part in shard.known:
            s = slice(a, min(len(starts), a + PART + width - 1))
            lo, hi = int(starts[s][0]), int(starts[s][-1] + lens[s][-1])
            text, seen = spelled(data[lo : hi + 8], starts[s] - lo, lens[s])
            gone[s] |= shard.located(number, part, text, np.cumsum(seen + 1) - 1)

    def kept() -> Iterator[bytes]:
        for a in range(0, len(starts), PART):
            keep = np.flatnonzero(~gone[a : a + PART]) + a
            if len(keep):
                lo, hi = int(starts[keep[0]]), int(starts[keep[-1]] + lens[keep[-1]])
                yield normal(data[lo : hi + 8], starts[keep] - lo, lens[keep]).tobytes()

    return gone, kept()


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, Iterator[bytes]]]]]:
    """Slices of documents and what ``_judged`` says of each; the passages of a block come before its documents."""
    block, shard = None, Shard()
    for batch in batches:
        at = {name: k for k, name in enumerate(batch.schema.names)}
        kind, of = batch.column(at["kind"]).to_numpy(), batch.column(at["block"]).to_numpy()
        cut = np.append(np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]))), len(kind))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b == a:
                continue
            if of[a] != block:
                block, shard = of[a], Shard()
            rows = batch.slice(a, b - a)
            if not kind[a]:
                for part, phrase, first in zip(*(rows.column(at[k]) for k in ("part", "phrase", "id")), strict=True):
                    shard.add(part.as_py(), phrase.as_py(), first.as_py())
                continue
            number = rows.column(at["id"]).to_numpy()
            for lo, hi, data, off in slices(texts_of(rows)):
                starts, lens, ptr = spans(~is_space(data), off)
                yield rows.slice(lo, hi - lo), [_judged(shard, int(number[i]), data, *(x[ptr[i - lo] : ptr[i - lo + 1]] for x in (starts, lens)), width) for i in range(lo, hi)]


def _digests(width: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, judged in _blocks(batches, width):
            total, removed, sha = [], [], []
            for gone, kept in judged:
                digest, last = hashlib.sha256(), b""
                for piece in kept:
                    digest.update(last + piece[:-1])
                    last = b" "
                total.append(len(gone))
                removed.append(int(gone.sum()))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def repeat_digests(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    own = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    return _placed(own, width).mapInArrow(_digests(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, where there is one) after later occurrences are taken
    out; texts that lose words have their other words joined by one space, the rest stay as they are."""
    names = docs.columns

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, judged in _blocks(batches, width):
            row = rows.column(rows.schema.get_field_index("row"))
            parts = {f.name: row.field(i) for i, f in enumerate(row.type)}
            texts = [b"".join(kept)[:-1].decode() if gone.any() else old.as_py() for old, (gone, kept) in zip(parts["text"], judged, strict=True)]
            parts["text"] = pa.array(texts, pa.string())
            if "n_chars" in parts:
                parts["n_chars"] = pa.array([len(t or "") for t in texts], parts["n_chars"].type)
            yield pa.RecordBatch.from_arrays([parts[c] for c in names], names=names)

    return _placed(whole(docs), width).mapInArrow(run, docs.schema)
