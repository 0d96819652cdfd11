"""Quality of documents by attention over their passages (operator 12).

A document is a bag of passages of ``WORDS`` words (the whole text; the last may be shorter). Each passage is encoded: byte classes,
hashed byte pairs and figures of its words go through a learned layer to a vector h. Gated attention,
e = w . (tanh(h V) * sigmoid(h U)), gives the passages of a document weights that sum to 1 (softmax of e), the document is the
weighted sum of its passages' h, and the score is the logistic function of a learned combination of it. All weights are learned together
from document labels (1 good, 0 bad); no passage has a label. Texts are the only input of a score.

Fitting uses at most ``sample_rows`` labelled documents of each label (those with the smallest hash of doc_id) and of these no more than
``SAMPLE_BYTES`` of text; a text above a sixteenth of it is passed over. Each label's documents weigh as much as the label's share of
all labelled rows, so that scores are probabilities. Scoring reads all rows and whole texts; passages are encoded ``HELD`` at a time.

Defined cases: null and empty texts, and texts of blanks, are one passage without words. Labels that are null or neither 0 nor 1
are ignored; of several labels of a doc_id the lowest counts; of several texts of a doc_id that with the smallest hash is learned from. A null doc_id
has no label and counts as the empty text for the fold. Without documents of both labels every score is the share of label 1 (one added to each), 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import column, hash_spans, is_space, slices, spans, tidied

WORDS = 64
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 16 << 20
#: Passages encoded at a time, and bytes counted at a time.
HELD, BYTES = 2048, 1 << 20
#: Sizes of the encoding and of the attention; buckets of byte pairs.
ENCODED, ATTENTION, PAIRS = 24, 16, 256
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.005, 1e-4
THRESHOLD = 0.7


def _kinds() -> np.ndarray:
    """Classes of bytes: each visible ASCII character that is neither letter nor digit by itself; upper case, lower case, digits, line ends, other blanks
    and control characters, and two of bytes above ASCII."""
    kind = np.zeros(256, np.int64)
    marks = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    kind[marks] = np.arange(7, 7 + len(marks))
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A], kind[[10, 13]] = 1, 2, 3, 4
    kind[0x80:0xC0], kind[0xC0:] = 5, 6
    return kind


_KIND = _kinds()
CLASSES = int(_KIND.max()) + 1
FIGURES = 7
FEATURES = CLASSES + PAIRS + FIGURES


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word lengths, words before each passage, passages before each document); every document has a passage."""
    n = int(off[-1])
    starts, lens, ptr = spans(~is_space(data[:n]), off)
    words = np.diff(ptr)
    each = np.maximum(1, -(-words // WORDS))
    before = np.concatenate([[0], np.cumsum(each)])
    place = np.arange(before[-1]) - np.repeat(before[:-1], each)
    first = np.minimum(np.repeat(ptr[:-1], each) + place * WORDS, np.repeat(ptr[1:], each))
    return starts, lens, np.append(first, len(starts)), before


def features(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row for each passage; ``first``: where its words begin, and where the last one's end."""
    n, words = len(first) - 1, np.diff(first)
    out = np.zeros((n, FEATURES), np.float32)
    some = np.flatnonzero(words > 0)
    if not len(some):
        out[:, -1] = 1
        return out
    lo, hi = starts[first[some]], starts[first[some + 1] - 1] + lens[first[some + 1] - 1]
    count = np.zeros((len(some), CLASSES + PAIRS))
    for a in range(int(lo[0]), int(hi[-1]), BYTES):
        b = min(a + BYTES, int(hi[-1]))
        p, q = int(np.searchsorted(hi, a, side="right")), int(np.searchsorted(lo, b))
        if p == q:
            continue
        of = np.searchsorted(lo[p:q], np.arange(a, b), side="right") - 1
        inside = (of >= 0) & (np.arange(a, b) < hi[p:q][np.maximum(of, 0)])
        x, of = data[a : b + 1].astype(np.int64), of[inside]
        pair = ((x[:-1] * 256 + x[1:]) * 40503 >> 8) % PAIRS
        for k, width, value in ((0, CLASSES, _KIND[x[:-1]]), (CLASSES, PAIRS, pair)):
            count[p:q, k : k + width] += np.bincount(of * width + value[inside], minlength=(q - p) * width).reshape(q - p, width)
    out[some, : CLASSES + PAIRS] = np.sqrt(count / (hi - lo)[:, None])
    w0, w1 = int(first[0]), int(first[-1])
    of = np.repeat(np.arange(len(some)), words[some])
    word, length, head = hash_spans(data, starts[w0:w1], lens[w0:w1]), lens[w0:w1], data[starts[w0:w1]]
    upper = (head >= 65) & (head <= 90)
    again = np.append(False, (word[1:] == word[:-1]) & (of[1:] == of[:-1]))
    order = np.lexsort((word, of))
    new = np.append(True, (word[order][1:] != word[order][:-1]) | (of[order][1:] != of[order][:-1]))
    mean = lambda v: np.bincount(of, v, len(some)) / words[some]
    size = mean(np.log1p(length))
    figures = [size, mean(np.log1p(length) ** 2) - size**2, mean(upper), mean(again), np.bincount(of[order], new, len(some)) / words[some], np.log(words[some])]
    out[some, CLASSES + PAIRS : -1] = np.stack(figures, axis=1)
    out[words == 0, -1] = 1
    return out


def encoded(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document of each passage, features) for runs of passages of a slice of documents."""
    starts, lens, first, before = passages(data, off)
    of = np.repeat(np.arange(len(off) - 1), np.diff(before))
    for a in range(0, len(of), HELD):
        b = min(a + HELD, len(of))
        yield of[a:b], features(data, starts, lens, first[a : b + 1])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Attention:
    """The learned arrays: means and scales of features, encoder (a, a0), attention (v, u, w), and the last combination (c, c0)."""

    NAMES = ("a", "a0", "v", "u", "w", "c", "c0")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.a, self.a0 = draw(FEATURES, ENCODED), np.zeros(ENCODED, np.float32)
        self.v, self.u, self.w = draw(ENCODED, ATTENTION), draw(ENCODED, ATTENTION), draw(ATTENTION)
        self.c, self.c0 = draw(ENCODED), np.zeros(1, np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(encoded passages, their attention before the softmax)."""
        h = np.tanh((x - self.mean) / self.scale @ self.a + self.a0)
        return h, (np.tanh(h @ self.v) * _logistic(h @ self.u)) @ self.w

    def gradients(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss of bags; ``x`` is standardised, ``of`` sorted and without gaps."""
        edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        total = lambda v: np.add.reduceat(v, edge, axis=0)
        h = np.tanh(x @ self.a + self.a0)
        t, g = np.tanh(h @ self.v), _logistic(h @ self.u)
        e = (t * g) @ self.w
        p = np.exp(e - np.maximum.reduceat(e, edge)[of])
        share = p / total(p)[of]
        z = total(share[:, None] * h)
        loss = weight * (_logistic(z @ self.c + self.c0) - y) / weight.sum()
        dz = (loss[:, None] * self.c)[of]
        gain = share * (h * dz).sum(axis=1)
        de = gain - share * total(gain)[of]
        dtg = de[:, None] * self.w
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (share[:, None] * dz + dt @ self.v.T + dg @ self.u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ loss, loss.sum(keepdims=True)]

    def train(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 0) -> None:
        """Adam over batches of bags, the rate falling to zero."""
        rng = np.random.default_rng(seed)
        bags = [((b - self.mean) / self.scale).astype(np.float32) for b in bags]
        first = [np.zeros_like(getattr(self, k)) for k in self.NAMES]
        second = [np.zeros_like(f) for f in first]
        step, steps = 0, EPOCHS * -(-len(bags) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for lo in range(0, len(bags), BATCH):
                own = order[lo : lo + BATCH]
                step += 1
                of = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
                for k, g in enumerate(self.gradients(np.concatenate([bags[i] for i in own]), of, y[own], weight[own])):
                    value = getattr(self, self.NAMES[k])
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    value -= (RATE * (1 - (step - 1) / steps) * (move + DECAY * value)).astype(np.float32)


class Pooled:
    """Documents' weighted sums, gathered passage run by passage run (a running softmax), so that no text's passages are held together."""

    def __init__(self, docs: int):
        self.top, self.best, self.n = np.full(docs, -np.inf), np.full(docs, -1, np.int64), np.zeros(docs, np.int64)
        self.weight, self.sum = np.zeros(docs), np.zeros((docs, ENCODED))

    def add(self, of: np.ndarray, h: np.ndarray, e: np.ndarray) -> None:
        edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        own, run = of[edge], np.diff(np.append(edge, len(of)))
        top = np.maximum.reduceat(e, edge)
        where = np.minimum.reduceat(np.where(e == np.repeat(top, run), np.arange(len(e)), len(e)), edge) - edge
        higher = top > self.top[own]
        self.best[own[higher]] = (self.n[own] + where)[higher]
        before = self.top[own]
        self.top[own] = np.maximum(before, top)
        fade = np.exp(before - self.top[own])
        p = np.exp(e - np.repeat(self.top[own], run))
        self.weight[own] = self.weight[own] * fade + np.add.reduceat(p, edge)
        self.sum[own] = self.sum[own] * fade[:, None] + np.add.reduceat(p[:, None] * h, edge, axis=0)
        self.n[own] += run

    def scores(self, model: Attention) -> np.ndarray:
        return _logistic(self.sum / self.weight[:, None] @ model.c + model.c0)


def held_out():
    """Rows that nothing is learned from: CRC-32 of the doc_id's text has remainder 2 modulo 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


@tidied
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text")
        for lo, hi, data, off in slices(texts, BYTES):
            rows: list[list[np.ndarray]] = [[] for _ in range(hi - lo)]
            for of, x in encoded(data, off):
                for d in np.unique(of).tolist():
                    rows[d].append(x[of == d])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([np.concatenate(r).tobytes() for r in rows], pa.binary())], names=["doc_id", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Attention | None, float]:
    """(the model, the share of label 1); no model without both labels."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~held_out())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).join(texts.select("doc_id"), "doc_id", "left_semi")
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    if len(count) < 2:
        return None, share
    place = F.xxhash64("doc_id")
    chosen = {r.doc_id: r.y for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(place, "doc_id").limit(sample_rows).collect()}
    ids = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    text = F.struct(F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    sizes = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(text).alias("t"), F.min(place).alias("place")).collect()
    left, taken = SAMPLE_BYTES, []
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        if r.t.bytes <= min(left, SAMPLE_BYTES // 16):
            left -= r.t.bytes
            taken.append((r.doc_id, r.t.h))
    small = spark.createDataFrame(taken, "doc_id long, h long")
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(small), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "text")
    bags = sorted(rows.mapInArrow(_bags, "doc_id long, bag binary").collect(), key=lambda r: r.doc_id)
    y = np.array([chosen[r.doc_id] for r in bags], np.float32)
    if len(np.unique(y)) < 2:
        return None, share
    found = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, count[1] / found[1], count[0] / found[0]).astype(np.float32)
    x = [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in bags]
    whole = np.concatenate(x)
    model = Attention(whole.mean(axis=0), np.maximum(whole.std(axis=0), 0.02))
    del whole
    model.train(x, y, weight / weight.mean())
    return model, share


def _score(shared):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, off in slices(column(batch, "text"), BYTES):
                pooled = Pooled(hi - lo)
                for of, x in encoded(data, off):
                    pooled.add(of, *model.encode(x))
                rest = [batch.column(k).slice(lo, hi - lo) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(pooled.scores(model).astype(np.float64)), pa.array(pooled.n), pa.array(pooled.best)], names=[*batch.schema.names[:-1], "score", "n_passages", "top_passage"]
                )

    return run


def score(docs: DataFrame, model: tuple[Attention | None, float]) -> DataFrame:
    """doc_id, score, n_passages, top_passage (the one with the most attention, from 0; null without a model) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model[0] is None:
        return rows.select("doc_id", F.lit(model[1]).alias("score"), F.lit(None).cast("long").alias("n_passages"), F.lit(None).cast("long").alias("top_passage"))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType()), T.StructField("top_passage", T.LongType())]
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model[0])), T.StructType(fields))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on), n_passages, top_passage of every row."""
    scored = score(docs, fit(docs, labels, sample_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_passage")
