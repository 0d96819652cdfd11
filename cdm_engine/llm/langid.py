"""Language identification with interpolated Kneser-Ney character models (operator 5).

One model of order ``order`` per language over the letters of words (lower case, with word edges).
Orders below the highest count the distinct symbols that come before (Kneser-Ney), each order has the
discount n1 / (n1 + 2 n2), and probabilities interpolate with the next lower order. The models share
sorted arrays of n-gram hashes, so that one binary search serves all languages; each n-gram points to the discounted
probabilities (or interpolation weights) of the languages that have it, and only of these.

A text gets the language of the lowest cross-entropy per symbol. Its score is the share of that language in the likelihoods
of all, tempered by the power that gives the sampled rows left out of the counts their labels with the
least log loss. Words are scored once per distinct
word of a slice; sums are whole numbers, so that equal texts score alike wherever they stand.

Rejection is calibrated on sampled rows that the counts leave out: a text goes if its cross-entropy is
above the language's mean by more than half the way to what texts of other languages have under that
model, and by more than the largest excess seen among the language's own rows, scaled by the square
root of the length (short texts vary more).

Fitting uses at most ``sample_rows`` labelled rows per language (those with the smallest hash of doc_id and text; copies of
a row count once), of every label, and of these no more than ``SAMPLE_BYTES`` of text in all, an equal share for each
language, but one row at least; everything else reads all rows. Defined cases: null texts and texts without letters are
``und``; without training rows every text is ``und``; null doc_ids count as the empty text for the fold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._rows import KEY, keyed
from ._text import K3, column, cut_words, gather, hash_spans, mix, slices, spans, tidied

SAMPLE_ROWS = 500
#: Bytes of text that fitting holds on the driver.
SAMPLE_BYTES = 16 << 20
ORDER = 5
#: Part of the way from the own language's mean to other languages' at which rejection starts.
MARGIN = 0.5
#: Log probabilities are summed as whole multiples of 1 / SCALE.
SCALE = 1 << 16
#: Probabilities (symbols by languages) held at a time.
HELD = 1 << 21
#: Temperatures that the calibration of scores tries.
TEMPERATURES = tuple(2.0**k for k in range(13))
REMEMBERED = 300_000
#: Languages above which fewer words are held at a time, so that the sums of words by languages don't grow.
WIDE = 16


def letters(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, places that are predicted, word of each such place). Runs of letters with
    ``order - 1`` edge symbols (0) before each; the edge after a run is predicted, too."""
    text = "\n".join(words).lower()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter = np.zeros(0x110000, bool)
    kinds = np.flatnonzero(np.bincount(codes)) if len(codes) else codes
    letter[kinds] = [chr(c).isalpha() for c in kinds.tolist()]
    is_letter = letter[codes]
    start, lens, _ = spans(is_letter, np.array([0, len(codes)]))
    word = np.searchsorted(np.flatnonzero(codes == 10), start)
    pad = order - 1
    head = np.cumsum(lens + pad) - lens  # where each run's letters go
    out = np.zeros(int((lens + pad).sum()) + 1, np.uint32)
    places = gather(np.arange(len(out)), head, lens + 1)
    inside = gather(np.arange(len(codes)), start, lens)
    out[gather(np.arange(len(out)), head, lens)] = codes[inside]
    return out, places, np.repeat(word, lens + 1)


def grams(x: np.ndarray, places: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(n-gram, its context)] hashes at the places, for n = 1 to order."""
    x = x.astype(np.uint64)
    whole = mix(x, np.full(len(x), K3))
    context = np.full(len(places), K3)
    out = []
    for n in range(1, order + 1):
        if n > 1:
            nxt = whole.copy()
            nxt[n - 1 :] = mix(whole[n - 1 :], x[: len(x) - n + 1])
            context = whole[places - 1] if len(places) else whole[:0]
            whole = nxt
        out.append((whole[places], context))
    return out


class Models:
    """Interpolated Kneser-Ney models of several languages in sorted hash arrays."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        self.order, self.languages = order, sorted(counts)
        found: list[list] = [[] for _ in range(order)]
        symbols = set()
        for language in self.languages:
            words = list(counts[language])
            x, places, word = letters(words, order)
            weight = np.fromiter(counts[language].values(), np.float64, len(words))[word]
            symbols.update(np.unique(x[places]).tolist())
            above = None
            levels = grams(x, places, order)
            for n in range(order, 0, -1):
                g, c = levels[n - 1]
                key, first, which = np.unique(g, return_index=True, return_inverse=True)
                # distinct (n + 1)-grams that end in this n-gram, or at the highest order its occurrences
                count = np.bincount(which, weight) if above is None else np.bincount(which[above], minlength=len(key)).astype(float)
                above = first
                once, twice = (count == 1).sum(), (count == 2).sum()
                discount = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
                ctx, of = np.unique(c[first], return_inverse=True)
                total = np.bincount(of, count)
                kinds = np.bincount(of)
                found[n - 1].append((key, np.maximum(count - discount, 0) / total[of], ctx, discount * kinds / total))
        self.base = 1 / (len(symbols) + 1)
        self.levels = [tuple(_sparse([(o[k], o[k + 1]) for o in own]) for k in (0, 2)) for own in found]

    def state(self) -> tuple:
        """Plain values and arrays, for a broadcast."""
        return self.order, self.languages, self.base, self.levels

    @classmethod
    def of(cls, state: tuple) -> Models:
        own = cls.__new__(cls)
        own.order, own.languages, own.base, own.levels = state
        return own

    def words(self, words: list[str]) -> np.ndarray:
        """Per word: scaled log probability in each language, then the number of symbols."""
        out = np.zeros((len(words), len(self.languages) + 1), np.int64)
        x, places, word = letters(words, self.order)
        step = max(1, HELD // max(1, len(self.languages)))
        for a in range(0, len(places), step):
            at, of = places[a : a + step], word[a : a + step]
            lo = int(at[0]) - self.order + 1  # order - 1 symbols stand before the first place
            scaled = np.rint(np.log(self.probabilities(x[lo : int(at[-1]) + 1], at - lo)) * SCALE).astype(np.int64)
            edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            out[of[edge], :-1] += np.add.reduceat(scaled, edge, axis=0)
            out[of[edge], -1] += np.diff(np.append(edge, len(of)))
        return out

    def probabilities(self, x: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the symbols at the places, in each language."""
        p = np.full((len(places), len(self.languages)), self.base)
        for (g, c), (seen, weight) in zip(grams(x, places, self.order), self.levels, strict=True):
            live, row, language, w = _found(weight, c)  # elsewhere the lower order holds
            p[row, language] *= w
            _, row, language, more = _found(seen, g[live])
            p[live[row], language] += more
        return p


def _sparse(own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, where the entries of each begin, languages and values of the entries) of each language's (hashes, values)."""
    key = np.concatenate([k for k, _ in own])
    language = np.repeat(np.arange(len(own), dtype=np.int32), [len(k) for k, _ in own])
    value = np.concatenate([v for _, v in own]).astype(np.float32)
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return keys, np.append(first, len(key)), language[order], value[order]


def _found(table: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which of the wanted hashes are there; and for each of their entries which one, language, value)."""
    keys, first, language, value = table
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    live = np.flatnonzero(keys[at] == wanted)
    n = (first[1:] - first[:-1])[at[live]]
    entry = np.repeat(first[at[live]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return live, np.repeat(live, n), language[entry], value[entry]


class Scorer:
    """Sums over whole texts by way of their distinct words."""

    def __init__(self, models: Models, temperature: float = 1.0):
        self.models, self.temperature = models, temperature
        self.share = max(1, len(models.languages) / WIDE)
        self.forget()

    def slices(self, texts: pa.Array, target: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        return slices(texts, max(1, int(target / self.share)))

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.rows = np.zeros((int((1 << 14) / self.share) + 1, len(self.models.languages) + 1), np.int64)

    def totals(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(self.known) > REMEMBERED / self.share:
            self.forget()
        low, starts, lens, ptr, _ = cut_words(data, off)
        key, first, which = np.unique(hash_spans(low, starts, lens), return_index=True, return_inverse=True)
        new = [(k, i) for k, i in zip(key.tolist(), first.tolist(), strict=True) if k not in self.known]
        if new:
            raw = low.tobytes()
            a = len(self.known)
            while a + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[a : a + len(new)] = self.models.words([raw[starts[i] : starts[i] + lens[i]].decode() for _, i in new])
            self.known.update(zip((k for k, _ in new), range(a, a + len(new)), strict=True))
        at = np.fromiter(map(self.known.__getitem__, key.tolist()), np.int64, len(key))[which]
        sums = np.zeros((len(at) + 1, self.rows.shape[1]), np.int64)
        np.cumsum(self.rows[at], axis=0, out=sums[1:])
        return sums[ptr[1:]] - sums[ptr[:-1]]

    def judged(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, cross-entropy in nats, score)."""
        n = np.maximum(totals[:, -1:], 1)
        cross = -totals[:, :-1] / (n * SCALE)
        best = cross.argmin(axis=1)
        odds = np.exp(-(cross - cross.min(axis=1, keepdims=True)) * n / self.temperature)
        return best, cross[np.arange(len(best)), best], 1 / odds.sum(axis=1)


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from: CRC-32 of the doc_id's text has remainder 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sample(own: DataFrame, sample_rows: int) -> list[tuple]:
    """(ka, kb, lang, rank) of each language's rows to learn from. Only
    hashes below a share of the range that holds some four times as many rows are ranked, so that no
    language's rows gather in one task; should fewer distinct rows lie there, all are ranked."""
    numbers = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.lang: r.n for r in numbers.collect()}
    if not counts:
        return []
    share = [(lang, min(2**63 - 1, int(2**63 * 4 * sample_rows / n))) for lang, n in counts.items()]
    share = own.sparkSession.createDataFrame(share, T.StructType([own.schema["lang"], T.StructField("most", T.LongType())]))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", "kb"))
    near = own.select(*KEY, "lang", F.octet_length("text").alias("bytes"), F.shiftrightunsigned("ka", 1).alias("place")).join(F.broadcast(share), "lang")
    for rows in (near.where("place <= most"), near):
        ranked = rows.distinct().withColumn("rank", rank).where(F.col("rank") <= sample_rows).collect()
        if len(ranked) == sum(min(n, sample_rows) for n in counts.values()):
            break
    most, ids = SAMPLE_BYTES // len(counts), []
    used: dict[str, int] = {}
    for r in sorted(ranked, key=lambda r: (r.bytes > most, r["rank"])):  # rows beyond a whole share come last
        if r.lang not in used or used[r.lang] + r.bytes <= most:
            used[r.lang] = used.get(r.lang, 0) + r.bytes
            ids.append((r.ka, r.kb, r.lang, r["rank"]))
    return ids


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, order: int = ORDER, margin: float = MARGIN) -> tuple[Scorer, np.ndarray] | None:
    """Models and, per language, (mean cross-entropy, tolerated excess, additional one times root of length)."""
    own = keyed(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text"))
    ids = _sample(own, sample_rows)
    if not ids:
        return None
    long = T.LongType()
    small = docs.sparkSession.createDataFrame(ids, T.StructType([*(T.StructField(k, long) for k in KEY), docs.schema["lang"], T.StructField("rank", T.IntegerType())]))
    rows = own.select(*KEY, "lang", "text").join(F.broadcast(small), [*KEY, "lang"]).dropDuplicates([*KEY, "lang"])
    texts = sorted(rows.select("lang", "rank", "text").collect(), key=lambda r: (r.lang, r["rank"]))
    counts: dict[str, Counter] = {}
    aside = []
    for r in texts:
        if r["rank"] % 5:
            counts.setdefault(r.lang, Counter()).update(r.text.split())
        else:
            aside.append((r.lang, r.text))
    for lang, text in aside:
        if lang not in counts:
            counts[lang] = Counter(text.split())
    scorer = Scorer(Models(counts, order))
    sums = np.concatenate([scorer.totals(data, off) for _, _, data, off in scorer.slices(pa.array([t for _, t in aside], pa.string()), 1 << 20)] or [np.zeros((0, len(counts) + 1), np.int64)])
    number = {x: k for k, x in enumerate(scorer.models.languages)}
    label = np.array([number[x] for x, _ in aside], np.int64)
    some = sums[:, -1] > 0
    sums, label = sums[some], label[some]
    cross = -sums[:, :-1] / (np.maximum(sums[:, -1:], 1) * SCALE)
    worst = -np.log(scorer.models.base)
    limits = np.zeros((len(counts), 3))
    for k in range(len(counts)):
        own_rows, n = label == k, np.sqrt(sums[:, -1])
        mean = np.average(cross[own_rows, k], weights=sums[own_rows, -1]) if own_rows.any() else worst
        other = cross[~own_rows, k].mean() if (~own_rows).any() else worst
        excess = ((cross[own_rows, k] - mean) * n[own_rows]).max() if own_rows.any() else 0
        limits[k] = mean, margin * max(other - mean, 0), max(excess, 1)
    scorer.forget()
    if len(label):  # the temperature with the least log loss of the labels
        gap = (cross - cross.min(axis=1, keepdims=True)) * sums[:, -1:]
        loss = [np.mean(gap[np.arange(len(label)), label] / t + np.log(np.exp(-gap / t).sum(axis=1))) for t in TEMPERATURES]
        scorer.temperature = TEMPERATURES[int(np.argmin(loss))]
    return scorer, limits


def _predict(shared):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, limits, temperature = shared.value
        models = Models.of(state)
        scorer = Scorer(models, temperature)
        names = np.array([*models.languages, "und"], object)
        for batch in batches:
            for lo, hi, data, off in scorer.slices(column(batch, "text"), 1 << 19):
                totals = scorer.totals(data, off)
                best, cross, score = scorer.judged(totals)
                none = totals[:, -1] == 0
                limit = limits[best, 0] + limits[best, 1] + limits[best, 2] / np.sqrt(np.maximum(totals[:, -1], 1))
                best, score = np.where(none, len(models.languages), best), np.where(none, 0.0, score)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in range(batch.num_columns)), pa.array(names[best], pa.string()), pa.array(score), pa.array(none | (cross > limit))],
                    names=[*batch.schema.names, "lang_pred", "score", "rejected"],
                )

    return run


def predict(docs: DataFrame, model: tuple[Scorer, np.ndarray] | None) -> DataFrame:
    """``docs`` and lang_pred, score, rejected. Predictions read the text alone."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast((model[0].models.state(), model[1], model[0].temperature))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(_predict(shared), schema)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    plain = docs.select("doc_id", "text", F.col("lang"))
    out = predict(plain.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(plain, sample_rows))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that are rejected; the models learn from the same rows."""
    names = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text", "lang") else f"column_{k}" for k, c in enumerate(names)])
    judged = predict(plain, fit(plain, sample_rows))
    return judged.where("not rejected").select(*plain.columns).toDF(*names)
