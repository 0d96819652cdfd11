import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cdm_engine.llm import _repeats, substring_dedup, suffix_dedup
from cdm_engine.llm._text import slices as suffix_slices


def brute_bytes(docs, width):
    blobs = [(t or "").encode() for _, t in docs]
    seen = Counter(b[k : k + width] for b in blobs for k in range(len(b) - width + 1))
    out = []
    for (i, _), b in zip(docs, blobs, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_words(docs, width):
    first, words = {}, [((t or "").encode().split(), i) for i, t in docs]
    key = lambda i: -(2**63) if i is None else i
    for w, i in words:
        for k in range(len(w) - width + 1):
            p = tuple(w[k : k + width])
            first[p] = min(first.get(p, key(i)), key(i))
    out = []
    for w, i in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    pool = [" ".join(word() for _ in range(r.randint(3, 90))) for _ in range(14)]
    docs = [(i, " ".join(r.choice(pool) if r.random() < 0.6 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 5)))) for i in range(70)]
    docs += [(100, None), (101, ""), (102, "é" * 300), (103, "a " * 200), (104, "a " * 130 + "b"), (7, docs[8][1]), (7, docs[8][1]), (None, docs[9][1]), (105, "x y" * 5), (106, docs[3][1].replace(" ", "\n"))]
    return docs


@pytest.mark.parametrize("width", [200, 40, 12])
def test_bytes_against_brute_force(rows, corpus, width):
    got = sorted(map(tuple, suffix_dedup.repeat_digests(rows(corpus), width).collect()), key=str)
    assert got == brute_bytes(corpus, width)


@pytest.mark.parametrize("width", [50, 40, 12, 5])
def test_words_against_brute_force(rows, corpus, width):
    got = sorted(map(tuple, substring_dedup.repeat_digests(rows(corpus), width).collect()), key=str)
    assert got == brute_words(corpus, width)


def test_small_blocks_give_the_same(rows, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 300)
    monkeypatch.setattr(substring_dedup, "PART", 37)
    monkeypatch.setattr(substring_dedup, "WORD", 3)
    assert sorted(map(tuple, substring_dedup.repeat_digests(rows(corpus), 12).collect()), key=str) == brute_words(corpus, 12)


@pytest.mark.parametrize("width", [200, 40, 12])
def test_long_documents_in_parts_give_the_same(rows, corpus, width, monkeypatch):
    monkeypatch.setattr(_repeats, "LONG", 2 * width + 3)
    monkeypatch.setattr(_repeats, "slices", lambda arr, target=0: suffix_slices(arr, 1))
    got = sorted(map(tuple, suffix_dedup.repeat_digests(rows(corpus), width).collect()), key=str)
    assert got == brute_bytes(corpus, width)
    if width == 12:
        got = sorted(map(tuple, substring_dedup.repeat_digests(rows(corpus), width).collect()), key=str)
        assert got == brute_words(corpus, width)


def test_the_automata_decide(rows, corpus, monkeypatch):
    """Without what they locate nothing is removed."""
    monkeypatch.setattr(substring_dedup.Shard, "located", lambda self, number, part, text, edge: np.zeros(len(edge), bool))
    assert sum(x for _, _, x, _ in brute_words(corpus, 12)) > 0
    assert {r.n_removed for r in substring_dedup.repeat_digests(rows(corpus), 12).collect()} == {0}


def test_cut_keeps_columns_and_characters(rows, corpus):
    df = rows(corpus).withColumnsRenamed({"source": "runs", "lang": "id"}).withColumn("th", F.lit(1.5))
    out = suffix_dedup.cut_repeats(df, 40)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(corpus) and all(r.n_chars == len(r.text) and "�" not in r.text for r in got)
    removed = {i: n for i, _, n, _, _ in brute_bytes(corpus, 40)}
    assert {r.doc_id: r.text for r in got if r.doc_id and not removed[r.doc_id]} == {i: t or "" for i, t in corpus if i and not removed[i]}
    again = substring_dedup.cut_repeats(df, 12)
    assert again.columns == df.columns and again.count() == len(corpus)


def test_empty_table(rows):
    df = rows([(1, "a")]).where("false")
    assert suffix_dedup.repeat_digests(df).count() == 0 == substring_dedup.repeat_digests(df).count()


def test_anchors_cover_every_window():
    rng = np.random.default_rng(0)
    data = np.append(rng.integers(97, 99, 700), np.zeros(8)).astype(np.uint8)
    off = np.array([0, 0, 10, 350, 360, 700])
    doc, _, _, lo, n, _ = _repeats.anchors(_repeats.Unit("bytes", 20), data, off)
    windows = [(d, s) for d, a, k in zip(doc.tolist(), lo.tolist(), n.tolist(), strict=True) for s in range(a, a + k)]
    assert sorted(windows) == [(d, s) for d in range(5) for s in range(max(0, int(off[d + 1] - off[d]) - 19))]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_passage_of_two_documents_in_any_session(spark, rows, ansi):
    """size(null) is -1 without ANSI mode."""
    r = random.Random(9)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = make(3000)
    docs = [(1, make(250) + passage + make(60)), (2, make(80) + passage + make(210))]
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = sorted(map(tuple, suffix_dedup.repeat_digests(rows(docs), 200).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
    assert got == brute_bytes(docs, 200) and got[0][2] >= 3000
