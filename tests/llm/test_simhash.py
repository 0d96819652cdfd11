import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cdm_engine.llm import simhash


@pytest.fixture(scope="module")
def docs():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 6)))
    docs = [(i * 3, " ".join(word() for _ in range(r.randint(1, 120)))) for i in range(40)]
    return docs + [(121, None), (122, ""), (123, "one"), (124, "😀 é " * 50), (200, docs[4][1]), (201, "Z" * 50_000)]


def test_edits_follow_the_next_document(rows, docs):
    got = {r.doc_id: r for r in simhash.compare_edits(rows(docs).withColumnRenamed("lang", "part").withColumnRenamed("source", "ghost")).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        text, following = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    long = [i for i, t in docs[:40] if len(t) > 200]
    assert all(got[i].near_edited > got[i].near_next for i in long)
    assert got[200].fingerprint == got[docs[4][0]].fingerprint


def test_null_and_repeated_ids_and_one_row(rows):
    got = simhash.compare_edits(rows([(None, "ab cd"), (5, "x y z w"), (5, "k l m n")])).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id) == [(5, 7), (5, 7)] and len(got) == 3
    (one,) = simhash.compare_edits(rows([(1, "abcd")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert simhash.compare_edits(rows([(1, "a")]).where("false")).count() == 0


def test_many_ranges(spark, rows):
    docs = [(i, f"w{i} x") for i in range(700)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 150)
    try:
        dealt = simhash.with_next(rows(docs))
        parts = {(r.part, r.ghost, r.doc_id) for r in dealt.select("part", "ghost", "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    real = sorted((i, p) for p, g, i in parts if not g)
    assert [i for i, _ in real] == list(range(700)) and [p for _, p in real] == sorted(p for _, p in real)
    assert len({p for _, p in real}) > 100 and sum(g for _, g, _ in parts) == len({p for _, p in real})


def test_tables_find_all_within_the_radius(spark):
    r = random.Random(7)
    base = [r.getrandbits(128) for _ in range(60)]
    other = []
    for b in base:
        for _ in range(3):
            x = b
            for bit in r.sample(range(128), r.randint(0, 6)):
                x ^= 1 << bit
            other.append(x)
    hexed = lambda xs: spark.createDataFrame([(f"{x:032x}",) for x in xs], "fingerprint string")
    got = {(x.query, x.fingerprint): x.distance for x in simhash.within(hexed(base), hexed(other), radius=3, blocks=6, bits=128).collect()}
    want = {(f"{a:032x}", f"{b:032x}"): (a ^ b).bit_count() for a in base for b in other if (a ^ b).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("batch", [10_000, 3])
def test_counts_of_neighbours(spark, batch):
    r = random.Random(11)
    fingerprints = []
    for _ in range(25):
        b = r.getrandbits(128)
        for _ in range(r.randint(1, 9)):
            x = b
            for bit in r.sample(range(128), r.randint(0, 4)):
                x ^= 1 << bit
            fingerprints += [x] * r.randint(1, 3)
    df = spark.createDataFrame([(k, f"{x:032x}") for k, x in enumerate(fingerprints)], "doc_id long, fingerprint string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {x.doc_id: x.n_within for x in simhash.with_neighbours(df, every=4, radius=3, bits=128).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {k: sum((x ^ y).bit_count() <= 3 for y in fingerprints) - 1 if k % 4 == 0 else None for k, x in enumerate(fingerprints)}
    assert got == want


def test_votes_by_definition():
    (f,) = simhash.fingerprint_texts(pa.array(["b a b a b"]), 64, 1).tolist()
    import numpy as np

    from cdm_engine.llm._text import K3, mix

    h, ptr = simhash.terms(*next(iter(simhash.slices(pa.array(["b a b a b"]))))[2:], 1)
    x = mix(h, np.full(len(h), K3))
    weight = {v: np.rint(simhash.UNIT * (1 + np.log(n))) for v, n in zip(*map(np.ndarray.tolist, np.unique(x, return_counts=True)), strict=True)}
    want = [sum(w * (1 if v >> b & 1 else -1) for v, w in weight.items()) > 0 for b in range(64)]
    assert [f[b // 8] >> b % 8 & 1 for b in range(64)] == [int(v) for v in want] and ptr.tolist() == [0, 5]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_near_copies_are_neighbours(spark, batch):
    """By default: what brute force finds within RADIUS of 256 bits, which holds most texts with 1.5 % of words replaced."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(r.randint(150, 600))]
        texts.append(" ".join(words))
        for share in (0.005, 0.015, 0.03):
            copy = list(words)
            for at in r.sample(range(len(words)), max(1, round(len(words) * share))):
                copy[at] = word()
            texts.append(" ".join(copy))
    hexed = simhash.hexed(simhash.fingerprint_texts(pa.array(texts)))
    values = [int(x, 16) for x in hexed]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(list(enumerate(hexed)), "doc_id long, fingerprint string")
        got = {x.doc_id: x.n_within for x in simhash.with_neighbours(df, every=4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {k: sum((x ^ y).bit_count() <= simhash.RADIUS for y in values) - 1 if k % 4 == 0 else None for k, x in enumerate(values)}
    assert got == want
    assert sum((values[k] ^ values[k + 2]).bit_count() <= simhash.RADIUS for k in range(0, 160, 4)) > 30


def test_a_repeated_id_is_cut_into_ranges(spark, rows):
    """Null and one other doc_id hold a third of all rows each, with different texts."""
    docs = [(None, f"n{i} x") for i in range(300)] + [(7, f"s{i} x") for i in range(300)] + [(i, f"w{i} x") for i in range(8, 308)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    try:
        dealt = simhash.with_next(rows(docs))
        sizes = [r["count"] for r in dealt.where("not ghost").groupBy(F.spark_partition_id()).count().collect()]
        got = simhash.compare_edits(rows(docs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sum(sizes) == 900 and max(sizes) < 100 and len(sizes) > 20
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in docs)


def test_likeness_by_definition(rows, docs):
    """near_edited and near_next from fingerprints that a plain version makes."""
    import math
    from collections import Counter

    import numpy as np

    from cdm_engine.llm._text import K3, mix

    def plain(text):
        words = (text or "").lower() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text)
        words = words.encode().split()
        grams = [b" ".join(words[k : k + 2]) for k in range(len(words) - 1)] or ([b" ".join(words)] if words else [])
        sums = [0] * 256
        for g, n in Counter(grams).items():
            h, ptr = simhash.terms(*next(iter(simhash.slices(pa.array([g.decode()]))))[2:], 2)
            for lane in range(4):
                x = int(mix(h, np.full(1, K3 + np.uint64(lane)))[0])
                for b in range(64):
                    sums[64 * lane + b] += (1 if x >> b & 1 else -1) * round(simhash.UNIT * (1 + math.log(n)))
        return sum((s > 0) << k for k, s in enumerate(sums))

    like = lambda a, b: max(math.cos(math.pi * (a ^ b).bit_count() / 256), 0.0)
    some = docs[:30]
    got = {r.doc_id: r for r in simhash.compare_edits(rows(some)).collect()}
    for k, (i, t) in enumerate(some):
        following = some[(k + 1) % len(some)][1] or ""
        new = simhash.edited(t or "", following)
        f, g, h = plain(t), plain(new), plain(following)
        assert bytes.fromhex(got[i].fingerprint) == f.to_bytes(32, "little") and bytes.fromhex(got[i].edited_fingerprint) == g.to_bytes(32, "little")
        assert got[i].near_edited == pytest.approx(like(f, g), abs=1e-12) and got[i].near_next == pytest.approx(like(f, h), abs=1e-12)


@pytest.mark.parametrize("text", ["", "one", "one two three", "a b c d e f"])
def test_shingles_of_few_words(text):
    """A slice may have fewer words than a shingle."""
    h, ptr = simhash.terms(*next(iter(simhash.slices(pa.array([text]))))[2:], 5)
    assert len(h) == ptr[-1] == max(len(text.split()) - 4, min(len(text.split()), 1))
