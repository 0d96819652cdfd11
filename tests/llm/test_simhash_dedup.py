import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cdm_engine.llm import golay, simhash_dedup
from cdm_engine.llm.components import components


def brute(values, radius=2):
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.fixture
def cluster():
    rng = np.random.default_rng(5)
    out = set()
    for _ in range(12):
        base = int(rng.integers(0, 2**63))
        out.add(base)
        for _ in range(12):  # chains of members one to three bits apart
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                base ^= 1 << b
            out.add(base)
    return [signed(x) for x in sorted(out)]


def test_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**63, 500, dtype=np.uint64)
    g = f.copy()
    for i in range(len(g)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            g[i] ^= np.uint64(1) << np.uint64(b)
    keys = [set(), set()]
    for k, x in enumerate((f, g)):
        keys[k] = set(zip(*map(np.ndarray.tolist, golay.join_keys(x)), strict=True))
    shared = {r for r, _ in keys[0] & keys[1]}
    assert shared == set(range(500))


@pytest.mark.parametrize("large", [2048, 3])
def test_links_keep_components(spark, cluster, large, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "LARGE", large)
    want = brute(cluster)
    df = spark.createDataFrame([(v,) for v in cluster], "f long")
    label = {r.node: r.label for r in components(simhash_dedup.links(df)).collect()}
    seen = {}
    for v in cluster:
        got = label.get(v, v)
        assert seen.setdefault(want[v], got) == got
    assert len(set(seen.values())) == len(seen)


def test_documents(rows):
    texts = [(1, "A b  c d"), (2, "a B c\td"), (3, None), (4, ""), (5, " \n"), (6, "one"), (7, "x y"), (7, "x y"), (8, "q " * 3000)]
    got = {(r.doc_id): (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(rows(texts)).collect()}
    assert got[1] == got[2] and got[1][1] == 1
    assert got[3] == got[4] == got[5] == ("0" * 16, 3)
    assert got[6][0] == f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert got[7][0] == f"{xxhash.xxh64_intdigest(b'x y', 42):016x}" and got[7][1] == 7
    assert got[8][0] == f"{xxhash.xxh64_intdigest(b'q q q', 42):016x}"


def test_empty_table(rows):
    df = rows([(1, "a")]).where(F.lit(False))
    assert simhash_dedup.near_duplicates(df).count() == 0


@pytest.mark.parametrize("long", [1 << 20, 60])
def test_whole_documents_against_brute_force(rows, long, monkeypatch):
    """Texts of many shingles, repeats included, near copies within 0 to 4 bits, nulls and repeated ids."""
    import random

    monkeypatch.setattr(simhash_dedup, "LONG", long)
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcÄx-") for _ in range(r.randint(1, 3)))
    docs = []
    for k in range(12):
        words = [word() for _ in range(r.randint(3, 700))]
        docs.append((10 * k, " ".join(words)))
        for j in range(1, 6):
            copy = list(words)
            for at in r.sample(range(len(words)), min(len(words), r.randint(0, 2))):
                copy[at] = word()
            docs.append((10 * k + j, r.choice([" ", "\n", "\t "]).join(copy)))
    docs += [(500, None), (501, " \x0b"), (None, docs[4][1]), (None, "only null"), (7, docs[20][1]), (7, docs[20][1])]

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))

    prints = [fingerprint(t) for _, t in docs]
    label = brute([signed(f) for f in set(prints)])
    smallest = {}
    for (i, _), f in zip(docs, prints, strict=True):
        if i is not None:
            smallest[label[signed(f)]] = min(i, smallest.get(label[signed(f)], i))
    want = sorted(((i, f"{f:016x}", smallest.get(label[signed(f)])) for (i, _), f in zip(docs, prints, strict=True)), key=str)
    got = sorted(map(tuple, simhash_dedup.near_duplicates(rows(docs)).collect()), key=str)
    assert got == want
    assert len(set(prints)) > len(set(smallest.values())) + 5  # some links join different fingerprints
