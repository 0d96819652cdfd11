import random

import pytest

import corpus_pipeline as P
from cdm_engine.llm import near_copies, simhash_dedup


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def components(docs):
    label = {i: i for i, _ in docs}
    for k, (i, t) in enumerate(docs):
        for j, u in docs[:k]:
            if similarity(t, u) >= 0.8:
                x, y = label[i], label[j]
                label = {n: min(x, y) if v in (x, y) else v for n, v in label.items()}
    return label


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    docs, i = [], 0
    for _ in range(30):
        n = r.randint(60, 400)
        words = [word() for _ in range(n)]
        docs.append((i, " ".join(words)))
        for k in range(3):  # 0.4, 1 and 3.5 % of words replaced
            copy = list(words)
            for at in r.sample(range(n), max(1, round(n * (0.004, 0.01, 0.035)[k]))):
                copy[at] = word()
            docs.append((i + 1 + k, " ".join(copy)))
        i += 4
    return docs + [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (904, "one three")]


@pytest.mark.parametrize("large", [1024, 1])
def test_near_copies_leave_whatever_their_fingerprints(spark, rows, docs, large, monkeypatch):
    monkeypatch.setattr(near_copies, "LARGE", large)
    label = components([(i, t or "") for i, t in docs])
    assert 20 < sum(label[i] != i for i, _ in docs) < 80
    got = {r.doc_id for r in P.near_copies(spark, rows(docs), "").collect()}
    assert got == set(label.values())
    assert len({r.doc_id for r in simhash_dedup.keep_one(rows(docs), size=3).collect()}) > len(got) + 10


def test_links_only_above_the_similarity(spark, rows):
    r = random.Random(4)
    words = [f"w{r.random()}" for _ in range(104)]
    docs = []
    for k, cut in enumerate((104, 85, 84, 83, 64)):  # of 100 shingles 100, 81, 80, 79 and 60
        docs.append((k, " ".join(words[:cut])))
    chain = {k for k in range(5) if k and similarity(docs[k][1], docs[0][1]) < 0.8}
    assert chain == {3, 4}
    got = {r.doc_id for r in simhash_dedup.keep_unlike(rows([docs[0], docs[3]]), 5, 0.8).collect()}
    assert got == {0, 3}
    got = {r.doc_id for r in simhash_dedup.keep_unlike(rows(docs[:3]), 5, 0.8).collect()}
    assert got == {0}


def test_pairs_whose_star_fails_are_compared(spark, rows):
    """The forest of a bucket may hold only links that fail, though two of its other members are alike."""
    r = random.Random(5)
    base = [f"w{r.random()}" for _ in range(204)]
    docs = [(0, " ".join(base))]
    for k in range(1, 40):  # each 0.74 to 0.79 like the base, and pairwise alike or not
        copy = list(base)
        for at in r.sample(range(10, 190), 4 + k % 2):
            copy[at] = f"x{r.random()}"
        docs.append((k, " ".join(copy)))
    twin = docs[7][1].split()
    twin[200] = "other"
    docs.append((50, " ".join(twin)))
    got = {r.doc_id for r in simhash_dedup.keep_unlike(rows(docs), 5, 0.8).collect()}
    assert got == set(components(docs).values())


def test_templates_bring_hardly_any_texts_together(spark, rows, monkeypatch):
    """Texts of a template, each with words of its own, are less alike than the threshold: fingerprints tell them apart."""
    r = random.Random(6)
    base, docs = [f"w{r.random()}" for _ in range(200)], []
    for k in range(1500):
        copy = list(base)
        for at in r.sample(range(200), 10):
            copy[at] = f"x{r.random()}"
        docs.append((k, " ".join(copy)))
    twin = docs[700][1].split()
    twin[100] = "other"
    docs.append((5000, " ".join(twin)))
    asked, texts = [], near_copies._texts

    def counted(nodes, *rest):
        asked.append(nodes.count())
        return texts(nodes, *rest)

    monkeypatch.setattr(near_copies, "_texts", counted)
    got = {x.doc_id for x in simhash_dedup.keep_unlike(rows(docs), 5, 0.8).collect()}
    assert got == set(range(1500)) and sum(asked) < 60


def test_recall_of_pairs_just_above_the_similarity(spark, rows):
    r = random.Random(7)
    docs, n = [], 0
    while n < 1000:
        words = [f"w{r.random()}" for _ in range(r.randint(80, 400))]
        copy = list(words)
        for at in r.sample(range(len(words)), max(1, round(len(words) * r.uniform(0.016, 0.024)))):
            copy[at] = f"x{r.random()}"
        if 0.8 <= similarity(" ".join(words), " ".join(copy)) <= 0.85:
            docs += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))]
            n += 1
    got = {x.doc_id for x in simhash_dedup.keep_unlike(rows(docs), 5, 0.8).collect()}
    assert len(got & set(range(0, 2000, 2))) == 1000 and 2000 - len(got) >= 970


def test_short_texts_have_room_for_ties():
    """Sets of few shingles differ in more bits at the same similarity."""
    import numpy as np

    from cdm_engine.llm.simhash import signs

    r, worst = np.random.default_rng(8), 0
    for n, m, shared in ((4, 5, 4), (5, 6, 5), (8, 10, 8), (9, 9, 8), (16, 20, 16), (36, 36, 32), (64, 80, 64), (72, 72, 64), (160, 200, 160)):
        pool = r.integers(0, 2**63, (300, n + m - shared)).astype(np.uint64)
        sides = [np.sort(x, axis=1) for x in (pool[:, :n], np.concatenate([pool[:, :shared], pool[:, n:]], axis=1))]
        bits = [signs(x.ravel(), np.arange(301) * x.shape[1], 1152) for x in sides]
        raw = [near_copies._raw(np.array([b.tobytes() for b in np.concatenate([f, np.full((300, 1), x.shape[1], "<u8").view(np.uint8)], axis=1)], object)) for f, x in zip(bits, sides)]
        assert near_copies._near(*raw).mean() > 0.99, (n, m)
        worst = max(worst, np.bitwise_count(raw[0][:, :-1] ^ raw[1][:, :-1]).sum(axis=1).mean())
    assert worst < 220


def test_candidates_meet_by_golay_keys():
    """Fingerprints with two errors in a table's segment share a key of that table; with one among its exact bits, none."""
    import numpy as np

    raw = np.random.default_rng(9).integers(0, 2**63, (50, 19)).astype(np.uint64)
    width = 23 + near_copies.EXACT
    for bits, meet in (((0, 22), True), ((5, 6), True), ((23,), False), ((1, width - 1), False)):
        other = raw.copy()
        for b in bits:
            at = 3 * width + b
            other[:, at // 64] ^= np.uint64(1) << np.uint64(at % 64)
        one, two = (near_copies._heads(x, 3, 4).reshape(50, 6) for x in (raw, other))
        assert all(bool(set(x) & set(y)) is meet for x, y in zip(one.tolist(), two.tolist(), strict=True))


def test_a_large_group_sends_few_pairs(spark, rows, monkeypatch):
    """Texts that differ from one in ever more words: partly near copies, partly not."""
    r = random.Random(10)
    base, docs = [f"w{r.random()}" for _ in range(150)], []
    for k in range(600):
        copy = list(base)
        for at in r.sample(range(150), r.randint(1, 8)):
            copy[at] = f"x{r.random()}"
        docs.append((k, " ".join(copy)))
    sent, judged = [], near_copies._judged

    def counted(pairs, *rest):
        sent.append(pairs.count())
        return judged(pairs, *rest)

    monkeypatch.setattr(near_copies, "_judged", counted)
    assert {x.doc_id for x in simhash_dedup.keep_unlike(rows(docs), 5, 0.8).collect()} == set(components(docs).values())
    assert sum(sent) < 10 * len(docs), sent
