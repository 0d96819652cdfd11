"""Operator 12: gradients, whole texts, defined cases, held-out accuracy."""

import numpy as np
import pytest

from cdm_engine.llm import passage_quality as q

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def _good(rng, n):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


def _bad(rng, n, kind):
    words = rng.choice(WORDS, n)
    return " | ".join(words) if kind == 0 else " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(w for w in words for _ in range(4))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(600):
        y = int(rng.random() < 0.7)
        n = int(rng.integers(20, 300))
        if y:
            text = _good(rng, n)
        else:  # good passages around a bad one
            text = " ".join([_good(rng, 64), _bad(rng, n + 64, i % 3), _good(rng, 30)])
        docs.append((i, text, "en", "s", 5.0))
        labels.append((i, y, 0))
    docs += [(1000, None, "en", "s", 1.0), (1001, "", "en", "s", 1.0), (1002, " \n ", "en", "s", 1.0), (None, "the of", "en", "s", 1.0), (5, docs[5][1], "en", "s", 1.0)]
    labels += [(1000, 1, 0), (None, 0, 0), (3, None, 0), (4, 7, 0), (5000, 0, 0), (5, labels[5][1], 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(corpus):
    out = q.judge(*corpus).toPandas()
    assert len(out) == corpus[0].count() and out.score.between(0, 1).all()
    assert ((out.score >= 0.7).astype(int) == out.predicted).all()
    known = out.merge(corpus[1].toPandas().dropna(), on="doc_id")
    known = known[known.held_out & known.quality.isin([0, 1]) & (known.doc_id < 600)]
    assert len(known) > 100 and (known.quality == known.predicted).mean() > 0.97
    blank = out[out.doc_id.isin([1000, 1001, 1002])]
    assert len(blank) == 3 and blank.score.nunique() == 1 and set(blank.n_passages) == {1}


def test_attention_points_at_the_odd_passage(corpus):
    out = q.judge(*corpus).toPandas().merge(corpus[1].toPandas().dropna(), on="doc_id")
    bad = out[(out.quality == 0) & (out.doc_id < 600) & (out.predicted == 0)]
    assert ((bad.top_passage >= 1) & (bad.top_passage < bad.n_passages)).mean() > 0.8  # passage 0 is a good one


def test_labels_of_held_out_rows_do_not_count(corpus):
    docs, labels = corpus
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(repr, q.judge(docs, x).collect())) for x in (labels, other))
    assert one == two


@pytest.mark.parametrize("rows,expected", [([], 0.5), ([(0, 1, 0), (1, 1, 0)], None), ([(0, None, 0)], 0.5)])
def test_without_both_labels(spark, rows, expected):
    docs = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    out = q.judge(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 2 and len({r.score for r in out}) == 1
    assert out[0].score == expected if expected else out[0].score > 0.5
    assert q.judge(docs.limit(0), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect() == []


def _encoded(text):
    raw = text.encode()
    runs = list(q.encoded(np.frombuffer(raw + bytes(8), np.uint8), np.array([0, len(raw)])))
    return np.concatenate([x for _, x in runs])


def test_passages_cover_the_whole_text(monkeypatch):
    rng = np.random.default_rng(3)
    text = _good(rng, 1000) + "x" * 5000 + " end"
    whole = _encoded(text)
    assert len(whole) == -(-1001 // q.WORDS)
    words = text.split()
    for k in (0, 7, len(whole) - 1):
        own = " ".join(words[k * q.WORDS : (k + 1) * q.WORDS])
        assert np.allclose(_encoded(own)[0, : q.CLASSES], whole[k, : q.CLASSES], atol=1e-6)
    monkeypatch.setattr(q, "HELD", 3)
    monkeypatch.setattr(q, "BYTES", 777)  # counted in runs
    assert np.array_equal(whole, _encoded(text))


def test_running_softmax_equals_the_whole_one():
    rng = np.random.default_rng(1)
    of = np.sort(rng.integers(0, 4, 50))
    h, e = rng.normal(size=(50, q.ENCODED)), rng.normal(size=50) * 20
    pooled = q.Pooled(4)
    for a in range(0, 50, 7):
        pooled.add(of[a : a + 7], h[a : a + 7], e[a : a + 7])
    for d in range(4):
        own = of == d
        p = np.exp(e[own] - e[own].max())
        assert np.allclose(pooled.sum[d] / pooled.weight[d], p @ h[own] / p.sum())
        assert pooled.best[d] == e[own].argmax() and pooled.n[d] == own.sum()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    model = q.Attention(np.zeros(q.FEATURES), np.ones(q.FEATURES))
    for k in model.NAMES:
        setattr(model, k, getattr(model, k).astype(np.float64))
    of = np.array([0, 0, 0, 1, 2, 2])
    x, y, weight = rng.normal(size=(6, q.FEATURES)) / 5, np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])

    def loss():
        h, e = model.encode(x)
        pooled = q.Pooled(3)
        pooled.add(of, h, e)
        s = pooled.scores(model)
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    for name, g in zip(model.NAMES, model.gradients(x, of, y, weight)):
        value = getattr(model, name)
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(5)]:
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6, name
