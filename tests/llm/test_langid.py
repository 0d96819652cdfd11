import random
import zlib

import numpy as np
import pytest
from collections import Counter
from pyspark.sql import functions as F

from cdm_engine.llm import langid

SYLLABLES = {"aa": "ba ka mo ri tu".split(), "bb": "sch ung ich ver ste".split(), "cc": "eau que oui ré lle".split()}


@pytest.fixture(scope="module")
def labelled(rows_module):
    r = random.Random(2)
    make = lambda lang, n: " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    docs = [(i, make(lang, r.randint(3, 60)), lang) for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(300))]
    return docs


@pytest.fixture(scope="module")
def rows_module(spark):
    return spark


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_folds(spark, labelled):
    got = {r.doc_id: r for r in langid.identify(frame(spark, labelled)).collect()}
    truth = {i: lang for i, _, lang in labelled}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(r.rejected for r in got.values()) <= 3


def test_odd_rows(spark, labelled):
    odd = [(1001, None, "aa"), (1002, "", "aa"), (1003, "12 34 !!", None), (None, "ba ka", None), (1004, "zxq wkj qqx " * 40, None), (1005, "eau " * 20000, "cc"), (1006, "bakamo", None), (1006, "bakamo", None)]
    got = langid.identify(frame(spark, labelled + odd)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(labelled) + len(odd)
    assert [by[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and by[1001].rejected
    assert by[None].lang_pred == "aa" and by[1004].rejected and by[1005].lang_pred == "cc" and not by[1005].rejected
    kept = langid.keep_identified(frame(spark, labelled + odd).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "score", "lang_pred"]
    assert not {1001, 1002, 1003, 1004} & {r.doc_id for r in kept.collect()}


def test_predictions_ignore_labels_and_equal_texts_agree(spark, labelled):
    docs = frame(spark, labelled)
    model = langid.fit(docs)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    moved = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.orderBy(F.desc("doc_id")).coalesce(1).select("doc_id", "text"), model).collect()}
    assert plain == moved


def test_nothing_to_learn_from(spark):
    got = langid.identify(frame(spark, [(1, "abc", None), (2, None, None)])).collect()
    assert [r.lang_pred for r in got] == ["und", "und"]
    assert langid.identify(frame(spark, [(1, "a", None)]).where("false")).count() == 0


def brute(counts, order):
    """Interpolated Kneser-Ney by definition: p(symbol | context) over dictionaries."""
    runs = [("\0" * (order - 1) + w + "\0", n) for w, n in counts.items()]
    top = Counter()
    for run, n in runs:
        for k in range(order - 1, len(run)):
            top[run[k - order + 1 : k + 1]] += n
    level = {order: top}
    for m in range(order - 1, 0, -1):  # how many symbols come before
        level[m] = Counter(g[1:] for g in level[m + 1])
    symbols = {run[k] for run, _ in runs for k in range(order - 1, len(run))}

    def p(symbol, context):
        value = 1 / (len(symbols) + 1)
        for m in range(1, order + 1):
            c = context[len(context) - m + 1 :] if m > 1 else ""
            own = {g: n for g, n in level[m].items() if g[:-1] == c}
            if not own:
                continue
            once, twice = (sum(n == k for n in level[m].values()) for k in (1, 2))
            d = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
            total = sum(own.values())
            value = max(own.get(c + symbol, 0) - d, 0) / total + d * len(own) / total * value
        return value

    return p, symbols


@pytest.mark.parametrize(("order", "held"), [(3, 1 << 21), (5, 7)])
def test_probabilities_against_the_definition(order, held, monkeypatch):
    """Those of every symbol of words in two languages, also unseen ones, and their sum over symbols."""
    monkeypatch.setattr(langid, "HELD", held)
    languages = {"x": Counter({"abab": 3, "abc": 2, "ba": 1, "cabba": 1}), "y": Counter({"dede": 2, "ab": 1, "edd": 4})}
    models = langid.Models(languages, order)
    assert models.languages == ["x", "y"]
    for word in ("abab", "dedab", "c", "zebra", "abczab"):
        got = models.words([word])[0]
        assert got[-1] == len(word) + 1
        for k, name in enumerate(models.languages):
            p, symbols = brute(languages[name], order)
            base = models.base  # all languages share the unknown symbol's
            q = lambda s, c: p(s, c) + rest(p, c, order) * (base - 1 / (len(symbols) + 1))  # noqa: E731, B023
            run = "\0" * (order - 1) + word + "\0"
            want = sum(np.log(q(run[i], run[:i])) for i in range(order - 1, len(run)))
            assert got[k] / langid.SCALE == pytest.approx(want, abs=1e-3)
            everything = {r for x in languages for r in brute(languages[x], order)[1]}
            assert sum(q(s, run[:-1]) for s in everything) + q("?", run[:-1]) == pytest.approx(1.0, abs=1e-9)


def rest(p, context, order):
    """The weight with which the uniform distribution comes in after a context."""
    return (p("?", context)) * (len_symbols(p) + 1)


def len_symbols(p):
    return len(p.__closure__[[c for c in p.__code__.co_freevars].index("symbols")].cell_contents)


def test_bytes_of_the_sample(spark, labelled, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 3 * 900)
    docs = frame(spark, labelled + [(k, "sch ung " * 500, "dd") for k in range(2000, 2020)])
    ids = langid._sample(langid.keyed(docs), 500)
    texts = {(r.ka, r.kb): (r.lang, len(r.text)) for r in langid.keyed(docs).collect()}
    used = Counter()
    for ka, kb, lang, _ in ids:
        assert texts[ka, kb][0] == lang
        used[lang] += texts[ka, kb][1]
    assert set(used) == {"aa", "bb", "cc", "dd"} and all(used[x] <= 675 for x in ("aa", "bb", "cc")) and used["dd"] == 4000


def test_many_copies_of_one_row_count_once(spark, labelled):
    docs = frame(spark, labelled + [(None, "ba ka mo", "aa")] * 700 + [(3001, "ba ka", "aa")] * 700)
    assert len(langid._sample(langid.keyed(docs.where("doc_id is null or doc_id = 3001")), 500)) == 2


def test_rare_labels_are_learned(spark, labelled):
    """600 labels with more rows than the last one, which has an alphabet of its own."""
    r = random.Random(8)
    many = [(10_000 + 3 * k + j, f"ba{chr(97 + k % 26)}{chr(97 + k // 26)} ka", f"l{k:03}") for k in range(600) for j in range(3)]
    make = lambda: " ".join("".join(r.choice("жщюэы") for _ in range(5)) for _ in range(20))
    learned = next(i for i in range(90_000, 91_000) if zlib.crc32(str(i).encode()) % 3 != 1)
    probe = next(i for i in range(95_000, 96_000) if zlib.crc32(str(i).encode()) % 3 == 1)
    got = {x.doc_id: x for x in langid.identify(frame(spark, many + [(learned, make(), "zz"), (probe, make(), "zz")])).where("doc_id >= 90000").collect()}
    assert got[probe].lang_pred == "zz"
