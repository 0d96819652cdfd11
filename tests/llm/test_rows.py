"""Rows whose doc_ids are null or equal and whose texts have equal 32-bit hashes are told apart by every operator that keys rows."""

import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_repeats import brute_bytes, brute_words

from cdm_engine.llm import decontaminate, simhash_dedup, substring_dedup, suffix_dedup
from cdm_engine.llm._rows import KEY, keyed


@pytest.fixture(scope="module")
def pair(spark):
    """Two texts of 70 words (one of them with a passage) whose Murmur hashes are equal."""
    passage = " ".join(f"p{k}" for k in range(60))
    plain = " ".join(f"q{k}" for k in range(69))
    made = spark.range(200_000).select(F.explode(F.array(F.concat(F.lit(passage + " x y z u v w a b c "), "id"), F.concat(F.lit(plain + " "), "id"))).alias("text"))
    by_hash = made.groupBy(F.hash("text").alias("h")).agg(F.min("text").alias("one"), F.max("text").alias("two")).where("one like 'p0%' and two like 'q0%'")
    row = by_hash.orderBy("h").first()
    return passage, row.one, row.two


@pytest.fixture(scope="module")
def docs(pair):
    passage, one, two = pair
    return [(1, passage), (None, one), (None, two), (7, one), (7, two), (7, two), (9, "short " + passage)]


def test_keys(spark, rows, docs):
    table = keyed(rows(docs))
    assert table.select(F.hash("text")).where("doc_id = 7").distinct().count() == 1
    assert table.select(*KEY).distinct().count() == len(set(docs))
    assert keyed(rows([(None, None), (None, ""), (-(2**63) + 1, None)])).select(*KEY).distinct().count() == 3


def test_repeats(rows, docs):
    assert sorted(map(tuple, suffix_dedup.repeat_digests(rows(docs), 200).collect()), key=str) == brute_bytes(docs, 200)
    assert sorted(map(tuple, substring_dedup.repeat_digests(rows(docs), 50).collect()), key=str) == brute_words(docs, 50)
    cut = substring_dedup.cut_repeats(rows(docs), 50)
    assert sorted((str(r.doc_id), len(r.text.split())) for r in cut.collect()) == sorted((str(i), n - gone) for i, n, gone, _ in brute_words(docs, 50))


def test_leaks(spark, rows, docs, pair):
    items = [(1, " ".join(pair[0].split()[5:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, items, 10)
    assert sorted(map(tuple, decontaminate.hit_digests(rows(docs), bench, 10).collect()), key=str) == want
    assert sorted((str(r.doc_id) for r in decontaminate.decontaminate(rows(docs), bench, 10).collect())) == sorted(str(i) for i, _, hit, *_ in want if not hit)


def test_near_copies(rows, pair):
    _, one, two = pair
    docs = [(None, one), (None, two), (None, two), (None, "something else entirely")]
    for kept in (simhash_dedup.keep_one(rows(docs)), simhash_dedup.keep_unlike(rows(docs))):
        assert sorted(r.text for r in kept.collect()) == sorted({t for _, t in docs})
