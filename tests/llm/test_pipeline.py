"""run() against the brute-force versions of its stages."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as P
from cdm_engine.llm.queries import oracle_sql, queries
from test_decontaminate import brute as leaked

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    kinds = {"aa": "ba ka mo ri tu".split(), "bb": "sch ung ich ver ste".split()}
    make = lambda lang, n: " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randint(1, 5))) for _ in range(n))
    docs = [(i, make(lang, r.randint(20, 90)), lang) for i, lang in enumerate(r.choice(["aa", "bb"]) for _ in range(120))]
    passage, item = make("aa", 60), make("aa", 14)
    docs += [(200, docs[3][1], "aa"), (201, docs[3][1].upper(), "aa"), (202, f"{make('aa', 30)} {passage} {make('aa', 5)}", "aa"), (203, f"{passage} {make('aa', 30)}", "aa"), (204, f"{make('aa', 30)} {item}", "aa"), (205, "123 456", None), (206, None, "aa"), (207, "", "bb")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def test_stages(spark, folder):
    path, docs, item = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns, out = frame.columns, []
    for _, stage in P.STAGES[:-1]:
        frame = stage(spark, frame, path).cache()
        assert frame.columns == columns
        out.append({r.doc_id: r.text for r in frame.collect()})
    texts = {i: t for i, t, _ in docs}
    assert set(texts) - set(out[0]) == {205, 206, 207}
    assert set(out[0]) - set(out[1]) == {200, 201}
    blobs = {i: t.encode() for i, t in out[1].items()}
    seen = Counter(b[k : k + 200] for b in blobs.values() for k in range(len(b) - 199))
    for i, b in blobs.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert out[2][i].encode() == bytes(x for x, g in zip(b, gone, strict=True) if not g)
    assert len(out[2][202]) < len(out[1][202]) and len(out[2][203]) < len(out[1][203])
    hit = {d for d, _, n, *_ in leaked(list(out[2].items()), [(1, item)], 10) if n}
    assert set(out[2]) - set(out[3]) == hit == {204}
    packed = P.run(spark, path).collect()
    assert {r.doc_id for r in packed} == set(out[3])


def test_registered_queries():
    numbered = [q for q in queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in numbered) == list(range(1, 14))
    assert set(queries()) - set(numbered) == {"reshard_12_to_16"}
    assert set(oracle_sql()) <= set(queries()) and len(P.STAGES) == 5


def test_clashing_columns_and_empty_tables(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, name in enumerate(("row", "id", "th", "f", "runs", "hits", "rejected", "n", "block")):
        docs = docs.withColumn(name, F.lit(k))
    columns, empty = docs.columns, docs.where("false")
    for _, stage in P.STAGES[:-1]:
        docs, empty = stage(spark, docs, path), stage(spark, empty, path)
        assert docs.columns == columns == empty.columns
    assert empty.count() == 0 and docs.count() > 100
    assert {(r.row, r.th, r.block) for r in docs.select("row", "th", "block").collect()} == {(0, 2, 8)}
    assert P.STAGES[-1][1](spark, empty, path).count() == 0
