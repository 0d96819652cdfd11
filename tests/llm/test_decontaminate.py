import hashlib
import random
import re

import pytest

from cdm_engine.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute(docs, items, width):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for p, ids in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= ids
        near = set()
        for p, ids in windows.items():
            for k in range(-1, len(w)):
                if all(x in w[max(0, k + j - 1) : k + j + 2] for j, x in enumerate(p)):
                    near |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(9)
    text = lambda n: "".join(r.choice(["the", "a", "of", "Ünd", "b2", "x"]) + r.choice([" ", ", ", "-", "\n", " "]) for _ in range(n))
    items = [(i, text(r.randint(0, 16))) for i in range(25)] + [(2, "the of"), (None, "zzz qqq"), (40, None), (41, "...")]
    docs = [(i, text(r.randint(0, 80)) + (items[i % 25][1] or "").upper() + text(r.randint(0, 9))) for i in range(60)]
    return docs + [(99, None), (98, ""), (3, docs[3][1]), (None, docs[5][1]), (97, "zzz QQQ " + "x " * 3000)], items


@pytest.mark.parametrize(("width", "candidates", "block"), [(10, 1 << 17, 8 << 20), (4, 7, 8 << 20), (3, 1 << 17, 64)])
def test_against_brute_force(spark, rows, tables, width, candidates, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = tables
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.hit_digests(rows(docs), bench, width).collect()), key=str) == brute(docs, items, width)
    kept = decontaminate.decontaminate(rows(docs).withColumnRenamed("lang", "hits").withColumnRenamed("source", "ka"), bench, width)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _, n, *_ in brute(docs, items, width) if not n), key=str)


def test_long_and_repeated_items(spark, rows, monkeypatch):
    """Items are cut into pieces of a few windows; a row that stands there 300 times and one that repeats itself count once."""
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", 7)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(n))
    long, twice = text(400), text(30)
    items = [(1, long), (2, twice)] + [(3, twice)] * 300 + [(4, ("q w e r t " * 200).strip()), (5, "q w")]
    docs = [(k, text(20) + " " + " ".join(long.split()[9 * k : 9 * k + 8 + k % 5]) + " " + text(5)) for k in range(40)] + [(50, long), (51, twice), (52, "q w e r t q w e r t q w"), (53, "w q"), (54, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    parts, source = decontaminate.blocks(bench, 10)
    sizes = [sum(len(x.terms) for x in p.collect()) for p in parts]
    assert len(parts) > 4 and max(sizes) < 4 * 1000 / 8 and sum(sizes) < 1300, "neither one item nor one row's copies fill a block"
    decontaminate.release(*source)
    assert sorted(map(tuple, decontaminate.hit_digests(rows(docs), bench, 10).collect()), key=str) == brute(docs, list(dict.fromkeys(items)), 10)


def test_proximity(spark, rows):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = decontaminate.keyed(rows([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x y z beta gamma")]))
    _, exact, _ = decontaminate.matches(docs, bench, 10)
    _, near, _ = decontaminate.matches(docs, bench, 10, slop=1)
    names = {(r.ka, r.kb): r.id for r in docs.collect()}
    told = lambda hits, c: sorted(names[r.ka, r.kb] for r in hits.collect() if r[c])
    assert told(exact, "items") == [1] == told(near, "items") and told(near, "near") == [1, 2]


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.hit_digests(rows([(1, "a b")]), none).collect()
    assert [(r.doc_id, r.n_words, r.n_hit) for r in got] == [(1, 2, 0)]
    assert decontaminate.hit_digests(rows([(1, "a")]).where("false"), none).count() == 0


def test_a_reader_of_the_index_holds_little(spark):
    """Rows of the index are large; a row group, which a task reads at once, stays small."""
    import glob

    import pyarrow.parquet as pq

    from cdm_engine.llm._rows import keyed

    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12000), x -> hex(xxhash64(id, x)))) AS text")
    index = decontaminate.build_index(keyed(docs))
    (path,) = glob.glob(f"{index._stored_at.removeprefix('file:')}/*.parquet")
    about = pq.ParquetFile(path).metadata
    sizes = [about.row_group(k).total_byte_size for k in range(about.num_row_groups)]
    assert sum(sizes) > 20e6 and max(sizes) < 14e6
