import random
import zlib
from collections import Counter, defaultdict

import pytest

from cdm_engine.llm import queries, sharding


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_cheapest(seed):
    """Against enumeration of whole-number flows on small networks."""
    r = random.Random(seed)
    supply = [r.randint(0, 4) for _ in range(3)]
    cut = sorted(r.randint(0, sum(supply)) for _ in range(2))
    demand = [cut[0], cut[1] - cut[0], sum(supply) - cut[1]]
    cost = [[r.randint(0, 9) for _ in range(3)] for _ in range(3)]
    flow = sharding.min_cost_flow(supply, demand, cost)
    assert [sum(row) for row in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == demand
    best = {tuple(demand): 0}
    for i, s in enumerate(supply):
        nxt = {}
        for left, c in best.items():
            for a in range(min(s, left[0]) + 1):
                for b in range(min(s - a, left[1]) + 1):
                    k = s - a - b
                    if k <= left[2]:
                        key = (left[0] - a, left[1] - b, left[2] - k)
                        nxt[key] = min(nxt.get(key, 10**9), c + a * cost[i][0] + b * cost[i][1] + k * cost[i][2])
        best = nxt
    assert sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3)) == best[0, 0, 0]


def test_least_moves_and_balance():
    r = random.Random(3)
    blocks = {k: (r.randrange(5), r.randint(1, 60)) for k in range(800)}
    found = sharding.solve(blocks, 8)
    have = Counter()
    for shard, size in blocks.values():
        have[shard] += size
    total = sum(have.values())
    want = [total * (k + 1) // 8 - total * k // 8 for k in range(8)]
    assert found.least == total - sum(min(have[k], want[k]) for k in range(8))
    load = Counter()
    for b, shard in found.target.items():
        load[shard] += blocks[b][1]
    assert max(load.values()) - min(load.values()) <= sharding.SLACK * total / 8 and found.moved <= found.least + 8 * 60


def test_old_shards_beyond_the_new_ones_move_whole():
    blocks = {k: (k % 40, 10) for k in range(400)}
    found = sharding.solve(blocks, 4)
    assert found.moved == found.least == 4000 - 400 and Counter(found.target.values()) == dict.fromkeys(range(4), 100)
    assert all(found.target[k] == k % 40 for k in blocks if k % 40 < 4)


def check(got, docs, n):
    slots, size = defaultdict(list), Counter()
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    for x in got:
        slots[x.shard].append(x.slot)
        size[x.shard] += x.size
        assert x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < n
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size


def digest(spark, source, found):
    return sharding.digests(sharding.contents(spark, source, found)).collect()


@pytest.mark.parametrize(("files", "new"), [(1, 4), (3, 4), (9, 4), (4, 1)])
def test_files_of_any_layout(spark, rows, tmp_path, files, new):
    r = random.Random(8)
    docs = [(i, "é" * r.randint(0, 200)) for i in range(900)] + [(1000, None), (1000, None), (None, "x"), (None, None), (5, "twice"), (5, "twice")] + [(7, "same " * 30)] * 400
    source = str(tmp_path / "in")
    frame = rows(docs).withColumnRenamed("lang", "block").withColumnRenamed("source", "shard")
    frame.repartition(files).write.parquet(source)
    found = sharding.reshard(spark, source, new, target=str(tmp_path / "out"))
    size = check(digest(spark, source, found), docs, new)
    mean = sum(size.values()) / new
    assert max(size.values()) <= mean + 0.005 * mean + 401 and min(size.values()) >= mean - 0.005 * mean - 401
    back = sharding.contents(spark, source, found).select("row.*")
    assert back.columns == frame.columns and back.select("shard").distinct().collect()[0][0] == "s"
    with pytest.raises(ValueError):
        sharding.reshard(spark, source, new)


def test_columns_named_like_the_files_metadata(spark, rows, tmp_path):
    docs = [(k, "x" * k) for k in range(60)]
    rows(docs).withColumnsRenamed({"lang": "_metadata", "source": "file"}).repartition(3).write.parquet(str(tmp_path / "in"))
    found = sharding.reshard(spark, str(tmp_path / "in"), 4, target=str(tmp_path / "out"))
    check(digest(spark, str(tmp_path / "in"), found), docs, 4)
    back = sharding.contents(spark, str(tmp_path / "in"), found).select("row.*")
    assert {(r["_metadata"], r["file"]) for r in back.collect()} == {("en", "s")}


def test_untouched_shards_keep_their_files(spark, rows, tmp_path):
    """Sizes 100, 100, 200 (times 50): two shards stay, the third gives half to a fourth; then nothing is left to do."""
    home, docs = tmp_path / "corpus", []
    for shard, n in enumerate((100, 100, 200)):
        own = [(1000 * shard + i, "w" * 49) for i in range(n)]
        docs += own
        rows(own).withColumnRenamed("source", "shard").coalesce(1).write.parquet(str(home / f"shard-{shard:05}"))
    state = lambda k: {f.name: (f.stat().st_mtime_ns, f.stat().st_size) for f in (home / f"shard-{k:05}").iterdir()}
    before = [state(k) for k in range(3)]
    found = sharding.reshard(spark, str(home), 4)
    assert found.affected == [2, 3] and found.plan.moved == found.plan.least == 5000
    assert [state(0), state(1)] == before[:2] and state(2) != before[2]
    assert check(digest(spark, str(home), found), docs, 4) == dict.fromkeys(range(4), 5000)
    assert {x.doc_id for x in digest(spark, str(home), found) if x.shard < 2} == {i for i, _ in docs if i < 2000}
    assert sorted(f.name for f in home.iterdir() if not f.name.startswith(".")) == [f"shard-{k:05}" for k in range(4)]
    before = [state(k) for k in range(4)]
    again = sharding.reshard(spark, str(home), 4)
    assert again.affected == [] and [state(k) for k in range(4)] == before
    assert check(digest(spark, str(home), again), docs, 4) == dict.fromkeys(range(4), 5000)
    fewer = sharding.reshard(spark, str(home), 2)
    assert check(digest(spark, str(home), fewer), docs, 2) == dict.fromkeys(range(2), 10000)
    assert {x.doc_id // 1000 for x in digest(spark, str(home), fewer) if x.shard == 0 and x.doc_id < 2000} == {0}


def test_from_twelve_shards_to_sixteen(spark, rows, tmp_path):
    """The registered query: what moves is what the flow moves between shards of exactly equal bytes, a quarter of all, but for less than a block per shard."""
    r = random.Random(2)
    docs = [(i, "ab" * r.randint(0, 150)) for i in range(3000)] + [(None, None), (5, "x"), (5, "x")]
    rows(docs).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.reshard_12_to_16(spark, str(tmp_path)).collect()
    size = check(got, docs, 16)
    mean = sum(size.values()) / 16
    assert max(size.values()) <= mean + 0.005 * mean + 301 and min(size.values()) >= mean - 0.005 * mean - 301
    (moved, least), *more = {(x.bytes_moved, x.bytes_least) for x in got}
    assert not more and abs(moved - least) < 16 * 301 and abs(least - sum(size.values()) / 4) < 0.02 * least


def test_empty_table(spark, rows, tmp_path):
    source = str(tmp_path / "in")
    rows([(1, "a")]).where("false").write.parquet(source)
    found = sharding.reshard(spark, source, 4, target=str(tmp_path / "out"))
    assert found.affected == [] and digest(spark, source, found) == []
