"""Resharding by minimum-cost flow (operator 6).

A corpus lies in Parquet files, its old shards: the folders ``shard-N`` that ``reshard`` writes, or any files, one shard
each in the order of their paths. It is to lie in ``new`` shards of nearly equal bytes. The rows of each old shard are dealt to fine
blocks by file name and row number, so that no text or doc_id, however common, makes a large block; blocks are what moves.
Their sizes (bounded: about ``BLOCKS`` numbers, or one per file if there are more files) go to the driver, where

1. new capacities are the total cut into equal whole numbers;
2. a minimum-cost flow from old shards to new ones - a byte that stays costs nothing, one that moves
   costs 1 - says how many bytes each old shard sends to each new one (successive shortest paths
   with potentials; old shards that none of the new ones continues are one source, as all their bytes move);
3. each old shard's blocks are chosen to fill its flows: largest block first, into the transfer with the
   most bytes still to go; what is left of a flow is less than a block, and a final pass moves single
   blocks from the fullest shard to the emptiest as long as that brings them closer and they differ by over ``SLACK``.

``reshard`` writes the new content of affected shards, those that gain or lose blocks, to a folder of its own and then
swaps folders; the files of other shards are not touched. Rows are shuffled by shard with room to split large ones. A row's
slot is its place in its shard's files: the rows of the files before and its number in its own.

Defined cases: null text has no bytes (size 1, CRC 0); null and repeated doc_ids, and repeated rows, are rows like any
other; columns of any name stay; an empty table writes nothing and gives an empty table; shards may stay empty, and a row
larger than a shard's share makes its shard larger.
"""

from __future__ import annotations

import heapq
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete, folders, fresh_path, move
from ._store import tidied_shuffles

#: Number of blocks, about; the plan has a row for each.
BLOCKS = 1 << 15
#: Largest and smallest shard may differ by this part of a share: no more is moved to make them more alike.
SLACK = 0.005
_FOLDER = re.compile(r"/shard-(\d+)/[^/]*$")


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Whole-number flows from sources to sinks (totals are equal) of least cost: successive shortest
    augmenting paths, Dijkstra on costs reduced by potentials (which start at 0, as costs are not negative)."""
    m, n = len(supply), len(demand)
    left, need = list(supply), list(demand)
    flow = [[0] * n for _ in range(m)]
    above, below = [0] * m, [0] * n
    while any(left):
        dist = {("s", i): 0 for i in range(m) if left[i]}
        back: dict[tuple[str, int], tuple[str, int] | None] = dict.fromkeys(dist)
        queue = [(0, k) for k in dist]
        heapq.heapify(queue)
        done: set[tuple[str, int]] = set()
        while queue:
            d, node = heapq.heappop(queue)
            if node in done:
                continue
            done.add(node)
            side, i = node
            edges = (("t", j, cost[i][j] + above[i] - below[j]) for j in range(n)) if side == "s" else (("s", k, below[i] - above[k] - cost[k][i]) for k in range(m) if flow[k][i])
            for kind, j, c in edges:
                if d + c < dist.get((kind, j), d + c + 1):
                    dist[kind, j], back[kind, j] = d + c, node
                    heapq.heappush(queue, (d + c, (kind, j)))
        end = min((dist["t", j], j) for j in range(n) if need[j])[1]
        reach = dist["t", end]
        for (side, i), d in dist.items():
            if side == "s":
                above[i] += min(d, reach)
            else:
                below[i] += min(d, reach)
        path = [("t", end)]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        start = path[0][1]
        amount = min(left[start], need[end], *[flow[b[1]][a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "t"])
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "s":
                flow[a[1]][b[1]] += amount
            else:
                flow[b[1]][a[1]] -= amount
        left[start] -= amount
        need[end] -= amount
    return flow


@dataclass(frozen=True)
class Plan:
    """target: new shard of each block. moved: bytes that change shard. least: what the flow moves."""

    target: dict[int, int]
    moved: int
    least: int


def solve(blocks: dict[int, tuple[int, int]], new: int) -> Plan:
    """blocks: number -> (old shard, bytes)."""
    old = new + 1  # the last: all that have no new shard of their number
    blocks = {b: (min(shard, new), size) for b, (shard, size) in blocks.items()}
    supply = [0] * old
    for shard, size in blocks.values():
        supply[shard] += size
    total = sum(supply)
    demand = [total * (k + 1) // new - total * k // new for k in range(new)]
    cost = [[0 if i == j else 1 for j in range(new)] for i in range(old)]
    flow = min_cost_flow(supply, demand, cost)
    least = sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)
    target: dict[int, int] = {}
    load = [0] * new
    for i in range(old):
        queue = [(-f, j) for j, f in enumerate(flow[i]) if f]
        heapq.heapify(queue)
        for size, b in sorted(((s, b) for b, (x, s) in blocks.items() if x == i), reverse=True):
            f, j = heapq.heappop(queue) if queue else (0, min(range(new), key=load.__getitem__))
            if i < new and i != j and -2 * f < size:  # more would move than the flow asks for
                heapq.heappush(queue, (f, j))
                target[b] = i
                load[i] += size
                continue
            target[b] = j
            load[j] += size
            heapq.heappush(queue, (f + size, j))
    by_shard: list[list[tuple[int, int]]] = [[] for _ in range(new)]
    for b, j in target.items():
        by_shard[j].append((blocks[b][1], b))
    while blocks:
        full, empty = max(range(new), key=load.__getitem__), min(range(new), key=load.__getitem__)
        gap = load[full] - load[empty]
        fit = [(abs(gap - 2 * s), s, b) for s, b in by_shard[full] if s < gap] if gap * new > SLACK * total else []
        if not fit:
            break
        _, size, b = min(fit)
        by_shard[full].remove((size, b))
        by_shard[empty].append((size, b))
        target[b] = empty
        load[full] -= size
        load[empty] += size
    return Plan(target, sum(s for b, (x, s) in blocks.items() if target[b] != x), least)


def row_size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


#: Rows of a plan up to which it is broadcast; a larger one (very many files) is joined by a shuffle.
SMALL = 1 << 17


def _plan_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= SMALL else table


def _read(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(*paths)


def _placed(table: DataFrame) -> DataFrame:
    """(row, file, place): a struct of the table's columns, its file, and its number there."""
    columns = [F.col(f"`{c}`") for c in table.columns]
    about = table.metadataColumn("_metadata")  # a column of the table may have that name
    return table.select(F.struct(*columns).alias("row"), about.getField("file_path").alias("file"), about.getField("row_index").alias("place"))


def old_shards(table: DataFrame) -> dict[str, int]:
    """The shard that each file with rows is, or belongs to. The driver holds a row per file."""
    files = sorted(r.file for r in _placed(table).select("file").distinct().collect())
    named = [_FOLDER.search(f) for f in files]
    return {f: int(m[1]) if all(named) else k for k, (f, m) in enumerate(zip(files, named, strict=True))}


def _blocked(table: DataFrame, shards: dict[str, int], blocks: int) -> DataFrame:
    """(row, block): the blocks of a file are numbered from its own first one."""
    each = max(1, blocks // max(1, len(shards)))
    numbers = _plan_table(table.sparkSession, [(f, k * each) for k, f in enumerate(sorted(shards))], "file string, first long")
    block = F.col("first") + F.pmod(F.xxhash64(F.substring_index("file", "/", -1), "place"), F.lit(each))
    return _placed(table).join(numbers, "file").select("row", block.alias("block"))


@dataclass(frozen=True)
class Resharded:
    """written: the folder of each affected shard that has rows. kept: the shard of each file that stays as it is.
    affected: the shards that gained or lost blocks."""

    plan: Plan
    affected: list[int]
    written: dict[int, str]
    kept: dict[str, int]


def reshard(spark: SparkSession, source: str, new: int, target: str | None = None, blocks: int = BLOCKS) -> Resharded:
    """Puts the rows of ``source`` into ``new`` shards. With ``target`` affected shards are written there, as folders
    ``shard-N``, and ``source`` stays as it is; without, they take the place of the folders ``shard-N`` in ``source``
    (nobody may read meanwhile: old folders are set aside, new ones moved in, then the old ones are deleted)."""
    if new < 1:
        raise ValueError("there is at least one shard")
    table = _read(spark, source)
    shards = old_shards(table)
    if not target and not all(_FOLDER.search(f) for f in shards):
        raise ValueError(f"{source} has files outside of folders shard-N: resharding needs a target")
    each, files = max(1, blocks // max(1, len(shards))), sorted(shards)
    rows = _blocked(table, shards, blocks)
    sizes = {r.block: r.bytes for r in rows.select("block", F.col("row.text").alias("text")).groupBy("block").agg(F.sum(row_size()).alias("bytes")).collect()}
    old = {b: shards[files[b // each]] for b in sizes}
    plan = solve({b: (old[b], size) for b, size in sizes.items()}, new)
    moved = [b for b, shard in plan.target.items() if shard != old[b]]
    affected = sorted({plan.target[b] for b in moved} | {old[b] for b in moved if old[b] < new})
    found = Resharded(plan, affected, {}, {f: shards[f] for f in files if shards[f] < new and shards[f] not in affected})
    if affected:
        where = _plan_table(spark, [(b, shard) for b, shard in plan.target.items() if shard in set(affected)], "block long, shard int")
        to = "shard" + uuid.uuid4().hex  # no column has this name
        out = rows.join(where, "block").select("row.*", F.col("shard").alias(to))
        made = fresh_path(spark, "shards") if target else f"{source.rstrip('/')}/_new-{uuid.uuid4().hex}"
        with tidied_shuffles(spark):  # all moved rows pass through it
            out.hint("rebalance", to).write.partitionBy(to).parquet(made)
        home = (target or source).rstrip("/")
        if not target:
            aside = f"{home}/_old-{uuid.uuid4().hex}"
            for shard in sorted(set(shards.values()) & ({old[b] for b in moved} | set(affected))):
                move(spark, f"{home}/shard-{shard:05}", f"{aside}/shard-{shard:05}")
        for name in folders(spark, made):
            if name.startswith(f"{to}="):
                shard = int(name.split("=")[1])
                move(spark, f"{made}/{name}", f"{home}/shard-{shard:05}")
                found.written[shard] = f"{home}/shard-{shard:05}"
        delete(spark, made)
        if not target:
            delete(spark, aside)
    return found


def contents(spark: SparkSession, source: str, found: Resharded) -> DataFrame:
    """The rows of all shards, as structs ``row``, with ``shard`` and ``slot``."""
    schema = _read(spark, source).schema if found.kept or not found.written else _read(spark, next(iter(found.written.values()))).schema
    paths = [*found.written.values(), *found.kept]
    if not paths:
        return spark.createDataFrame([], schema).select(F.struct("*").alias("row"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    rows = _placed(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths))
    before: dict[int, int] = {}
    bases = []
    for f, n in sorted((r.file, r.n) for r in rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()):
        shard = found.kept[f] if f in found.kept else int(_FOLDER.search(f)[1])
        bases.append((f, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    bases = _plan_table(spark, bases, "file string, shard int, base long")
    return rows.join(bases, "file").select("row", "shard", (F.col("base") + F.col("place")).alias("slot"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of the rows of ``contents``."""
    rows = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), "shard", "slot")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return rows.select("doc_id", row_size().alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
