"""Exact search for repeated windows, shared by the byte-level and the word-level substring operators.

A *window* is ``width`` consecutive units (bytes or words) of one document: the prefix that suffixes are
sorted by. A pointer for each unit would be a shuffled row for each. So each window is represented by the suffix
at its smallest q-gram bucket identifier (q about width / 3; leftmost among equals). Equal windows choose suffixes in
equal buckets at equal places, so only these *anchors*, about 3 / width of all units, leave the task that reads the text.

Their buckets are refined level by level, each by identifiers of later offsets and on top of the level before,
whose identifiers are reused; buckets with a single member drop out at each level:

    0  h     the anchor's q-gram,
    1  h, c  all units of the windows that the anchor represents, and their number and place; members of a bucket
             that holds several suffixes repeat all their windows,
    2  h, k  where one h holds several c: of one member of each c, the units that up to ``GROUP`` neighbouring windows share,
    3  h, k, c  single windows.

Identifiers of s units come from those of s / 2 units at the two offsets (``refine``), as in prefix doubling.

Every level counts its buckets with a partial aggregate, so that a bucket, however large, arrives as a row for each
task, and joins the counts back to the suffixes; AQE splits what is skewed there. No bucket is held or sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import KEY, KEYS, texts_of
from ._store import materialize, release
from ._text import column, gather, hash_spans, is_space, loads, mix, slices, spans, tidied

#: Low bits of a packed (bucket identifier, place) pair; a slice of documents has fewer units.
PLACE_BITS = 30


@dataclass(frozen=True)
class Unit:
    """How texts are cut: ``kind`` is 'bytes' or 'words', ``width`` the window's number of units."""

    kind: str
    width: int

    @property
    def q(self) -> int:
        return max(1, self.width // 3)


def symbols(kind: str, data: np.ndarray, off: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Lowest levels [(units covered, bucket identifiers)] and the units before each document."""
    if kind == "bytes":
        n = int(off[-1])
        first = data[:n].astype(np.uint64)
        eight = loads(data)[:n].astype(np.uint64)
        return [(1, mix(first, first)), (8, mix(eight, eight))], off
    starts, lens, ptr = spans(~is_space(data), off)
    return [(1, hash_spans(data, starts, lens))], ptr


def refine(levels: list[tuple[int, np.ndarray]], span: int) -> np.ndarray:
    """Bucket identifiers of ``span`` units. Values of the last span - 1 places have no meaning."""
    s, b = levels[-1]
    while 2 * s <= span:
        nxt = b.copy()
        if len(b) > s:
            nxt[:-s] = mix(b[:-s], b[s:])
        s, b = 2 * s, nxt
        levels.append((s, b))
    done, out = next((s, b) for s, b in reversed(levels) if s <= span)
    while done < span:
        fit = next(((s, b) for s, b in levels if span - done <= s <= span), None)
        # the last units, overlapping those done; or else the next ones
        s, b = fit or next((s, b) for s, b in reversed(levels) if s <= span - done)
        at = span - s if fit else done
        nxt = out.copy()
        if len(out) > at:
            nxt[: len(out) - at] = mix(out[: len(out) - at], b[at:])
        out, done = nxt, at + s
    return out


def window_buckets(unit: Unit, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q-gram buckets, window buckets, units before each document). The levels below are shared."""
    levels, ptr = symbols(unit.kind, data, off)
    grams = refine(levels, unit.q)
    return grams, refine(levels, unit.width), ptr


#: Bytes of one document above which its windows are found in parts, so that memory stays bounded.
LONG = 2 << 20


def step(unit: Unit) -> int:
    """Windows that start in one part of a long document."""
    return LONG if unit.kind == "bytes" else max(1, LONG // 8)


def parts(unit: Unit, data: np.ndarray, off: np.ndarray, more: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first unit, end unit) of a slice: itself, or parts of its one long document that overlap by what
    windows (and ``more``) need, so that each window starts before the end unit of one part."""
    n = int(off[-1])
    if len(off) != 2 or n <= LONG:
        yield data, off, 0, 1 << 62
        return
    if unit.kind == "bytes":
        begin = finish = None
    else:
        begin, lens, _ = spans(~is_space(data), off)
        finish, n = begin + lens, len(begin)
    for at in range(0, n, step(unit)):
        end = min(n, at + step(unit) + unit.width - 1 + more)
        a, b = (at, end) if begin is None else (int(begin[at]), int(finish[end - 1]))
        piece = np.zeros(b - a + 8, np.uint8)
        piece[:-8] = data[a:b]
        yield piece, np.array([0, b - a]), at, at + step(unit)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i <= len(x) - w."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(unit: Unit, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, h, c, lo, n, anchor - lo) of each anchor of a slice of documents."""
    width, q = unit.width, unit.q
    grams, whole, ptr = window_buckets(unit, data, off)
    w = width - q + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(packed, w) & low).astype(np.int64)
    sizes = np.diff(ptr)
    good = np.maximum(sizes - width + 1, 0)
    valid = np.repeat(np.tile([True, False], len(sizes)), np.column_stack([good, sizes - good]).ravel())[: len(at)]
    at = at[: len(valid)]
    if not valid.any():
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z, z
    step = np.empty(len(at) + 1, bool)
    step[0] = step[-1] = True
    step[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    lo = np.flatnonzero(valid & step[:-1])
    hi = np.flatnonzero(valid & step[1:])
    a = at[lo]
    shape = ((a - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    c = mix(mix(whole[lo], whole[hi]), shape)
    doc = np.searchsorted(ptr, lo, side="right") - 1
    return doc, grams[a], c, lo - ptr[doc], hi - lo + 1, a - lo


def cover(n: int, lo: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Which of n units lie in a window that starts in one of the runs [lo, lo + count)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, lo, 1)
    np.add.at(d, lo + count - 1 + width, -1)
    return np.cumsum(d[:-1]) > 0


# ---- distributed refinement -------------------------------------------------------------------


def _anchor_rows(unit: Unit, named: bool):
    """One row for each anchor; those alike in one document share a row, and ``also`` has the other places. A row
    has the document's key, and with ``named`` its id before that."""
    lead = 3 if named else 2

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(k).to_numpy() for k in range(lead)]
            for first, end, data, off, shift, _ in (x for a, b, d, o in slices(column(batch, "text")) for x in ((a, b, *p) for p in parts(unit, d, o))):
                doc, h, c, lo, n, at = anchors(unit, data, off)
                if not len(doc):
                    continue
                lo = lo + shift
                alike = mix(mix(h, c), doc.astype(np.uint64))
                order = np.argsort(alike, kind="stable")
                fresh = np.append(True, alike[order][1:] != alike[order][:-1])
                count = np.diff(np.append(np.flatnonzero(fresh), len(order))) - 1
                keep = order[fresh]
                rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(lo[order[~fresh]].astype(np.int32)), mask=pa.array(count == 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x[first:end][doc[keep]]) for x in own),
                        pa.array(h[keep].view(np.int64)),
                        pa.array(c[keep].view(np.int64)),
                        pa.array(lo[keep].astype(np.int32)),
                        pa.array((at[keep] << 16 | n[keep]).astype(np.int32)),
                        rest,
                    ],
                    names=[*batch.schema.names[:lead], "h", "c", "lo", "shape", "also"],
                )

    return run


#: So many neighbouring windows share a row on the last level but one.
GROUP = 8


def _group_rows(unit: Unit, named: bool):
    """For the windows that are asked for: a row for each group of windows whose places relative to
    the anchor have the same quotient by ``GROUP``. k: bucket of the units that all of the group's
    windows have; c: buckets of its single windows, from ``lo`` on."""
    lead = 3 if named else 2
    group = GROUP if unit.width >= 4 * GROUP else 1
    core = unit.width - group + 1

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            names = ["id", *KEY][-lead:]
            own = [batch.column(at[k]).to_numpy() for k in names]
            asked = batch.column(at["asked"])
            flat, ptr = asked.flatten(), asked.offsets.to_numpy().astype(np.int64)
            ptr = ptr - ptr[0]
            h, lo, shape = (flat.field(k).to_numpy() for k in ("h", "lo", "shape"))
            for first, end, data, off, shift, until in (x for a, b, d, o in slices(texts_of(batch)) for x in ((a, b, *p) for p in parts(unit, d, o, group + unit.width))):
                levels, units = symbols(unit.kind, data, off)
                whole, shared = refine(levels, unit.width), refine(levels, core)
                r = np.arange(ptr[first], ptr[end])
                row = np.repeat(np.arange(first, end), np.diff(ptr[first : end + 1]))
                mine = (lo[r] >= shift) & (lo[r] < until)  # a part takes the runs that start in it
                r, row = r[mine], row[mine]
                if not len(row):
                    continue
                n, place = (shape[r] & 0xFFFF).astype(np.int64), (shape[r] >> 16).astype(np.int64)
                start = units[row - first] + lo[r] - shift
                which = np.repeat(np.arange(len(row)), n)
                s = gather(np.arange(int(units[-1]) + 1), start, n)
                g = (np.repeat(start + place, n) - s) // group
                fresh = np.append(True, (which[1:] != which[:-1]) | (g[1:] != g[:-1]))
                head = np.flatnonzero(fresh)
                who = which[head]
                p = start[who] + place[who] - group * g[head]  # the last window of the group would start here
                k = mix(shared[p], g[head].astype(np.uint64))
                c = pa.ListArray.from_arrays(pa.array(np.append(head, len(s)).astype(np.int32)), pa.array(whole[s].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x[row[who]]) for x in own),
                        pa.array(h[r][who]),
                        pa.array(k.view(np.int64)),
                        pa.array((s[head] - units[row[who] - first] + shift).astype(np.int32)),
                        c,
                    ],
                    names=[*names, "h", "k", "lo", "c"],
                )

    return run


def repeated(docs: DataFrame, unit: Unit, earlier: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(runs, the tables to release when these are written). Runs of windows that repeat: ka, kb, lo (first window), n (windows); with ``earlier`` a window counts if it also starts in a
    document with a smaller id, and id, and ``rep`` (id, ka, kb, lo) of the same run in the document with the smallest
    are there, too; else if it also starts anywhere else. ``docs`` has id, ka, kb and text, or in place of text a struct ``row`` with it."""
    if unit.width >= 1 << 15:
        raise ValueError("a window has fewer than 32,768 units")
    names = ["id", *KEY] if earlier else KEY
    lead = f"id long, {KEYS}" if earlier else KEYS
    text = F.col("text" if "text" in docs.columns else "row.text").alias("text")
    place = F.struct(*names, "lo")
    # level 0
    found = docs.select(*names, text).mapInArrow(_anchor_rows(unit, earlier), f"{lead}, h long, c long, lo int, shape int, also array<int>")
    found = materialize(found, "anchors")
    places = F.lit(1) + F.when(F.col("also").isNull(), 0).otherwise(F.size("also"))
    span = [F.min("c").alias("low"), F.max("c").alias("high")]
    if earlier:
        grams = found.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"), *span).where("first < last")
    else:
        grams = found.groupBy("h").agg(F.sum(places).alias("n"), *span).where("n > 1")
    grams = materialize(grams.select("h", (F.col("low") != F.col("high")).alias("several")), "grams")
    members = materialize(found.join(grams, "h"), "members")
    release(found, grams)
    # level 1
    runs = members.groupBy("h", "c").agg(F.min(place).alias("rep"), F.sum(places).alias("copies"))
    runs = materialize(runs, "buckets")
    settled = F.col("id") > F.col("rep.id") if earlier else F.col("copies") > 1
    asks = F.col("several") & ((F.col("id") == F.col("rep.id")) if earlier else (place == F.col("rep")))
    told = members.join(runs, ["h", "c"]).withColumns({"settled": settled, "asks": asks}).where("settled or asks")
    told = materialize(told.drop("c", "copies", "several"), "suffixes")
    release(members, runs)
    # one member of a refined bucket stands for all; where only other documents count, each of the first document's does
    everywhere = F.explode(F.concat(F.array("lo"), F.coalesce("also", F.array().cast("array<int>"))))
    out = [*names, "rep"] if earlier else names
    sure = told.where("settled").select(*out, everywhere.alias("lo"), F.expr("shape & 65535").alias("n"))
    ask = told.where("asks").select(*KEY, "h", "shape", (everywhere if earlier else F.col("lo")).alias("lo"))
    asked = materialize(ask.groupBy(*KEY).agg(F.collect_set(F.struct("h", "lo", "shape")).alias("asked")), "asked")
    # level 2
    groups = materialize(docs.join(asked, KEY).mapInArrow(_group_rows(unit, earlier), f"{lead}, h long, k long, lo int, c array<long>"), "groups")
    release(asked)
    core = groups.groupBy("h", "k")
    core = core.agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last") if earlier else core.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    core = materialize(core.select("h", "k"), "cores")
    windows = groups.join(core, ["h", "k"]).select(*names, "h", "k", F.col("lo").alias("from"), F.posexplode("c").alias("j", "c"))
    windows = materialize(windows.select(*names, "h", "k", "c", F.expr("from + j").alias("lo")), "windows")
    release(groups, core)
    # level 3
    single = windows.groupBy("h", "k", "c")
    if earlier:
        single = single.agg(F.min(place).alias("rep"), F.max("id").alias("last")).where("rep.id < last").drop("last")
    else:
        single = single.agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    single = materialize(single, "singles")
    alone = windows.join(single, ["h", "k", "c"])
    if earlier:
        alone = alone.where(settled)
    return sure.unionByName(alone.select(*out, "lo", F.lit(1).alias("n"))), [told, windows, single]


def with_runs(docs: DataFrame, unit: Unit) -> DataFrame:
    """``docs`` (with ka, kb) and ``runs``, an array of (first window << 16 | number of windows) of the windows that
    also start anywhere else; null where nothing repeats."""
    found, tables = repeated(docs, unit, False)
    run = F.shiftleft(F.col("lo").cast("long"), 16).bitwiseOR(F.col("n").cast("long"))
    runs = materialize(found.groupBy(*KEY).agg(F.collect_set(run).alias("runs")), "runs")
    release(*tables)
    return docs.join(runs, KEY, "left")


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, lo, n) of a batch's ``runs``."""
    runs = batch.column(batch.schema.get_field_index("runs"))
    ptr, flat = runs.offsets.to_numpy().astype(np.int64), runs.values.to_numpy()
    return ptr, flat >> 16, flat & 0xFFFF
