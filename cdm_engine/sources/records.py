"""CSV records from lines, where quoted fields may hold line ends, while files stay split between tasks.

A line read without knowing what comes before it either starts inside a quoted field or outside. For each block of a file (as
Spark splits it) a first pass finds, for both cases, whether the block ends inside a field and how many records start in it; folded over
the blocks of a file this gives the true case and the number of records before each block. The second pass then cuts every block
into records by itself and numbers them, so that a record's number doesn't depend on how files are split. A record that reaches into
later blocks is put together from their beginnings.

Fields are separated by commas; a quoted field begins with its quote and holds quotes doubled; what stands between a closing
quote and the next comma belongs to the field; a quote elsewhere is an ordinary character. Lines end with a line feed (with a carriage return before it or without).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import saved

_QUOTED = r'"(?:[^"]|"")*"(?:[^",][^,]*)?'
_FIELD = rf'(?:{_QUOTED}|[^",][^,]*|)'
#: A line that starts and ends outside quoted fields.
CLOSED = rf"^{_FIELD}(?:,{_FIELD})*$"
_FIELDS = re.compile(rf"(?:{_FIELD},)*")
_LAST = re.compile(_QUOTED)
_CLOSING = re.compile(r'(?:[^"]|"")*"(?:[^",][^,]*)?(?=,|\Z)')

#: Blocks up to which their table is broadcast (some 100 bytes each).
SMALL = 200_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field."""
    at = 0
    if inside:
        m = _CLOSING.match(line)
        if not m:
            return True
        at = m.end() + 1  # behind the comma
    at = _FIELDS.match(line, at).end() if at <= len(line) else at
    return line.startswith('"', at) and not _LAST.fullmatch(line, at)


class Lines:
    """A run of lines of one block."""

    def __init__(self, values: pa.Array):
        self.values = values
        quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False)
        closed = ~quoted
        some = np.flatnonzero(quoted)
        if len(some):
            closed[some] = pc.match_substring_regex(values.take(pa.array(some)), CLOSED).to_numpy(zero_copy_only=False)
        self.quoted, self.open = some, np.flatnonzero(~closed)
        self.blank = pc.equal(pc.utf8_trim_whitespace(values), "").to_numpy(zero_copy_only=False)

    def starts(self, inside: bool) -> tuple[np.ndarray, bool]:
        """(which lines start a record, whether the last one ends inside a field)."""
        n, i = len(self.values), 0
        out = np.zeros(n, bool)
        while i < n:
            stops = self.quoted if inside else self.open
            k = int(np.searchsorted(stops, i))
            j = int(stops[k]) if k < len(stops) else n
            if not inside:
                out[i : j + 1] = True
            if j < n:
                inside = ends_inside(self.values[j].as_py(), inside)
            i = j + 1
        return out, inside


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """((file, block), first row, end) of the runs of a batch."""
    file, block = batch.column(0), batch.column(1).to_numpy()
    if not len(block):
        return
    same = np.asarray(pc.equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False), bool) if len(block) > 1 else np.zeros(0, bool)
    edge = np.concatenate([[0], np.flatnonzero(~same | (block[1:] != block[:-1])) + 1, [len(block)]])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield (file[a].as_py(), int(block[a])), a, b


SURVEY = "file string, block long, valid boolean, outside_ends boolean, outside_n long, inside_ends boolean, inside_n long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, value, valid) to a row for each block."""
    key, now = None, [True, False, 0, True, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("file", "block", "valid", "outside_ends", "outside_n", "inside_ends", "inside_n"), (*key, *now), strict=True))])

    for batch in batches:
        for own, a, b in _runs(batch):
            if own != key:
                if key is not None:
                    yield row()
                key, now = own, [True, False, 0, True, 0]
            lines = Lines(batch.column(2).slice(a, b - a))
            now[0] = now[0] and bool(pc.all(batch.column(3).slice(a, b - a)).as_py())
            first, ends = lines.starts(now[1])
            second, also = (first, ends) if now[1] == now[3] else lines.starts(now[3])
            now[1], now[3] = ends, also
            now[2] += int((first & ~lines.blank).sum())
            now[4] += int((second & ~lines.blank).sum())
    if key is not None:
        yield row()


def _fold(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one file, in order: whether each starts inside a field, ends so, and how many records start before it."""
    blocks = blocks.sort_values("block")
    inside, base, out = False, 0, []
    for r in blocks.itertuples(index=False):
        ends, n = (r.inside_ends, r.inside_n) if inside else (r.outside_ends, r.outside_n)
        out.append((r.file, r.block, r.valid, inside, ends, base))
        inside, base = ends, base + n
    return pd.DataFrame(out, columns=["file", "block", "valid", "opened", "ends_open", "base"])


def _records(parts: bool):
    """(file, block, opened, base, value) to (file, block, kind, row, record), ``kind``: 0 a record, 1 one whose end is in a later
    block, 2 what a block holds of a record that starts before it. ``parts``: kinds 1 and 2, else kind 0."""

    def made(key: tuple, kind: int, rows: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.repeat(pa.scalar(key[0], pa.string()), n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.repeat(pa.scalar(kind, pa.int32()), n), pa.array(rows.astype(np.int64)), texts]
        return pa.RecordBatch.from_arrays(columns, names=["file", "block", "kind", "row", "record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, row, held, kind = None, False, 0, [], 0

        def rest() -> Iterator[pa.RecordBatch]:  # what a block ends with
            if held and parts:
                yield made(key, kind, np.array([row - 1 if kind == 1 else -1]), pa.array(["\n".join(held)], pa.string()))

        for batch in batches:
            for own, a, b in _runs(batch):
                if own != key:
                    yield from rest()
                    key, inside, row, held = own, bool(batch.column(2)[a].as_py()), int(batch.column(3)[a].as_py()), []
                    kind = 2 if inside else 1
                lines = Lines(batch.column(4).slice(a, b - a))
                before = inside
                first, inside = lines.starts(inside)
                if not before and not inside and first.all():  # a record in each line
                    some = np.flatnonzero(~lines.blank)
                    if not parts:
                        yield made(own, 0, row + np.arange(len(some)), lines.values.take(pa.array(some)))
                    row += len(some)
                    continue
                rows, texts = [], []
                for text, new, blank in zip(lines.values.to_pylist(), first.tolist(), lines.blank.tolist(), strict=True):
                    if new:
                        if held:  # ended with the line before
                            if kind == 1:
                                rows.append(row - 1)
                                texts.append("\n".join(held))
                            elif parts:
                                yield made(own, 2, np.array([-1]), pa.array(["\n".join(held)], pa.string()))
                        held, kind = [], 1
                        if blank:
                            continue
                        row += 1
                    held.append(text)
                if held and not inside:
                    if kind == 1:
                        rows.append(row - 1)
                        texts.append("\n".join(held))
                    elif parts:
                        yield made(own, 2, np.array([-1]), pa.array(["\n".join(held)], pa.string()))
                    held, kind = [], 1
                if rows and not parts:
                    yield made(own, 0, np.array(rows), pa.array(texts, pa.string()))
        if key is not None:
            yield from rest()

    return run


def lines_of(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """(file, block, value) of text files below a folder, whose path in URIs is ``root``."""
    return spark.read.option("lineSep", "\n").text(paths).select(relative(F.col("_metadata.file_path"), root).alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def relative(path: Column, root: str) -> Column:
    """The part of a file's path behind the folder's."""
    return F.substring(path, F.locate(f"{root}/", path) + len(root) + 1, F.lit(1 << 20))


def survey_blocks(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """(file, block, valid, opened, ends_open, base) of all blocks: one pass over the files. Bytes that aren't UTF-8, which Spark would
    replace, are an error."""
    lines = lines_of(spark, paths, root).withColumns({"valid": F.is_valid_utf8("value"), "value": F.make_valid_utf8("value")}).select("file", "block", "value", "valid")
    found = lines.mapInArrow(_survey, SURVEY)
    blocks = saved(found.groupBy("file").applyInPandas(_fold, "file string, block long, valid boolean, opened boolean, ends_open boolean, base long"), "blocks")
    for r in blocks.where("not valid").select("file").limit(1).collect():
        raise ValueError(f"{r.file}: not UTF-8")
    return blocks


def records(spark: SparkSession, paths: list[str], root: str, blocks: DataFrame) -> DataFrame:
    """(file, row, record) of the files' records, numbered from 0 in each file; blank lines between records don't count."""
    some = blocks.agg(F.count(F.lit(1)).alias("n"), F.count_if("opened").alias("opened")).first()
    near = (lambda df: F.broadcast(df)) if some.n <= SMALL else (lambda df: df)
    where = blocks.select("file", "block", "opened", "base", "ends_open")
    fields = ["file", "block", "opened", "base", "value"]
    lines = lines_of(spark, paths, root)
    found = lines.join(near(where), ["file", "block"], "left")
    checked = F.when(F.col("opened").isNull(), F.raise_error(F.lit("files were split in other places while they were read")).cast("boolean")).otherwise(F.col("opened")).alias("opened")
    kinds = "file string, block long, kind int, row long, record string"
    whole = found.select("file", "block", checked, "base", "value").mapInArrow(_records(False), kinds).select("file", "row", "record")
    if not some.opened:
        ends = blocks.where("ends_open").limit(1).count()  # a field that the file's end closes
        if not ends:
            return whole
    pieces = lines.join(near(where.where("opened or ends_open")), ["file", "block"]).select(*fields).mapInArrow(_records(True), kinds)
    order = F.struct("block", (-F.col("kind")).alias("kind"))
    number = F.expr("sum(if(kind = 1, 1, 0)) over (partition by file order by block, kind desc rows unbounded preceding)")
    joined = pieces.withColumn("n", number).groupBy("file", "n").agg(F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct(order.alias("at"), "record"))).alias("parts"))
    return whole.unionByName(joined.select("file", "row", F.array_join("parts.record", "\n").alias("record")))
