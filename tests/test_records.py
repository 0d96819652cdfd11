"""Quoted line ends in split files: the rows of a reading in one task, whatever the splits; ids free of paths."""

import csv
import io
import shutil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cdm_engine import Store, assign_ids, load_tables, read_metadata
from cdm_engine.operators.conform import Diagnostics
from cdm_engine.sources import records as r
from cdm_engine.sources.ingest import column_names
from cdm_engine.store import ROW_SEQ


def _text(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


field = st.text(st.sampled_from(list('ab",\n ')), max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(field, min_size=2, max_size=3), min_size=1, max_size=8), st.booleans())
def test_lines_are_cut_where_records_end(rows, inside):
    text = _text(rows)
    lines = text.split("\n")[:-1]
    state, starts = False, []
    for line in lines:
        starts.append(not state)
        state = r.ends_inside(line, state)
    assert not state
    records = []
    for line, new in zip(lines, starts):
        records = [*records, line] if new else [*records[:-1], f"{records[-1]}\n{line}"]
    assert [next(csv.reader(io.StringIO(x, newline="")), []) for x in records] == [x if x != [""] else x for x in rows]
    import pyarrow as pa

    run = r.Lines(pa.array(lines, pa.string()))
    found, ends = run.starts(False)
    assert found.tolist() == starts and not ends
    state, want = inside, []
    for line in lines:
        want.append(not state)
        state = r.ends_inside(line, state)
    found, ends = run.starts(inside)
    assert found.tolist() == want and ends == state


@pytest.mark.parametrize("line,inside,expected", [('5" pipe,x', False, False), ('"a""b', False, True), ('"a"b"c,d', False, False), ('x",y', True, False), ('x"",y', True, True), ('x","y', True, True), ("", True, True), ('"a"\r', False, False), (',"', False, True)])
def test_quotes(line, inside, expected):
    assert r.ends_inside(line, inside) is expected


@pytest.fixture
def split(spark):
    """Files are split into pieces of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def to(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def _load(spark, folder, table="T"):
    store = Store(spark)
    load_tables(store, str(folder), {}, [table], "csv")
    return store.get(table)


def _rows(df):
    return [tuple(x) for x in df.orderBy(ROW_SEQ).drop(ROW_SEQ).collect()]


@pytest.fixture(scope="module")
def notes(tmp_path_factory):
    folder = tmp_path_factory.mktemp("notes") / "in st"
    folder.mkdir()
    rows = [[str(k), "line one,\nline \"two\"\n" * (k % 5) + "end", "x" * (k % 17)] for k in range(120)]
    rows.insert(60, [" both \n", "\n".join(f'"{n}",{n}' for n in range(600)), ""])  # over many splits
    (folder / "T 1.csv").write_text(_text([["id", "note", "more"], *rows]), newline="")
    (folder / "T 2.csv").write_text(_text([["id", "note", "more"], ["crlf", "a\nb", "c"], ["5\" pipe", "y", "z"]], "\r\n"), newline="")
    (folder / "T 3.csv").write_text('id,other\n\n  \n7,"open to the\nend', newline="")
    return folder, [(*x, "") for x in []], rows


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_rows_are_those_of_one_reading_whatever_the_splits(spark, notes, split, size):
    folder, _, rows = notes
    split(size)
    df = _load(spark, folder)
    want = [(*x, None) for x in rows] + [("crlf", "a\nb", "c", None), ('5" pipe', "y", "z", None), ("7", None, None, "open to the\nend")]
    assert df.columns[:-1] == ["id", "note", "more", "other"] and _rows(df) == want
    if size < 1000:
        assert df.rdd.getNumPartitions() > 30


def test_ids_depend_on_neither_splits_nor_folders(spark, notes, split, tmp_path):
    shutil.copytree(notes[0], tmp_path / "elsewhere")
    found = []
    for folder, size in ((notes[0], 1 << 20), (tmp_path / "elsewhere", 1 << 20), (notes[0], 500)):
        split(size)
        found.append(sorted(tuple(x) for x in assign_ids(_load(spark, folder), "T").select("unique_id", "id").collect()))
    assert found[0] == found[1] == found[2] and len({i for i, _ in found[0]}) == len(found[0]) == 124


def test_parquet_ids_depend_on_neither_splits_nor_folders(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "a/P.parquet"))
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    found = []
    for folder in ("a", "b"):
        store = Store(spark)
        load_tables(store, str(tmp_path / folder), {}, ["P"])
        found.append(sorted(tuple(x) for x in assign_ids(store.get("P"), "P").select("unique_id", "id").collect()))
    assert found[0] == found[1] and len({i for i, _ in found[0]}) == 1000


def test_columns_named_like_the_files_metadata(spark, tmp_path):
    (tmp_path / "T.csv").write_text("_metadata,a\n1,2\n")
    assert _rows(_load(spark, tmp_path)) == [("1", "2")]
    spark.createDataFrame([(1, 2)], "_metadata int, a int").write.parquet(str(tmp_path / "P.parquet"))
    store = Store(spark)
    load_tables(store, str(tmp_path), {}, ["P"])
    assert _rows(store.get("P")) == [(1, 2)]


def test_names_of_columns():
    assert column_names('a,"b\nc",,A,"d""e"') == ["a0", "b\nc", "_c2", "A3", 'd"e']


def test_empty_files(spark, tmp_path):
    (tmp_path / "T1.csv").write_text("a,b\n")
    (tmp_path / "T2.csv").write_text("a,b")
    assert _rows(_load(spark, tmp_path)) == []


SPEC = [{"TABLE": "T", "Variable": v, "Mandatory": "No", "Format": f} for v, f in (("id", "Numeric"), ("d", "yyyymmdd"), ("e", "yyyymmdd"), ("t", "Character"))]


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counts_of_what_a_load_changed(spark, tmp_path):
    (tmp_path / "T.csv").write_text("id,d,e,t\n1,20220410,2022-04-10,x\n2,20220231,2022-04-11,\n3,soon,NA,NA\n4,,2022-04-12,\n")
    notes = load_tables(Store.open(spark, str(tmp_path / "base")), str(tmp_path), read_metadata(SPEC))
    assert notes.counts == {"T": {"rows": 4, "impossible dates in d": 2, "impossible dates in e": 0, "blanks in t": 2}}
    assert "T: d: 2 values are no dates and became NULL" in notes.of("info")
    version = Store.open(spark, str(tmp_path / "base")).saved_version("T")
    assert version.counts == notes.counts["T"]


def test_counting_adds_no_job(spark, tmp_path, monkeypatch):
    (tmp_path / "T.csv").write_text("id,d,e,t\n1,20220410,2022-04-10,x\n")
    from cdm_engine.sources import ingest

    run = lambda k: load_tables(Store(spark), str(tmp_path), read_metadata(SPEC), save_to=str(tmp_path / f"saved{k}"))
    counted = _jobs(spark, "counted", lambda: run(1))
    conform = ingest.conform
    monkeypatch.setattr(ingest, "conform", lambda *a: conform(*a[:5]))
    monkeypatch.setattr(ingest, "observed", lambda _: {})
    assert _jobs(spark, "plain", lambda: run(2)) == counted


def test_a_load_is_one_state(spark, tmp_path):
    (tmp_path / "T.csv").write_text("id\n1\n")
    (tmp_path / "U.csv").write_text("id\n1\n")
    store = Store.open(spark, str(tmp_path / "base"))
    load_tables(store, str(tmp_path), {}, ["T", "U"], notes=Diagnostics())
    assert store._manifest.state()["number"] == 1 and sorted(Store.open(spark, store.root).names()) == ["T", "U"]


def test_files_in_order_are_bounded_and_places_go_on(spark, split, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from cdm_engine.plans import catalog

    keys = F.when(F.col("id") != 500, F.col("id") * 7919 % 1000)  # shuffled, one of them null
    spark.range(1000).select(keys.alias("o_orderkey"), F.lit("2-HIGH").alias("o_orderpriority")).repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    tasks, write = [], catalog._csv

    def counted(df, *rest):
        tasks.extend(df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())
        write(df, *rest)

    monkeypatch.setattr(catalog, "_csv", counted)
    monkeypatch.setattr(catalog, "FILE_ROWS", 100, raising=False)
    split(500)
    found = sorted(catalog.load_split_csv(spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert sum(tasks) == 1000 and max(tasks) < 250  # ranges come from a sample
    none = 500 * 7919 % 1000
    want = [*(k for k in range(1000) if k != none), None]
    notes = {0: '2-HIGH\n"second" line,\n', 1: '5" pipe', 2: "", 3: "2-HIGH", None: "2-HIGH"}
    assert [tuple(r) for r in found] == [(None if k is None else str(k), notes[k if k is None else k % 4], n) for n, k in enumerate(want, 1)]
