import pytest

from cdm_engine import Store, load_tables, read_metadata
from cdm_engine.operators.conform import Diagnostics
from cdm_engine.sources.discovery import choose
from cdm_engine.sources.text_import import import_text
from cdm_engine.store import ROW_SEQ

META = [
    {"TABLE": "MEDICINES", "Variable": v, "Mandatory": m, "Format": f}
    for v, m, f in [
        ("person_id", "Yes", "Character"), ("product_id", "Yes", "Character"), ("date_given", "Yes", "Character yyyymmdd"),
        ("atc", "No", "Character"), ("unit", "Yes", "Character"), ("amount", "No", "Numeric"),
    ]
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "MEDICINES_A.csv").write_text('product_id,date_given,person_id,extra\n"p1",20220410,1,x\np2,NA,,y\n')
    (tmp_path / "MEDICINES_B.csv").write_bytes("﻿person_id,atc,date_given,amount\n2,N02B,2022-04-11,5\n3,NA,20220231,\n".encode())
    (tmp_path / "OLD_MEDICINES.csv").write_text("person_id\n9\n")
    return str(tmp_path)


def rows(df):
    return [tuple(r) for r in df.orderBy(ROW_SEQ).drop(ROW_SEQ).collect()]


def test_files_are_matched_by_name_and_conformed(spark, folder):
    store = Store(spark)
    notes = load_tables(store, folder, read_metadata(META), ["MEDICINES", "PERSONS"])
    df = store.get("MEDICINES")
    assert store.columns("MEDICINES") == ["product_id", "date_given", "person_id", "atc", "amount", "unit"]
    assert dict(df.dtypes)["date_given"] == "date"
    got = [(r[0], str(r[1]) if r[1] else None, *r[2:]) for r in rows(df)]
    # a mixed column: only yyyymmdd stays, also no day that doesn't exist; blanks of text become NULL, of numbers they stay
    assert got == [
        ("p1", "2022-04-10", "1", None, None, None),
        ("p2", None, None, None, None, None),
        (None, None, "2", "N02B", "5", None),
        (None, None, "3", None, "", None),
    ]
    assert "PERSONS: no files" in notes.of("warning")


def test_iso_columns_and_rowwise_repair(spark, tmp_path):
    (tmp_path / "E.csv").write_text("d\n2022-04-11\nNA\n")
    (tmp_path / "F.csv").write_text("d\n2022-04-11\n20220412\n01/02/2022\n")
    meta = read_metadata([{"TABLE": t, "Variable": "d", "Mandatory": "No", "Format": "yyyymmdd"} for t in "EF"])
    store = Store(spark)
    load_tables(store, str(tmp_path), meta, strict_dates=False)
    assert [str(r[0]) for r in rows(store.get("F"))] == ["2022-04-11", "2022-04-12", "None"]
    store = Store(spark)
    load_tables(store, str(tmp_path), meta)
    assert [str(r[0]) for r in rows(store.get("E"))] == ["2022-04-11", "None"]
    assert [str(r[0]) for r in rows(store.get("F"))] == ["None", "2022-04-12", "None"]


def test_parquet_is_preferred_and_keeps_iso(spark, tmp_path):
    (tmp_path / "E.csv").write_text("d\n1\n")
    spark.createDataFrame([("20220410",), ("2022-04-11",), ("x",)], "d string").coalesce(1).write.parquet(str(tmp_path / "E.parquet"))
    assert choose(spark, str(tmp_path), "E")[0] == "parquet"
    store = Store(spark)
    load_tables(store, str(tmp_path), read_metadata([{"TABLE": "E", "Variable": "d", "Mandatory": "No", "Format": "yyyymmdd"}]), save_to=str(tmp_path / "saved"))
    assert [str(r[0]) for r in rows(store.get("E"))] == ["2022-04-10", "2022-04-11", "None"]
    assert store.versions("E") == 2
    with pytest.raises(ValueError):
        choose(spark, str(tmp_path), "E", "xlsx")


def test_files_with_the_same_header_and_conflicting_types(spark, tmp_path):
    for k in (3, 1, 2):
        (tmp_path / f"E{k}.csv").write_text(f"a,b\n{k},x\n{k}{k},y\n")
    (tmp_path / "E4.csv").write_text("b,a\nz,4\n")
    store = Store(spark)
    load_tables(store, str(tmp_path), {}, ["E"], "csv")
    assert rows(store.get("E")) == [("1", "x"), ("11", "y"), ("2", "x"), ("22", "y"), ("3", "x"), ("33", "y"), ("4", "z")]
    spark.createDataFrame([(1,)], "v int").coalesce(1).write.parquet(str(tmp_path / "F1.parquet"))
    spark.createDataFrame([("x",)], "v string").coalesce(1).write.parquet(str(tmp_path / "F2.parquet"))
    load_tables(store, str(tmp_path), {}, ["F"])
    assert rows(store.get("F")) == [("1",), ("x",)]


def test_tables_in_other_forms(spark):
    import pandas as pd
    import pyarrow as pa

    from cdm_engine.functions.frames import as_frame

    for data in (pd.DataFrame({"a": [1]}), pa.table({"a": [1]}), [{"a": 1}], spark.range(1)):
        assert as_frame(spark, data).count() == 1
    for data in (None, [], 5):
        with pytest.raises(ValueError):
            as_frame(spark, data)


def test_wrong_encoding_is_an_error(spark, tmp_path):
    (tmp_path / "E.csv").write_bytes("name\nJosé\n".encode("latin-1"))
    with pytest.raises(ValueError, match="UTF-8"):
        load_tables(Store(spark), str(tmp_path), read_metadata([{"TABLE": "E", "Variable": "name", "Mandatory": "No", "Format": "Character"}]))


def test_metadata_sources(spark, tmp_path):
    spark.createDataFrame([(r["TABLE"], r["Variable"], r["Mandatory"], r["Format"]) for r in META], "TABLE string, Variable string, Mandatory string, Format string").write.parquet(str(tmp_path / "m.parquet"))
    assert read_metadata(str(tmp_path / "m.parquet"), spark)["MEDICINES"].of_kind("date") == ["date_given"]
    with pytest.raises(ValueError):
        read_metadata(str(tmp_path / "m.rds"), spark)


def test_import_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a;b;d\n" x\t";" ";20220410\ny;z;2022\n')
    df = import_text(spark, str(tmp_path / "x.csv"), {"a": "first", "d": "day"}, ["day"], "first is not null", ";")
    assert [(r[0], str(r[1])) for r in df.collect()] == [("x", "2022-04-10"), ("y", "None")]
    assert Diagnostics().of("info") == []
