"""The contract of the entry module, with and without the optional subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(SF):
        assert e.entry(spark).columns[:3] == ["ori_table", "unique_id", "person_id"]


def test_library_stands_without_the_subpackage():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("cdm_engine.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e, cdm_engine
assert e.queries() and "pipeline" not in e.queries() and not any(q.startswith("op") for q in e.queries())
"""
    for blocked in (code, code.replace('name.startswith("cdm_engine.llm") or name == "corpus_pipeline"', 'name in ("xxhash", "ahocorasick")')):
        done = subprocess.run([sys.executable, "-c", blocked], check=True, cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True)
        assert "no training-data queries" in done.stderr  # not silently


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from cdm_engine.plans import catalog

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in catalog.oracle_sql().items():
        df, want = catalog.queries()[name](spark, SF), con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns), name
        got = sorted((tuple(str(r[c]) for c in cols) for r in df.collect()))
        at = [want.columns.index(c) for c in cols]
        assert got == sorted(tuple(str(r[k]) for k in at) for r in want.fetchall()), name
