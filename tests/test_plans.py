"""The physical plans that large inputs depend on."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from cdm_engine import Rule, dedup, extract_concepts, match_codelist, row_counts
from cdm_engine.operators.provenance import origin_values
from cdm_engine.store import Store


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("r") / "records")
    spark.range(1000).select(
        F.lit("R").alias("ori_table"), F.col("id").cast("string").alias("unique_id"), F.col("id").cast("string").alias("person_id"), (F.col("id") % 7).cast("string").alias("kind"),
        F.lit("x").alias("unused"), F.col("id").alias("value"), F.current_date().alias("day"), F.col("id").alias("_row_seq"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_rules_share_one_scan_and_a_hash_join(records):
    rules = [Rule(f"c{k}", "R", (("kind", str(k)),), "value", "day") for k in range(40)]
    text = plan(extract_concepts({"R": records}, rules, cutoff="2020-01-01"))
    assert text.count("Scan parquet") == 2  # listed once in the tree and once in the details
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
    assert "unused" not in text and "EvalPython" not in text


def test_codes_are_matched_in_one_join_and_sources_read_once(spark, records, monkeypatch):
    from cdm_engine.operators import codelist

    found = records.groupBy(F.lit("ATC").alias("coding_system"), F.col("kind").alias("code")).agg(F.count(F.lit(1)).alias("COUNT")).withColumn("source_column", F.lit("kind"))
    study = spark.createDataFrame([("ATC", "1", "c"), ("S", "2", "d")], "coding_system string, code string, concept_id string")
    written, saved = {}, codelist.saved
    monkeypatch.setattr(codelist, "saved", lambda df, label: written.update({label: plan(df)}) or saved(df, label))
    last = plan(match_codelist(found, study))
    assert all("NestedLoop" not in text and "Cartesian" not in text for text in (*written.values(), last))
    reads = [text.count("/records]") for text in (*written.values(), last)]
    assert reads == [1, 0, 0, 0]  # the records are read by the inventory alone
    assert written["matches"].split("\n\n")[0].count("Join ") == 1 and "WindowGroupLimit" not in last


def test_keep_first_gathers_no_key(records):
    for df in dedup(records, ["kind"], "keep_first"):
        text = plan(df)
        assert "Window" not in text and "partial_min" in text


def test_counts_read_no_columns(spark, records):
    store = Store(spark)
    store.put("a", records)
    store.put("b", records)
    assert "ReadSchema: struct<>" in plan(row_counts(store))


def test_cases_filter_before_the_join(spark, records):
    store = Store(spark)
    store.put("R", records)
    cases = records.select("ori_table", "unique_id")
    text = plan(origin_values(store, cases, [("R", "kind")]))
    assert "EqualTo(ori_table,R)" in text and "unused" not in text
