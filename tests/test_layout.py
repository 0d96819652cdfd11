"""Layouts that lookups and joins rely on: what is read and what is shuffled."""

import pytest
from pyspark.sql import functions as F

from cdm_engine import Layout, Store, apply_layout
from cdm_engine.operators import provenance
from cdm_engine.operators.provenance import origin_rows, origin_values


def scanned(df):
    """(result, rows that its parquet scans put out)."""
    got = df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            found += node.metrics().get("numOutputRows").get().value()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif "QueryStage" in kind:
            todo.append(node.plan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return got, found


@pytest.fixture
def base(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(64 << 10))  # many row groups
    store = Store.open(spark, str(tmp_path / "base"))
    store.put("R", spark.range(0, 40000, 1, 4).select(F.lit("R").alias("ori_table"), F.sha2(F.col("id").cast("string"), 256).alias("unique_id"), F.col("id").alias("n"), F.lit("x").alias("kind")))
    store.commit()
    yield store
    conf.unset("parquet.block.size")


def cases(spark, numbers):
    return spark.createDataFrame([("R", n) for n in numbers], "ori_table string, n long").select("ori_table", F.sha2(F.col("n").cast("string"), 256).alias("unique_id"))


def test_few_ids_read_few_rows(spark, base):
    wanted = cases(spark, [5, 77, 5, 39999, 50000])
    plain, all_rows = scanned(origin_rows(base, wanted, ["R"])["R"])
    apply_layout(base, [Layout("R", ("unique_id",), lookups=("unique_id",))])
    again = Store.open(spark, base.root)
    assert again.layout("R") == {"columns": ["unique_id"], "buckets": 0, "lookups": ["unique_id"]} and again.versions("R") == 2
    found, read = scanned(origin_rows(again, wanted, ["R"])["R"])
    assert sorted(r.n for r in found) == sorted(r.n for r in plain) == [5, 77, 39999]
    assert all_rows >= 40000 and read < 10000
    values, read = scanned(origin_values(again, wanted, [("R", "n"), ("R", "kind")]))
    assert len(values) == 6 and read < 20000
    other = Store(spark)
    other.attach("o", base.root)
    assert other.layout("o.R")["lookups"] == ["unique_id"]


def test_bloom_filters_skip_where_statistics_cannot(spark, base):
    """Rows are not sorted by the id here: every row group spans all of them."""
    apply_layout(base, [Layout("R", ("n",), lookups=("unique_id",))])
    found, read = scanned(origin_rows(base, cases(spark, [123]), ["R"])["R"])
    assert [r.n for r in found] == [123] and read < 10000


def test_many_ids_are_joined(spark, base):
    apply_layout(base, [Layout("R", ("unique_id",), lookups=("unique_id",))])
    numbers = list(range(provenance.POINTS + 1))
    assert sorted(r.n for r in origin_rows(base, cases(spark, numbers), ["R"])["R"].collect()) == numbers
    assert origin_rows(base, cases(spark, []), ["R"])["R"].collect() == []


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_buckets_are_joined_where_they_lie(spark, base, no_broadcast):
    base.put("CASES", cases(spark, range(0, 40000, 400)))
    apply_layout(base, [Layout(t, ("unique_id",), buckets=3) for t in ("R", "CASES")])
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for store in (base, Store.open(other, base.root)):
        rows = origin_rows(store, store.get("CASES"), ["R"])["R"]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(r.n for r in rows.collect()) == list(range(0, 40000, 400))
        values = origin_values(store, store.get("CASES"), [("R", "n")])
        assert values._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # of distinct
        assert values.count() == 100
    unlike = origin_rows(base, cases(spark, [1]), ["R"])["R"]
    assert "Exchange" in unlike._jdf.queryExecution().executedPlan().toString()


def test_layouts_need_a_database(spark):
    store = Store(spark)
    store.put("T", spark.range(3))
    for spec in (Layout("T", ("id",), buckets=2), Layout("T", ("id",), lookups=("id",)), Layout("T", ("no",)), Layout("T", ())):
        with pytest.raises(ValueError):
            apply_layout(store, [spec])
