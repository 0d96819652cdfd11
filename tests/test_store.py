"""The store as a database in a folder, and SQL over its tables."""

import pytest
from pyspark.sql import functions as F

from cdm_engine import Rule, Store, extract_concepts
from cdm_engine.functions.sqltext import mark_previous
from cdm_engine.sources import files, manifest


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "base")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_another_session_opens_attaches_and_reads_older_versions(spark, root):
    one = Store.open(spark, root)
    one.put("T", spark.range(3))
    one.save("T")
    one.put("T", spark.range(5))
    one.save("T")
    two = Store.open(spark.newSession(), root)
    assert two.versions("T") == 2 and ids(two.get("T")) == [0, 1, 2, 3, 4] and ids(two.get("T", version=0)) == [0, 1, 2]
    three = Store(spark)
    three.attach("old", root)
    assert three.exists("old.T") and ids(three.get("old.T")) == [0, 1, 2, 3, 4] and three.names() == []
    source = spark.createDataFrame([("T", "1", "p", "x")], "ori_table string, unique_id string, person_id string, kind string")
    one.put("R", source)
    one.save("R")
    three.attach("origin", root)
    assert [r.concept_id for r in extract_concepts(three, [Rule("c", "R", (("kind", "X"),))], namespace="origin").collect()] == ["c"]


def test_put_alone_stays_in_the_session(spark, root):
    one = Store.open(spark, root)
    one.put("T", spark.range(1))
    assert not Store.open(spark, root).exists("T")
    one.commit()
    assert Store.open(spark, root).exists("T")


def test_a_write_that_dies_leaves_the_old_version_whole(spark, root, monkeypatch):
    store = Store.open(spark, root)
    store.put("T", spark.range(3))
    store.save("T")
    # while data is written
    store.put("T", spark.range(0, 100, 1, 4).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id"))))
    with pytest.raises(Exception, match="lost"):
        store.save("T")
    assert Store.open(spark, root).versions("T") == 1 and ids(Store.open(spark, root).get("T")) == [0, 1, 2]
    # after the data, before the state has its name
    store = Store.open(spark, root)
    store.put("T", spark.range(7))

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(manifest, "publish", dies)
    with pytest.raises(KeyboardInterrupt):
        store.save("T")
    monkeypatch.undo()
    assert len(files.names(spark, f"{root}/data/T")) == 3  # what was left behind
    later = Store.open(spark, root)
    assert later.versions("T") == 1 and ids(later.get("T")) == [0, 1, 2]
    later.put("T", spark.range(2))
    later.save("T")
    assert ids(Store.open(spark, root).get("T")) == [0, 1]


def test_sessions_that_save_at_the_same_time_lose_nothing(spark, root, monkeypatch):
    one, two = Store.open(spark, root), Store.open(spark, root)
    one.put("A", spark.range(1))
    two.put("B", spark.range(2))
    publish, first = manifest.publish, []

    def late(s, source, target):  # the other session commits just before
        if not first:
            first.append(1)
            two.commit()
        return publish(s, source, target)

    monkeypatch.setattr(manifest, "publish", late)
    one.commit()
    again = Store.open(spark, root)
    assert sorted(again.names()) == ["A", "B"] and manifest.Manifest(spark, root).state()["number"] == 2
    assert one.exists("B")
    two.refresh()
    assert two.exists("A")


def test_drop_and_expire(spark, root):
    store = Store.open(spark, root)
    for n in (1, 2, 3):
        store.put("T", spark.range(n))
        store.save("T")
    assert store.expire("T", 1) == 2 and store.versions("T") == 1 and len(files.names(spark, f"{root}/data/T")) == 1
    store.drop("T")
    assert not store.exists("T") and not Store.open(spark, root).exists("T")
    with pytest.raises(ValueError):
        store.expire("T", 0)
    with pytest.raises(ValueError):
        Store(spark).save("T") if Store(spark).put("x", spark.range(1)) is None else Store(spark).commit()


def test_old_states_go(spark, root, monkeypatch):
    monkeypatch.setattr(manifest, "KEPT", 3)
    store = Store.open(spark, root)
    for _ in range(6):
        store.commit([], journal={"x": 1})
    assert files.names(spark, f"{root}/_versions") == [f"{n:012d}.json" for n in (4, 5, 6)]
    assert Store.open(spark, root).journal == {"x": 1}


def test_attached_tables_are_read_only(spark, root, tmp_path):
    base = Store.open(spark, root)
    base.put("T", spark.range(1))
    base.save("T")
    other = Store.open(spark, str(tmp_path / "other"))
    other.attach("o", root)
    with pytest.raises(ValueError, match="attached"):
        other.save("o.T")
    other.commit()
    assert Store.open(spark, str(tmp_path / "other")).names() == []


def test_pipelines_of_sql_are_kept(spark, root):
    one = Store.open(spark, root)
    one.put("T", spark.range(10))
    one.put("U", spark.range(5))
    one.add_step("evens", "SELECT id FROM %s WHERE id % 2 = 0", base="T")
    one.add_step("evens", "SELECT id FROM {prev} JOIN U USING (id)")
    one.add_step("mine", lambda df: df.limit(1), base="T")
    one.commit()
    two = Store.open(spark, root)
    assert ids(two.get("evens")) == [0, 2, 4] and two.pipelines() == {"evens": "evens_view_2"}
    three = Store(spark)
    three.attach("o", root)
    assert ids(three.get("o.evens")) == [0, 2, 4]


@pytest.fixture
def tables(spark):
    store = Store(spark)
    store.put("part", spark.createDataFrame([(1, "a{b"), (2, "c")], "id long, name string"))
    store.put("Orders", spark.createDataFrame([(1, 5), (2, 6), (2, 7)], "id long, n long"))
    store.attach("origin", {"part": spark.range(1)})
    store.add_step("big", "SELECT * FROM %s WHERE n > 5", base="Orders")
    return store


@pytest.mark.parametrize(
    "sql,expected",
    [
        ("SELECT part.name, o.n FROM part JOIN orders o ON part.id = o.id WHERE part.name <> '{x} %s'", [("a{b", 5), ("c", 6), ("c", 7)]),
        ("SELECT p.id FROM origin.part p", [(0,)]),
        ("SELECT part.id FROM origin.part", [(0,)]),
        ("SELECT count(*) FROM big", [(2,)]),
        ("WITH part AS (SELECT id FROM part WHERE id = 2) SELECT id FROM part", [(2,)]),
        ("WITH a AS (SELECT id FROM part), b AS (SELECT id FROM a) SELECT max(id) FROM b -- from part", [(2,)]),
        ("SELECT id FROM part WHERE EXISTS (SELECT 1 FROM big WHERE big.id = part.id) AND id IN (SELECT id FROM part)", [(2,)]),
        ("TABLE origin.part", [(0,)]),
        ("SELECT '😀{', id FROM part WHERE id = (SELECT min(id) FROM part)", [("😀{", 1)]),
        ("SELECT id FROM part UNION ALL SELECT n FROM `Orders`", [(1,), (2,), (5,), (6,), (7,)]),
        ("SELECT count(*) FROM part, part AS other", [(4,)]),
    ],
)
def test_sql_over_tables(tables, sql, expected):
    assert sorted(tuple(r) for r in tables.sql(sql).collect()) == expected


def test_unknown_tables_are_left_to_the_catalog(tables, spark):
    spark.range(4).createOrReplaceTempView("of_the_session")
    assert tables.sql("SELECT count(*) AS n FROM of_the_session JOIN part USING (id)").first().n == 2
    with pytest.raises(Exception, match="no_such"):
        tables.sql("SELECT * FROM no_such")


def test_marks_in_strings_stay():
    assert mark_previous("SELECT '%s', \"{prev}\", `%s` FROM %s -- %s\n/* {prev} */ JOIN {prev}") == "SELECT '%s', \"{prev}\", `%s` FROM _previous_step -- %s\n/* {prev} */ JOIN _previous_step"


def test_step_with_percent_in_a_literal(tables):
    tables.add_step("p", "SELECT id, date_format(DATE '2024-01-02', 'yyyy') AS y FROM %s WHERE name LIKE '%s%' OR name LIKE 'c%'", base="part")
    tables.add_step("p", "SELECT x.id, n FROM {prev} x JOIN Orders ON x.id = Orders.id")
    assert sorted(tuple(r) for r in tables.get("p").collect()) == [(2, 6), (2, 7)]
