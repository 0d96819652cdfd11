import pytest
from pyspark.sql import functions as F

from cdm_engine import (
    InventorySpec,
    Layout,
    Rule,
    Store,
    append_distinct,
    apply_layout,
    assign_ids,
    code_inventory,
    dedup,
    drop_missing,
    extract_concepts,
    match_codelist,
    origin_rows,
    origin_values,
    row_counts,
    rules_from_wide,
)
from cdm_engine.operators.quality import dedup_as_configured
from cdm_engine.sources import sinks


def tuples(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# ---- quality


def test_missing_has_three_spellings(spark):
    df = spark.createDataFrame([(1, "Alice"), (2, None), (3, ""), (4, "NA"), (5, "Bob"), (6, "na")], "person_id int, name string")
    assert [r[0] for r in drop_missing(df, ["name"]).collect()] == [1, 5, 6]
    df = spark.createDataFrame([(1, "a"), (None, "b"), (4, "NA")], "person_id int, name string")
    assert tuples(drop_missing(df, ["person_id"])) == [(1, "a"), (4, "NA")]
    with pytest.raises(ValueError):
        drop_missing(df, ["nothing"])


def test_dedup_modes(spark):
    df = spark.createDataFrame([(1, "x", 0), (1, "x", 1), (1, "y", 2), (None, "z", 3), (None, "w", 4)], "k int, v string, _row_seq int")
    kept, removed = dedup(df)
    assert removed is None and kept.count() == 4
    kept, removed = dedup(df, ["k"], "keep_first")
    assert tuples(kept, "_row_seq") == [(0,), (3,)] and tuples(removed, "_row_seq") == [(1,), (2,), (4,)]
    assert dedup_as_configured(df, ["k"], False, False, None)[0].count() == 4
    assert dedup_as_configured(df, ["k"], False, True, None)[0].count() == 5
    assert dedup_as_configured(df, ["k"], False, True, "/x")[0].count() == 2
    with pytest.raises(ValueError):
        dedup(df, ["nothing"], "keep_first")


# ---- identity, combining, counting


def test_ids_are_stable_unique_and_not_doubled(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1)], "v string, _row_seq int")
    one, two = assign_ids(df, "T"), assign_ids(assign_ids(df, "T"), "T")
    assert one.columns == two.columns == ["ori_table", "unique_id", "v", "_row_seq"]
    assert tuples(one) == tuples(two) and one.select("unique_id").distinct().count() == 2


def test_ids_tell_parts_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("-", "ab"), ("a|b", None), (None, None), ("1:a", "b")]
    ids = assign_ids(spark.createDataFrame(rows, "x string, y string"), "T")
    assert ids.select("unique_id").distinct().count() == len(rows)


def test_append_counts_and_layout(spark):
    store = Store(spark)
    store.put("a", spark.createDataFrame([(1, 19000), (1, 19000)], "id int, day int"))
    store.put("b", spark.createDataFrame([(2, 19001)], "x int, y int"))
    out = append_distinct(store, {"a": ["id", "day"], "b": ["x", "y"]}, "c", ["day"])
    assert [(r[0], str(r[1])) for r in out.orderBy("id").collect()] == [(1, "2022-01-08"), (2, "2022-01-09")]
    assert tuples(row_counts(store)) == [("a", 2), ("b", 1), ("c", 2)]
    for bad in ({"nowhere": ["id"]}, {}):
        with pytest.raises(ValueError):
            append_distinct(store, bad)
    with pytest.raises(ValueError):
        row_counts(Store(spark))
    assert apply_layout(store, []) == {}
    assert apply_layout(store, [Layout("a", ("id",))])["a"].count() == 2
    with pytest.raises(KeyError):
        apply_layout(store, [Layout("nowhere", ("id",))])
    with pytest.raises(ValueError):
        apply_layout(store, [Layout("a", ("nothing",))])


def test_store_namespaces_versions_and_pipelines(spark):
    store = Store(spark)
    store.put("persons", spark.createDataFrame([("Ann", 30), ("Ann", 30), ("Bo", 40), ("Cy", 5)], "name string, age int"))
    store.attach("d2", {"persons": spark.createDataFrame([("Z",)], "name string")})
    assert store.get("d2.persons").count() == 1 and store.exists("d2.persons") and not store.exists("d3.persons")
    with pytest.raises(ValueError):
        store.add_step("p", "SELECT * FROM %s")
    assert store.add_step("p", "SELECT * FROM %s WHERE age > 10", base="persons") == "p_view_1"
    assert store.add_step("p", lambda df: df.distinct(), base="ignored") == "p_view_2"
    store.add_step("p", "SELECT *, length(name) AS n FROM {prev} WHERE name LIKE '%n%' OR age = 40")
    assert tuples(store.get("p")) == [("Ann", 30, 3), ("Bo", 40, 2)]
    assert store.get("p_view_1").count() == 3 and store.pipelines() == {"p": "p_view_3"}
    assert "p_view_2" in store.names()


# ---- vocabulary


def test_inventory(spark):
    df = spark.createDataFrame([("A", "ICD10"), ("A", "ICD10"), (None, "ICD10")], "event_code string, vocab string")
    (out,) = code_inventory({"E": df}.__getitem__, [InventorySpec("E", ("vocab", "event_code"), ("coding_system", "code"))])
    assert tuples(out, "code", "COUNT", "source_column") == [("A", 2, "event_code"), (None, 1, "event_code")]
    for bad in ((), ("a", "b")):
        with pytest.raises(ValueError):
            InventorySpec("E", ("x",), bad)
    with pytest.raises(ValueError):
        code_inventory({}.__getitem__, [])


def match(spark, data, study, **options):
    d = spark.createDataFrame(data, "coding_system string, code string, COUNT long, source_column string")
    s = spark.createDataFrame([(k, *r) for k, r in enumerate(study)], "pos int, coding_system string, code string, concept_id string, tags string, priority int")
    return match_codelist(d, s, position="pos", **options).select("coding_system", "`code.dap_codes`", "concept_id", "`code.codelist`", "tags", "match_status")


def test_prefix_takes_the_longest_then_the_lowest_priority(spark):
    study = [("ATC", "N02", "pain", "a", 1), ("ATC", "N02B", "pain", "b", 2), ("ATC", "N02B", "pain", "c", 1), ("ATC", "N02B", "other", "d", 9), ("ATC", "N02B", "nul", "e", 1), ("ATC", "N02B", "nul", "f", None)]
    got = tuples(match(spark, [("ATC", "N02BE01", 3, "x"), ("ATC", "N02BE01", 1, "y"), ("ATC", "B01AC06", 1, "x"), ("ATC", "N", 1, "x"), ("ATC", None, 1, "x")], study))
    assert got == sorted(
        [
            ("ATC", "N02BE01", "pain", "N02B", "c", "MATCHED"), ("ATC", "N02BE01", "other", "N02B", "d", "MATCHED"), ("ATC", "N02BE01", "nul", "N02B", "f", "MATCHED"),
            ("ATC", "B01AC06", None, None, None, "ONLY_IN_DATA"), ("ATC", "N", None, None, None, "ONLY_IN_DATA"), ("ATC", None, None, None, None, "ONLY_IN_DATA"),
            ("ATC", None, "pain", "N02", "a", "ONLY_IN_CODELIST"),
        ],
        key=str,
    )


def test_exact_keeps_all_and_null_matches_null(spark):
    study = [("S", "A", "c1", "", 1), ("S", "A", "c2", "", 2), (None, None, "c3", "", 1), ("S", "Z", "c4", "", 1)]
    got = tuples(match(spark, [("S", "A", 1, "x"), ("S", "A", 2, "y"), (None, None, 1, "x"), ("S", "AB", 1, "x")], study), "concept_id", "match_status")
    assert got == sorted([("c1", "MATCHED")] * 2 + [("c2", "MATCHED")] * 2 + [("c3", "MATCHED"), ("c4", "ONLY_IN_CODELIST"), (None, "ONLY_IN_DATA")], key=str)


def test_codelist_validation(spark):
    good = spark.createDataFrame([("S", "A", 1, "x")], "coding_system string, code string, COUNT int, source_column string")
    with pytest.raises(ValueError, match="lacks"):
        match_codelist(good, good)
    with pytest.raises(ValueError, match="text"):
        match_codelist(good.withColumn("code", F.lit(1)), good.withColumn("concept_id", F.lit("c")))
    plain = match_codelist(good, good.withColumn("concept_id", F.lit("c")))
    assert plain.columns == ["coding_system", "COUNT", "source_column", "code.dap_codes", "concept_id", "code.codelist", "tags", "priority", "length_str", "code", "match_status"]


# ---- concepts


@pytest.fixture
def source(spark):
    rows = [("MO", "u1", "p1", "weight", "x", "70", "2020-01-05", "m1"), ("MO", "u2", "p2", "Weight", "y", None, "2019-01-01", "m2"), ("MO", "u3", "p3", "size", "X", "1", None, "m3")]
    return {"MO": spark.createDataFrame(rows, "ori_table string, unique_id string, person_id string, kind string, flag string, val string, day string, mo_meaning string")}


def test_concept_rules(spark, source):
    rules = [Rule("w", "MO", (("kind", "WEIGHT"),), "val", "day", "s1"), Rule("any", "MO", (("kind", "weight"),), None, None, "s2"), Rule("pair", "MO", (("kind", "size"), ("flag", "x")), "flag", "day")]
    got = tuples(extract_concepts(source, rules, meaning=True).withColumn("date", F.col("date").cast("string")), "unique_id", "concept_id", "code", "coding_system", "value", "date", "meaning")
    assert got == sorted(
        [
            ("u1", "w", "s1", "s1", "70", "2020-01-05", "m1"), ("u2", "w", "s1", "s1", None, "2019-01-01", "m2"),
            ("u1", "any", "s2", "s2", "true", None, "m1"), ("u2", "any", "s2", "s2", "true", None, "m2"), ("u3", "pair", None, None, "X", None, "m3"),
        ],
        key=str,
    )
    late = extract_concepts(source, rules, cutoff="2020-01-05")
    assert tuples(late, "unique_id", "concept_id") == [("u1", "any"), ("u1", "w"), ("u2", "any")]
    upper = extract_concepts(source, [Rule("k", "MO", (("kind", "weight"),), "kind")], upper_values=True)
    assert tuples(upper, "value") == [("WEIGHT",), ("WEIGHT",)]


def test_concept_errors(source):
    with pytest.raises(ValueError, match="no columns"):
        extract_concepts(source, [Rule("w", "MO", (("nothing", "1"),))])
    with pytest.raises(ValueError):
        Rule("w", "MO", ())
    with pytest.raises(ValueError):
        extract_concepts(source, [])


def test_wide_map_pairs_by_ending(spark):
    row = {"concept_id": "c", "cdm_table_name": "MO", "column_name_1": "a", "column_name_2": "b", "column_name_3": "c", "expected_value_1": "X", "expected_value_2": "X", "expected_value_3": "Y", "dap_spec_id": "1"}
    (rule,) = rules_from_wide([row])
    assert rule.where == (("a", "X"), ("b", "X"), ("c", "Y")) and rule.value is None
    with pytest.raises(ValueError, match="expected"):
        rules_from_wide([{**row, "expected_value_2": "NA"}])
    with pytest.raises(ValueError):
        rules_from_wide([{"concept_id": "c", "cdm_table_name": "MO", "column_name_1": None, "expected_value_1": None}])


def test_sinks(spark, source, tmp_path):
    out = extract_concepts(source, [Rule("w", "MO", (("kind", "weight"),)), Rule("v", "MO", (("kind", "size"),))])
    for partition, folder in (("concept_id", "parts"), (None, "plain")):
        for _ in range(2):
            sinks.append_parquet(out, str(tmp_path / folder), partition)
        back = spark.read.parquet(str(tmp_path / folder))
        assert back.count() == 6 and back.select("tag").distinct().count() == 1
    store = Store(spark)
    store.put("concepts", out.where("false").withColumn("meaning", F.lit(None).cast("string")))
    assert sinks.add_to_table(store, "concepts", out).count() == 3
    with pytest.raises(ValueError):
        sinks.add_to_table(store, "concepts", out.withColumn("odd", F.lit(1)))
    assert sinks.save_removed(out.where("false"), str(tmp_path), "T") is None
    path = sinks.save_removed(out, str(tmp_path), "T", "x")
    assert path.endswith("_x.csv") and spark.read.option("header", True).csv(path).count() == 3


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    assert sinks.write_report(df, str(tmp_path), "r.csv").endswith("r.csv") and (tmp_path / "r.csv").read_text() == "id,name\n1,a\n"
    assert sinks.write_report(df, str(tmp_path), "r.fst").endswith("r.parquet")
    for bad in ("", "plain", "r.xyz", ".csv"):
        with pytest.raises(ValueError):
            sinks.write_report(df, str(tmp_path), bad)
    with pytest.raises(FileNotFoundError):
        sinks.write_report(df, str(tmp_path / "nowhere"), "r.csv")


# ---- provenance


def test_origin_values_and_rows(spark):
    store = Store(spark)
    store.put("t1", spark.createDataFrame([("t1", 1, "x", True), ("t1", 2, "y", False)], "ori_table string, unique_id int, a string, b boolean"))
    store.put("t2", spark.createDataFrame([("t2", "q'1", 20)], "ori_table string, unique_id string, n int"))
    store.put("t3", spark.createDataFrame([(1,)], "wrong int"))
    cases = spark.createDataFrame([("t1", "1"), ("t1", "1"), ("t2", "q'1"), (None, "5"), ("t3", "1"), ("t9", "1")], "ori_table string, unique_id string")
    got = tuples(origin_values(store, cases, [("t1", "a"), ("t1", "b"), ("t2", "n"), ("t9", "x"), ("t1", "zz")]))
    assert got == [("t1", "1", "a", "x"), ("t1", "1", "b", "TRUE"), ("t2", "q'1", "n", "20")]
    assert origin_values(store, cases, []).columns == ["ori_table", "unique_id", "column_origin", "value"]
    rows = origin_rows(store, cases)
    assert {t: df.count() for t, df in rows.items()} == {"t1": 1, "t2": 1, "t3": 0, "t9": 0}
    assert origin_rows(store, spark.createDataFrame([(1,)], "x int")) == {}


CODES = "coding_system string, code string"


def test_exploding_codes_are_refused_before_they_are_joined(spark):
    from cdm_engine.operators.codelist import ExplosiveMatch, check_exact, predict_exact

    data = spark.createDataFrame([("X", "a", 1, f"c{k}") for k in range(40)] + [(None, None, 1, "c"), ("ATC", "a", 1, "c")], f"{CODES}, COUNT int, source_column string")
    study = spark.createDataFrame([("X", "a", f"i{k}") for k in range(30)] + [(None, None, "n"), ("X", "z", "z")], f"{CODES}, concept_id string")
    r = predict_exact(data, study).first()
    assert (r.data_rows, r.study_rows, int(r.predicted)) == (42, 32, 1201)
    with pytest.raises(ExplosiveMatch, match="1201 rows of 41 and 32; the limit is 73 .most from X a: 1200"):
        match_codelist(data, study)
    with pytest.raises(ExplosiveMatch):
        match_codelist(data, study, max_rows=1200)
    assert check_exact(data.where("coding_system = 'X'"), study, 1200) == 1200
    for free in ({"max_rows": 1201}, {"guard": False}):
        assert match_codelist(data, study, **free).where("match_status = 'MATCHED'").count() == 1201
    assert check_exact(data.limit(0), study.limit(0)) == 0


def _match_by_hand(data, study, prefix=("ATC",)):
    """(status, system, data code, study code, concept) by loops."""
    pairs = []
    for d in data:
        hits = [(k, s) for k, s in enumerate(study) if d[0] == s[0] and (d[1] == s[1] if d[0] not in prefix else d[1] is not None and s[1] is not None and d[1].startswith(s[1]))]
        pairs += [(d, k, s) for k, s in hits]
    best = {}
    for d, k, s in pairs:
        if d[0] in prefix:
            key = (d[0], d[1], s[2])
            rank = (-len(s[1]), s[3] is not None, s[3] or 0, k, -d[2], d[3])
            best[key] = min(best.get(key, (rank, d, s)), (rank, d, s), key=lambda x: x[0])
    picked = [(d, s) for d, _, s in pairs if d[0] not in prefix] + [(d, s) for _, d, s in best.values()]
    out = [("MATCHED", d[0], d[1], s[1], s[2], d[3]) for d, s in picked]
    out += [("ONLY_IN_DATA", d[0], d[1], None, None, d[3]) for d in data if not any(d[:2] == e[:2] for e, _ in picked)]
    out += [("ONLY_IN_CODELIST", s[0], None, s[1], s[2], None) for s in study if not any(s[:2] == t[:2] for _, t in picked)]
    return sorted(out, key=repr)


def test_matching_equals_loops(spark):
    import random

    rng = random.Random(0)
    for _ in range(3):
        text = lambda n: None if rng.random() < 0.08 else "".join(rng.choice("ab") for _ in range(rng.randint(0, n)))
        system = lambda: rng.choice(["ATC", "ATC", "X", None])
        data = [(system(), text(4), rng.randint(1, 9), f"c{k}") for k in range(40)]
        study = [(system(), text(3), rng.choice("ij"), rng.choice([None, 1, 2])) for k in range(30)]
        found = match_codelist(
            spark.createDataFrame(data, f"{CODES}, COUNT int, source_column string"),
            spark.createDataFrame([(*s, k) for k, s in enumerate(study)], f"{CODES}, concept_id string, priority int, place int"), position="place", guard=False,
        )
        got = sorted(((r.match_status, r.coding_system, r["code.dap_codes"], r["code.codelist"], r.concept_id, r.source_column) for r in found.collect()), key=repr)
        assert got == _match_by_hand(data, study)
    empty = match_codelist(spark.createDataFrame([], f"{CODES}, COUNT int, source_column string"), spark.createDataFrame(study, f"{CODES}, concept_id string, priority int"))
    assert {r.match_status for r in empty.collect()} == {"ONLY_IN_CODELIST"}


def test_rows_of_a_data_code_do_not_gather(spark):
    """Windows stand over distinct codes of prefix systems only; equal codes are joined, however many rows they have."""
    from cdm_engine.operators.codelist import _paired

    columns = "coding_system string, code string, COUNT long, source_column string"
    data = spark.createDataFrame([("X", "a", k, "s") for k in range(20)] + [("ATC", "N02", 1, "x"), ("ATC", "N02", 3, "y"), ("ATC", "N02", 3, "w")], columns)
    study = spark.createDataFrame([(0, "X", "a", "c", "", 1), (1, "ATC", "N0", "p", "", 1)], "place int, coding_system string, code string, concept_id string, tags string, rank int")
    pairs = _paired(data, study, F.coalesce(F.col("coding_system").isin("ATC"), F.lit(False)))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window [") for line in plan.splitlines()) == 1
    assert pairs.where("picked AND coding_system = 'X'").count() == 20
    assert [(r.COUNT, r.source_column) for r in pairs.where("picked AND coding_system = 'ATC'").collect()] == [(3, "w")]
