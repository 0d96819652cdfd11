from pyspark.sql import functions as F

from cdm_engine import Rule
from cdm_engine.streaming import stream


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def source(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:0{k % 5}:00", "click" if k % 2 else "view", f"p{k % 3}") for k in range(10)]
    df = spark.createDataFrame(rows, "unique_id int, ts string, kind string, person_id string").withColumns({"ts": F.col("ts").cast("timestamp"), "ori_table": F.lit("E")})
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_stateless_and_stateful(spark, tmp_path):
    events = source(spark, tmp_path)
    found = drain(stream.concept_stream({"E": stream.complete_rows(events, ["person_id"])}, [Rule("c", "E", (("kind", "CLICK"),), "kind")]), "concepts")
    assert found.count() == 5 and {r.value for r in found.collect()} == {"click"}
    assert drain(stream.first_within(events, ["kind"], "ts", "10 minutes"), "firsts").count() == 2
    counts = drain(stream.windowed_inventory(events, ["kind"], "ts", "1 minute", "10 minutes"), "counts", "complete")
    assert {(r.kind, r.COUNT) for r in counts.collect()} == {("click", 5), ("view", 5)}


def test_matching_sink(spark, tmp_path):
    codes = spark.createDataFrame([("ATC", "N02", "pain")], "coding_system string, code string, concept_id string")
    got = []
    each = stream.matching_sink(codes, lambda df, n: got.extend(r.match_status for r in df.collect()))
    events = source(spark, tmp_path).select(F.lit("ATC").alias("coding_system"), F.lit("N02BE01").alias("code"), F.lit(1).alias("COUNT"), F.lit("kind").alias("source_column")).limit(1)
    q = events.writeStream.foreachBatch(each).start()
    q.processAllAvailable()
    q.stop()
    assert got == ["MATCHED"]
