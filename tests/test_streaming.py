from lexiquarry.streaming import history

FOLDER = "/root/testdata/sf0.001"


def test_history_stream(spark, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    history.keep_history(history.lookups(stream, "9999 days"), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
    rows = history.newest(spark, str(tmp_path / "table")).orderBy("pos").collect()
    last = {r.event_type: r.t for r in events.groupBy("event_type").agg({"ts": "max"}).withColumnRenamed("max(ts)", "t").collect()}
    assert [r.word for r in rows] == sorted(last, key=last.get, reverse=True)
