from pyspark.sql import functions as F

from docloom.streaming import ingest as I


def test_files_become_chunks(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    text = " ".join(f"Sentence number {i} about zinc and copper salts." for i in range(5))
    (source / "a.md").write_text(text)
    (source / "b.md").write_text(text)  # the same content: dropped
    (source / "c.bin").write_bytes(b"\x00\x01" * 40)
    docs = I.stream_documents(I.stream_files(spark, str(source)))
    I.write_stream(docs, f"{tmp_path}/docs", f"{tmp_path}/cp1", available_now=True).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/docs").collect()
    assert len(got) == 2 and sum(r.error is None for r in got) == 1
    again = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/docs").schema).parquet(f"{tmp_path}/docs")
    I.write_stream(I.stream_chunks(again, 30, 10), f"{tmp_path}/chunks", f"{tmp_path}/cp2", available_now=True).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/chunks").filter(F.col("text").contains("number 4")).count() >= 1


def test_event_windows_drop_late_events(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    first = spark.createDataFrame([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 03:00:00", "a", 2.0)], "t string, event_type string, value double")
    late = spark.createDataFrame([("2024-01-01 00:06:00", "a", 5.0), ("2024-01-01 03:01:00", "a", 3.0), ("2024-01-01 05:00:00", "b", 1.0)], "t string, event_type string, value double")
    for k, df in enumerate((first, late)):
        df.select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    import shutil

    for k in (0, 1):
        shutil.copytree(f"{tmp_path}/in{k}", f"{tmp_path}/events", dirs_exist_ok=True)
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
        I.write_stream(I.event_windows(events), out, cp, available_now=True).awaitTermination(120)
    got = {(r.start.hour, r.event_type): (r.n, r.value) for r in spark.read.parquet(out).collect()}
    assert got == {(0, "a"): (1, 1.0), (3, "a"): (2, 5.0)}
