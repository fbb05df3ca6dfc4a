from pyspark.sql import functions as F

from basketry.streaming.supports import current_supports, maintain_supports, windowed_supports


def test_supports_over_batches(spark, tmp_path):
    schema = "tid long, item string"
    source = str(tmp_path / "in")
    for rows in ([(1, "a"), (1, "b"), (1, "a")], [(2, "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        maintain_supports(spark.readStream.schema(schema).json(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {tuple(r) for r in current_supports(spark, str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}


def test_windows_drop_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:01:00"), (1, "a", "2024-01-01 00:02:00"), (2, "a", "2024-01-01 00:11:00")], "tid long, item string, at string")
    rows.withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tid long, item string, at timestamp").parquet(str(tmp_path / "in"))
    found = windowed_supports(stream, "at")
    job = found.writeStream.format("memory").queryName("seen").outputMode("update").trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(r["support"] for r in spark.table("seen").collect()) == [1, 1]
