from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemill.operators import events, records
from tidemill.streaming import monitor

T0 = datetime(2024, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=7 * i), i, f"d{i % 3}", f"u{i}") for i in range(60)]
    f = "ts timestamp, seq bigint, domain string, url string"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], f).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(f).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = monitor.circuit_counts(stream, late="1 day").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.failure_counts(spark.createDataFrame(rows, f))
    key = lambda df: sorted((r["seq"], r["count"], r["tripped"]) for r in df.collect())
    assert key(spark.table("counted")) == key(want)


def test_windows(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=30 * i), i % 4 != 0) for i in range(40)]
    spark.createDataFrame(rows, "ts timestamp, success boolean").write.parquet(str(tmp_path / "in"))
    q = monitor.success_windows(spark.readStream.schema("ts timestamp, success boolean").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.success_windows(spark.createDataFrame(rows, "ts timestamp, success boolean"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_worker(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a good text"), (2, ""), (3, "a bad text")], "id bigint, text string")
    made = records.new_records(docs, F.col("id").cast("string"), F.col("id"), F.col("text"), F.lit(1))
    made.write.parquet(str(tmp_path / "records"))
    held = {"now": spark.createDataFrame(made.collect(), made.schema)}
    save = lambda df: held.update(now=spark.createDataFrame(df.collect(), df.schema))
    q = monitor.enrichment_worker(spark.readStream.schema(made.schema).parquet(str(tmp_path / "records")), lambda: held["now"], save, str(tmp_path / "c"), once=True)
    q.awaitTermination(120)
    got = {r["content_hash"]: r["sentiment_score"] for r in held["now"].collect()}
    assert got == {1: 1.0, 2: None, 3: -1.0}
