from datetime import datetime as D

from pyspark.sql import functions as F

from recolta.config import EngineConfig
from recolta.streaming import pipelines as P

CAPTURE = "id string, url string, platform string, text_content string, author string, image_urls array<string>, captured_at timestamp, dwell_seconds double, capture_confidence double"


def write(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_twice(spark, tmp_path):
    src, out, bad, ck = (str(tmp_path / n) for n in ("src", "out", "bad", "ck"))
    row = lambda i, text, url="https://x.com/a/status/1": (i, url, None, text, "ann", [], D(2026, 1, 1, 10, 0), 1.0, None)
    write(spark, [row("1", "hello"), row("2", "hello"), row("3", "other"), row("4", "x", "u"), (None,) * 9], src, CAPTURE)
    schema = spark.read.parquet(src).schema
    P.ingest(P.read(spark, src, schema), out, bad, ck, EngineConfig()).awaitTermination()
    assert {r.id for r in spark.read.parquet(out).collect()} == {"1", "3"} and spark.read.parquet(bad).count() == 2
    write(spark, [row("5", "hello"), row("6", "new")], src, CAPTURE)
    P.ingest(P.read(spark, src, schema), out, bad, ck, EngineConfig()).awaitTermination()
    got = spark.read.parquet(out)
    assert {r.id for r in got.collect()} == {"1", "3", "6"} and {r.platform for r in got.collect()} == {"twitter"}


def test_windows_and_state_equal_batch(spark, tmp_path):
    src = str(tmp_path / "ev")
    schema = "event_id string, memory_id string, event_type string, amount double, created_at timestamp"
    rows = [(f"e{i:02d}", f"m{i % 3}", "reinforce" if i % 2 else "decay", 0.4, D(2026, 1, 1, i % 5, i)) for i in range(30)]
    write(spark, rows, src, schema)
    stream = P.read(spark, src, spark.read.parquet(src).schema)
    q = P.lifecycle_state(stream).writeStream.format("memory").queryName("life").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.memory_id: (r.reinforcement, r.events) for r in spark.table("life").collect()}
    assert got == {f"m{m}": (round(sum(0.4 for i in range(m, 30, 3) if i % 2), 6), 10) for m in range(3)}
    q = P.tumbling(stream, "created_at", ["memory_id"]).writeStream.format("memory").queryName("tumble").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = P.tumbling(spark.createDataFrame(rows, schema), "created_at", ["memory_id"])
    assert {tuple(r) for r in spark.table("tumble").collect()} == {tuple(r) for r in batch.collect()}


def test_retry_split(spark):
    df = spark.createDataFrame([("i", "q", 1, "e" * 2000, D(2026, 1, 1)), ("j", "q", 4, "e" * 2000, D(2026, 1, 1))], "item_id string, queue string, attempt int, error string, failed_at timestamp")
    retry, dead = P.retried(df, EngineConfig())
    assert [(r.item_id, r.attempt) for r in retry.collect()] == [("i", 2)] and [len(r.error) for r in dead.collect()] == [1000]
    assert retry.select((F.unix_micros("next_at") - F.unix_micros("failed_at")).alias("d")).first().d == 800_000
