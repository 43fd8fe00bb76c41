"""Structured Streaming: ingest, event-time deduplication, windows, lifecycle state, retries and dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from recolta.config import EngineConfig
from recolta.functions import classify as C, scores as S, text as T, urls as U
from recolta.operators.lifecycle import STATE_OF


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16, fmt: str = "parquet") -> DataFrame:
    """A bounded-rate file stream: back-pressure instead of a queue that drops."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def normalized(captures: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Captures with platform, canonical address, flags, confidence and fingerprint. Pure columns, batch or stream."""
    url = T.text_or_empty(F.col("url"))
    out = captures.withColumn("platform", U.detect_platform(F.col("url"), F.col("platform"))).withColumn("text_content", T.normalize_text(F.col("text_content")))
    out = out.withColumn("canonical_url", U.canonical_url(url, F.col("platform"))).withColumn("post_id", U.post_id(url, F.col("platform")))
    flags = F.array_compact(F.array(F.when(F.col("text_content") == "", F.lit("missing_text")), F.when(F.trim(T.text_or_empty("author")) == "", F.lit("missing_author")), F.when(F.coalesce(F.size("image_urls"), F.lit(0)) <= 0, F.lit("missing_media"))))
    out = out.withColumn("quality_flags", flags)
    score, reasons = S.capture_confidence(F.col("text_content"), F.col("canonical_url"), F.col("author"), F.col("image_urls"), F.col("post_id"), F.col("quality_flags"), F.array().cast("array<string>"), U.valid_url(F.col("canonical_url")))
    hours = F.lit(cfg.dedupe_hours)
    for name, h in cfg.platform_dedupe_hours.items():
        hours = F.when(F.col("platform") == name, h).otherwise(hours)
    key = C.fingerprint(F.col("canonical_url"), F.col("platform"), F.col("text_content"), F.col("author"), C.time_bucket(F.col("captured_at"), hours))
    return out.withColumn("capture_confidence", score).withColumn("confidence_reasons", reasons).withColumn("dedupe_key", key)


def valid(captures: DataFrame) -> F.Column:
    """Bounds of a capture request; what fails is quarantined."""
    return F.coalesce(F.length("url").between(3, 2000) & F.coalesce(F.col("dwell_seconds").between(0, 3600), F.lit(True)) & F.coalesce(F.col("capture_confidence").between(0, 1), F.lit(True)), F.lit(False))


def deduplicated(stream: DataFrame, time: str = "captured_at", lateness: str = "2 hours") -> DataFrame:
    """The first row of each fingerprint while the watermark remembers it; exactness beyond is the sink's anti join."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["dedupe_key"])


def tumbling(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("window_start"), *by, "rows")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Dwell sessions: runs of a key's events with gaps below `gap`."""
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("rows")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "rows")


def lifecycle_state(stream: DataFrame) -> DataFrame:
    """(memory_id, state, reinforcement, events): running state of each memory, updated with each micro-batch.
    Needs memory_id, event_type, amount, created_at, event_id. Within a batch events apply in order of time."""
    schema = "memory_id string, state string, reinforcement double, events long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, value, n = state.get if state.exists else (None, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["created_at", "event_id"])
        for kind, amount in zip(rows["event_type"], rows["amount"]):
            if kind == "reinforce":
                value = min(10.0, max(0.0, value + min(1.0, max(-1.0, 0.1 if pd.isna(amount) else amount))))
            name = STATE_OF.get(kind, name)
            n += 1
        state.update((name, value, n))
        yield pd.DataFrame({"memory_id": [key[0]], "state": [name], "reinforcement": [round(value, 6)], "events": [n]})

    return stream.groupBy("memory_id").applyInPandasWithState(step, schema, "name string, value double, n long", "update", GroupStateTimeout.NoTimeout)


def retried(failed: DataFrame, cfg: EngineConfig, most: int = 4, base: float = 0.8, cap: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(to retry with next_at, dead letters) of failed work (item_id, queue, attempt, error, failed_at)."""
    again = F.col("attempt") < most
    retry = failed.filter(again).withColumn("next_at", F.timestamp_micros((F.unix_micros("failed_at") + S.backoff_seconds(F.col("attempt"), base, cap) * 1_000_000).cast("long"))).withColumn("attempt", F.col("attempt") + 1)
    dead = failed.filter(~again).withColumn("error", F.substring("error", 1, 1000)).withColumn("queue", F.substring("queue", 1, 120))
    return retry, dead


def stored(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches the pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def ingest(stream: DataFrame, target: str, quarantine: str, checkpoint: str, cfg: EngineConfig, write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Captures to a table of new fingerprints: valid rows are normalised, deduplicated in event time and
    appended once per batch; invalid ones go to quarantine. Replays of a batch overwrite their own folder."""
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter(~valid(batch)).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        good = normalized(batch.filter(valid(batch)), cfg)
        first = good.groupBy("dedupe_key").agg(F.min(F.struct("captured_at", "id")).alias("_v")).select("dedupe_key", F.col("_v.id").alias("id"))
        fresh = good.join(first, ["dedupe_key", "id"], "left_semi").dropDuplicates(["dedupe_key"])
        if stored(spark, f"{target}/batch=*"):
            # a replayed batch doesn't see its own first attempt; only the column of keys is read, and only keys of this batch are kept
            known = spark.read.schema("dedupe_key string, batch long").option("basePath", target).parquet(target).filter(F.col("batch") != number).select("dedupe_key")
            fresh = fresh.join(known, "dedupe_key", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if write:
            write(fresh, number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
