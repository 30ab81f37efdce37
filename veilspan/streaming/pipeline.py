"""The same logic on streams: events in, anonymized lines, audit events and quarantine out, by idempotent micro-batches.

A micro-batch commits new tokens before any output that holds them, then writes its rows to a folder of its own, which a
repeated batch replaces. A broken event goes to quarantine with its original text; none is dropped, and equal events are
events of their own.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspan.functions.spans import dedup_by_start, text_of
from veilspan.operators import detect, drift
from veilspan.operators.anonymize import Keys, Policy, audit_event
from veilspan.operators.detect import without_entropy
from veilspan.operators.tokens import TokenStore, anonymize_with_store, first_seen
from veilspan.sources.readers import EVENT_SCHEMA, append, routed
from veilspan.streaming.metrics import ServiceMetrics


def kafka_events(spark: SparkSession, servers: str, topic: str, per_trigger: int = 10_000) -> DataFrame:
    """value, ts and doc_id (topic-partition-offset) of a topic, from its beginning; offsets live in the checkpoint."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    stream = stream.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    return stream.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"), F.concat_ws("-", "topic", "partition", "offset").alias("doc_id"))


def to_kafka(rows: DataFrame, servers: str, topic: str, checkpoint: str | None = None, key: str = "doc_id"):
    """Rows as JSON to a topic, acknowledged by all replicas; a stream is started, a table is written."""
    out = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}
    if rows.isStreaming:
        return out.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return out.write.format("kafka").options(**options).save()


def file_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """value, ts and file of JSON lines that land in a folder. Lines have no ids: ``numbered`` gives them."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return stream.select("value", F.col("_metadata.file_modification_time").alias("ts"), F.col("_metadata.file_path").alias("file"))


def queue_events(spark: SparkSession, key: str, factory: str, most: int = 100_000) -> DataFrame:
    """value, ts (when it is read) and doc_id of a list queue."""
    from veilspan.sources.queues import ListQueue

    spark.dataSource.register(ListQueue)
    stream = spark.readStream.format("list_queue").options(key=key, factory=factory, most=most).load()
    return stream.select("value", F.current_timestamp().alias("ts"), "doc_id")


#: Equal lines of a file are numbered in steps of so many, so that no array holds them all.
NUMBERED = 10_000


def numbered(events: DataFrame) -> DataFrame:
    """doc_id (hash of file, text and number), ts and value of file events: the n equal lines of a file are numbered 1 to n.

    A file is read in one micro-batch, and its equal lines can't be told apart, so the ids are the same however the file is
    split and however often the batch is repeated. Equal lines are counted before the shuffle: many of them are one row.
    """
    counts = events.groupBy("file", "value", "ts").agg(F.count("*").alias("n"))
    steps = counts.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(NUMBERED))))
    each = steps.withColumn("number", F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + NUMBERED - 1))))
    return each.select(F.md5(F.concat_ws("\n", "file", F.col("number").cast("string"), "value")).alias("doc_id"), "ts", "value")


def parsed(events: DataFrame) -> DataFrame:
    """doc_id, ts, log, log_type and quarantine_reason of each event; events with an empty message are no work and go."""
    if "doc_id" not in events.columns:
        events = numbered(events)
    rows = events.select("doc_id", "ts", "value", F.from_json("value", EVENT_SCHEMA).alias("e"))
    reason = F.when(F.col("e").isNull() | (F.col("e.message").isNull() & F.col("e.log_type").isNull()), "unparseable event").when(F.col("e.message").isNull(), "message must be text")
    rows = rows.select("doc_id", "ts", F.when(reason.isNotNull(), F.col("value")).otherwise(F.col("e.message")).alias("log"), F.col("e.log_type").alias("log_type"), reason.alias("quarantine_reason"))
    return rows.where(F.col("quarantine_reason").isNotNull() | (F.col("log") != ""))


def process_batch(
    rows: DataFrame, keys: Keys, store: TokenStore, out: str, batch: int, timestamp: Column, policy: Policy = Policy(), spans: Callable[[Column], Column] | None = None, metrics: ServiceMetrics | None = None
) -> None:
    """One micro-batch of ``parsed`` rows: tokens first, then the rows of the three sinks. Texts are searched once."""
    found = spans or (lambda text: F.concat(detect.scan_regex(text), detect.scan_flattened_names(text)))
    begin = time.perf_counter()
    lines = rows.withColumnRenamed("doc_id", "line_id").dropDuplicates(["line_id"])
    lines = lines.withColumn("spans", F.when(F.col("quarantine_reason").isNull(), dedup_by_start(without_entropy(found(F.col("log")))))).persist()
    good = lines.where("quarantine_reason is null")
    tokens = store.append(first_seen(good, F.col("spans"), policy), keys)
    saved = time.perf_counter()
    done = anonymize_with_store(good, F.col("spans"), keys, tokens, policy)
    events = F.transform("spans", lambda s: audit_event(s["type"], text_of(F.col("log"), s), keys, timestamp, policy))
    append(routed(lines.select("*", F.size("spans").alias("detector_span_count"), events.alias("audit_events")).join(done, "line_id", "left")), out, batch)
    if metrics:
        # the batch is cached and its detections have a row for each type
        counts = dict(good.select(F.explode("spans").alias("s")).groupBy("s.type").count().collect())
        sides = lines.agg(F.count("*").alias("lines"), F.count("quarantine_reason").alias("bad")).first()
        metrics.record(lines=sides["lines"], quarantined=sides["bad"], detections=counts, seconds=time.perf_counter() - begin, save_seconds=saved - begin, store_size=tokens.count())
    lines.unpersist()


def start(
    events: DataFrame, keys: Keys, store_path: str, out: str, checkpoint: str, policy: Policy = Policy(), available_now: bool = False, metrics: ServiceMetrics | None = None
) -> StreamingQuery:
    """Starts the stream: at least once by the checkpoint, and once in effect by batch folders and ids."""
    spark = events.sparkSession
    store = TokenStore(spark, store_path)

    def batch(rows: DataFrame, number: int) -> None:
        process_batch(parsed(rows), keys, store, out, number, F.unix_timestamp(F.current_timestamp()), policy, metrics=metrics)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_field_stats(lines: DataFrame, over: str = "7 days", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Drift's field statistics for each window of event time; lines later than the watermark are left out."""
    from veilspan.functions.fields import extract_fields

    values = lines.withWatermark(ts, late).select(ts, "log_type", F.inline(extract_fields(F.col("log_type"), F.col("log"))))
    hit = F.when(drift.is_critical(F.col("value")), 1).otherwise(0)
    sums = values.groupBy(F.window(ts, over).alias("window"), "log_type", "field").agg(F.count("*").alias("total"), F.sum(hit).alias("critical_hits"))
    return sums.select("window.start", "log_type", "field", "total", "critical_hits")
