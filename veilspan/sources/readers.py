"""Sources and sinks: JSON lines, raw log files, name-frequency archives, trims of real data, and routed tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import patterns as P

ENTRY_SCHEMA = "log string, log_type string, pii array<struct<start:int,end:int,type:string>>"
PROCESSED_SCHEMA = "log_type string, original string, anonymized string, detector_span_count int"
AUDIT_SCHEMA = "field_type string, method string, policy_version string, original_value_fingerprint string, timestamp bigint, authentication_tag string"
EVENT_SCHEMA = "message string, log_type string"


#: Below so many bytes for each core, and with fewer files than cores, a table may be a few row groups only.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it is small. Work on texts is bound by processors, and a small table of one file is one
    row group, which a single task reads; large tables, or those of many files, are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SPREAD_BYTES * cores and len(df.inputFiles()) < cores else df


def read_entries(spark: SparkSession, path: str, limit: int | None = None, schema: str = ENTRY_SCHEMA) -> DataFrame:
    """Labelled or plain log entries, one JSON object per line; a broken line fails the read. No limit for 0 or None."""
    entries = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return entries.limit(limit) if limit else entries


def log_type_of(path: Column) -> Column:
    """By the file's name; the first that fits."""
    return F.when(path.rlike("windows_events"), "windows_event").when(path.rlike("syslog"), "syslog").when(path.rlike("cloudtrail"), "cloudtrail")


def read_raw_logs(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """log, log_type, file of raw text files, in batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.text(path)
    return lines.select(F.col("value").alias("log"), log_type_of(F.col("_metadata.file_path")).alias("log_type"), F.col("_metadata.file_path").alias("file"))


def write_entries(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def split_by_type(entries: DataFrame, path: str | None = None) -> DataFrame:
    """The text of each known log type; with a path, written as text in a folder for each type. Unknown types are left out."""
    known = entries.where(F.col("log_type").isin(*P.LOG_TYPES)).select("log_type", F.col("log").alias("value"))
    if path:
        known.write.partitionBy("log_type").text(path)
    return known


def routed(processed: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of the three sinks with their index: anonymized and quarantined lines by UTC day, audit events by UTC month.

    Takes line_id, ts, log_type, anonymized, detector_span_count, audit_events, quarantine_reason and log; a row with a
    reason goes to quarantine with its original text, and to no other sink.
    """
    day, month = F.date_format(ts, "yyyy.MM.dd"), F.date_format(ts, "yyyy.MM")
    bad = F.col("quarantine_reason").isNotNull()
    line = F.struct(
        F.when(bad, "quarantine").otherwise("anonymized").alias("sink"), day.alias("suffix"), F.col("line_id").cast("string").alias("doc_id"),
        F.when(bad, F.col("log")).otherwise(F.col("anonymized")).alias("message"),
    )
    events = F.transform(
        F.when(~bad, F.col("audit_events")),
        lambda e, i: F.struct(F.lit("audit").alias("sink"), month.alias("suffix"), F.concat(F.col("line_id").cast("string"), F.lit("-audit-"), i.cast("string")).alias("doc_id"), F.to_json(e).alias("message")),
    )
    return processed.select("log_type", F.inline(F.concat(F.array(line), F.coalesce(events, F.array().cast("array<struct<sink:string,suffix:string,doc_id:string,message:string>>")))))


BATCH = "_batch"


def append(rows: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of routed rows to the table at ``path``, in a folder of its own: nothing that is there is read or rewritten,
    and a batch that is repeated replaces itself."""
    rows.write.mode("overwrite").partitionBy("sink", "suffix").parquet(f"{path.rstrip('/')}/{BATCH}={batch}")


def read_routed(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The table that ``append`` writes, with one row for each id: that of its last batch. Filters on sink and suffix prune
    folders before anything is compared."""
    rows = spark.read.option("basePath", path).option("pathGlobFilter", "*.parquet").parquet(f"{path.rstrip('/')}/{BATCH}=*")
    others = [c for c in rows.columns if c not in ("sink", "suffix", key, BATCH)]
    last = F.max_by(F.struct(*others), BATCH).alias("last")
    return rows.groupBy("sink", "suffix", key).agg(last).select("sink", "suffix", key, "last.*")


def trimmed_cloudtrail(raw: DataFrame, line: str = "value", longest: int = 300) -> DataFrame:
    """Real events cut down to the fields that matter; requestParameters stay if they are an object of short JSON text."""
    top = ("eventTime", "eventName", "eventSource", "awsRegion", "sourceIPAddress", "userAgent", "errorCode", "errorMessage")
    user = ("type", "principalId", "arn", "accountId", "userName")
    get = lambda path: F.get_json_object(F.col(line), f"$.{path}")
    parameters = get("requestParameters")
    kept = F.when(parameters.startswith("{") & (F.length(parameters) < longest), parameters)
    return raw.select(*[get(k).alias(k) for k in top], F.struct(*[get(f"userIdentity.{k}").alias(k) for k in user]).alias("userIdentity"), kept.alias("requestParameters"))


def _members(spark: SparkSession, path: str) -> DataFrame:
    """file and text line of every member of zip archives: each archive is opened in one task."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        text = archive.read(name).decode("utf-8", "replace").splitlines()
                        yield pd.DataFrame({"file": [name] * len(text), "line": text})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "file string, line string")


def read_census_names(spark: SparkSession, path: str) -> DataFrame:
    """name and count of surname tables (name first, count third) in zip archives; the remainder row and bad numbers go."""
    parts = F.split("line", ",")
    rows = _members(spark, path).where(F.col("file").endswith(".csv")).select(F.lower(F.trim(F.get(parts, F.lit(0)))).alias("name"), F.expr("try_cast(get(split(line, ','), 2) as bigint)").alias("count"))
    return rows.where("name <> 'all other names' and count is not null").groupBy("name").agg(F.sum("count").alias("count"))


def read_given_names(spark: SparkSession, path: str, years: tuple[int, ...] | None = None) -> DataFrame:
    """name and count of yearly tables (name, sex, count) in zip archives."""
    parts = F.split("line", ",")
    rows = _members(spark, path).withColumn("year", F.expr(r"try_cast(regexp_extract(file, r'yob(\d{4})\.txt$', 1) as int)")).where("year is not null")
    rows = rows.where(F.col("year").isin(*years)) if years else rows
    return rows.select(F.lower(F.get(parts, F.lit(0))).alias("name"), F.expr("try_cast(get(split(line, ','), 2) as bigint)").alias("count")).where("count is not null").groupBy("name").agg(F.sum("count").alias("count"))


def requests(df: DataFrame, body: str = "body", key: str | None = None, expected_key: str | None = None) -> DataFrame:
    """Requests to anonymize as rows: log, log_type and an error where the body is no JSON object, where ``log`` is missing
    or no text, or where ``log_type`` is there and no text. With ``key``, the column of the callers' keys, every request whose
    key is not the expected one is refused before its body is looked at; the plan holds the expected key's digest alone."""
    parsed = F.try_parse_json(F.col(body))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_veil_body", f"$.{k}", "variant"))
    rows = df.withColumn("_veil_body", parsed)
    error = (
        F.when(F.col("_veil_body").isNull() | ~F.schema_of_variant("_veil_body").startswith("OBJECT"), "invalid json")
        .when(F.coalesce(kind("log") != "STRING", F.lit(True)), "log must be text")
        .when(~F.coalesce(kind("log_type"), F.lit("VOID")).isin("STRING", "VOID"), "log_type must be text")
    )
    value = lambda k: F.try_variant_get("_veil_body", f"$.{k}", "string")
    columns = {"log": value("log"), "log_type": value("log_type"), "error": error}
    if key is not None:
        if not expected_key:
            raise ValueError("an empty key lets everyone in")
        known = F.coalesce(F.sha2(F.col(key).cast("binary"), 256) == hashlib.sha256(expected_key.encode()).hexdigest(), F.lit(False))
        columns = {n: F.when(known, c) for n, c in columns.items()} | {"error": F.when(~known, "unauthorized").otherwise(error)}
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != key], *[c.alias(n) for n, c in columns.items()])
