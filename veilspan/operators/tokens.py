"""The token store: an append-only Parquet table of (original, token, pii_type, key_epoch), read by joins in both directions.

One writer at a time (a job, or a stream's micro-batch) appends values that the store lacks; ``compact`` rewrites it into
few files behind a pointer file, so that readers see either the old or the new version. A writer holds a lease, a file
that only one can create; others wait for it, and take it over once it is older than ``LEASE_SECONDS``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.spans import dedup_by_start, text_of
from veilspan.operators.anonymize import Keys, Policy, anonymize_by_policy, token

#: A lease that is older was left behind by a writer that died; and how long a writer waits for one.
LEASE_SECONDS, WAIT_SECONDS = 3600.0, 7200.0
STORE_SCHEMA = "original string, token string, pii_type string, key_epoch string"


def first_seen(lines: DataFrame, spans: Column, policy: Policy = Policy(), order: str = "line_id", text: str = "log") -> DataFrame:
    """original and pii_type of each value to be tokenized: the type of its first occurrence, by line and, within a line,
    from the right (the order in which tokens are issued)."""
    found = lines.select(F.col(order).alias("nth"), F.col(text).alias("text"), F.explode(dedup_by_start(spans)).alias("s")).where(F.col("s.type").isin(*policy.tokenize))
    values = found.select("nth", F.col("s.start").alias("start"), F.col("s.type").alias("type"), text_of(F.col("text"), F.col("s")).alias("original"))
    return values.groupBy("original").agg(F.min_by("type", F.struct("nth", -F.col("start"))).alias("pii_type"))


def minted(values: DataFrame, keys: Keys, store: DataFrame | None = None) -> DataFrame:
    """Store rows for the values that the store lacks; known values keep the token they have, whatever key is current."""
    new = values if store is None else values.join(store.select("original"), "original", "left_anti")
    return new.select("original", token(F.col("original"), F.col("pii_type"), keys.token).alias("token"), "pii_type", F.lit(keys.epoch).alias("key_epoch"))


def resolve(tokens: DataFrame, store: DataFrame) -> DataFrame:
    """``tokens`` (token, ...) with the original, null for unknown ones."""
    return tokens.join(store.select("token", "original"), "token", "left")


def anonymize_with_store(lines: DataFrame, spans: Column, keys: Keys, store: DataFrame, policy: Policy = Policy(), line_id: str = "line_id", text: str = "log") -> DataFrame:
    """line_id and anonymized text, where tokens are those that the store holds."""
    spanned = lines.select(F.col(line_id).alias("line_id"), F.col(text).alias("text"), dedup_by_start(spans).alias("spans"))
    values = spanned.select("line_id", F.explode(F.array_distinct(F.transform(F.filter("spans", lambda s: s["type"].isin(*policy.tokenize)), lambda s: text_of(F.col("text"), s)))).alias("original"))
    issued = values.join(store.select("original", "token"), "original").groupBy("line_id").agg(F.map_from_entries(F.collect_list(F.struct("original", "token"))).alias("tokens"))
    return spanned.join(issued, "line_id", "left").select("line_id", anonymize_by_policy(F.col("text"), F.col("spans"), keys, policy, F.coalesce("tokens", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("anonymized"))


def detokenize(lines: DataFrame, store: DataFrame, line_id: str = "line_id", text: str = "anonymized", keep: bool = False) -> DataFrame:
    """line_id and restored text (with ``keep`` the given one too): every token that the store knows is replaced anywhere in the text. Tokens are found by
    their form and joined with the store, so that no line meets the whole store."""
    ids = lines.select(F.col(line_id).alias("line_id"), F.col(text).alias("text"))
    found = ids.select("line_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(P.ISSUED_TOKEN), F.lit(0)))).alias("token"))
    known = found.join(store.select("token", "original"), "token").groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("token", "original"))).alias("known"))
    restored = F.aggregate(F.coalesce("known", F.array().cast("array<struct<token:string,original:string>>")), F.col("text"), lambda t, k: F.replace(t, k["token"], k["original"]))
    return ids.join(known, "line_id", "left").select("line_id", *([F.col("text").alias(text)] if keep else []), restored.alias("restored"))


class TokenStore:
    """A store at a path of a file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(self.path)
        return hadoop, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> str:
        hadoop, fs = self._files()
        names = sorted(s.getPath().getName() for s in (fs.listStatus(hadoop.Path(self.path)) if fs.exists(hadoop.Path(self.path)) else []) if s.getPath().getName().startswith("current-"))
        return names[-1].removeprefix("current-") if names else "00000000-base"

    def read(self) -> DataFrame:
        hadoop, fs = self._files()
        place = f"{self.path}/{self._version()}"
        if not fs.exists(hadoop.Path(place)):
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self.spark.read.schema(STORE_SCHEMA).parquet(place)

    def _take(self, fs, place) -> bool:
        """Creates the file; false if it was there. Both ways are atomic."""
        if place.toUri().getScheme() in (None, "file"):
            return self.spark._jvm.java.io.File(place.toUri().getPath()).createNewFile()
        try:
            fs.create(place, False).close()
        except Py4JJavaError:
            if fs.exists(place):
                return False
            raise
        return True

    @contextmanager
    def _lease(self) -> Iterator[None]:
        hadoop, fs = self._files()
        place, until = hadoop.Path(f"{self.path}/_writing"), time.time() + WAIT_SECONDS
        fs.mkdirs(place.getParent())
        while not self._take(fs, place):
            held = list(fs.globStatus(place) or [])  # empty if it has been given back by now
            if held and time.time() - held[0].getModificationTime() / 1000 > LEASE_SECONDS:
                fs.delete(place, False)
            elif time.time() > until:
                raise TimeoutError(f"another writer holds {place.toString()}")
            elif held:
                time.sleep(0.1)
        try:
            yield
        finally:
            fs.delete(place, False)

    def append(self, values: DataFrame, keys: Keys) -> DataFrame:
        """Adds tokens for new values, and gives the store as it is then. Commit this before output that holds the tokens."""
        with self._lease():
            minted(values, keys, self.read()).write.mode("append").parquet(f"{self.path}/{self._version()}")
        return self.read()

    def compact(self, files: int = 1) -> None:
        """Rewrites the store into few files, and only then points to them."""
        with self._lease():
            number = int(self._version().partition("-")[0]) + 1
            version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
            self.read().dropDuplicates(["original"]).coalesce(files).write.parquet(f"{self.path}/{version}")
            hadoop, fs = self._files()
            fs.create(hadoop.Path(f"{self.path}/current-{version}"), False).close()
