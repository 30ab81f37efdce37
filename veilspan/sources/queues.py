"""A list queue (RPUSH at one end, LRANGE and LTRIM at the other) as a Python data source for streams, and as a sink.

Offsets are absolute numbers of events. A micro-batch plans ranges of them from the list's length alone; executors read
their ranges from the list themselves, and events leave the list only when their batch is committed. The number of events
that have left it is kept beside the list and changed in one transaction with it, so that after a restart the same offsets
name the same events: nothing is lost, and ``doc_id`` (key and offset) tells a repeated event. One stream reads a list.

The client is named by an importable factory ("module:function", or "module:function:argument"), so that any store with such
lists serves.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, doc_id string"
FACTORY = "veilspan.sources.queues:redis_client"


def client(factory: str):
    module, name, *argument = factory.split(":", 2)
    return getattr(importlib.import_module(module), name)(*argument)


def redis_client(url: str = "redis://localhost:6379/0"):
    """The default factory, where the redis package is installed."""
    import redis

    return redis.Redis.from_url(url)


class ListQueue(DataSource):
    """Options: key, factory, most (events taken in a micro-batch), slices (tasks that read them)."""

    @classmethod
    def name(cls) -> str:
        return "list_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListQueueReader(self.options)


class Slice(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class ListQueueReader(DataSourceStreamReader):
    def __init__(self, options):
        self.key, self.most, self.slices = options["key"], int(options.get("most", "100000")), int(options.get("slices", "8"))
        self.factory = options.get("factory", FACTORY)
        self.planned = None

    def _gone(self, to) -> int:
        return int(to.get(f"{self.key}:gone") or 0)

    def initialOffset(self) -> dict:
        return {"event": self._gone(client(self.factory))}

    def latestOffset(self) -> dict:
        to = client(self.factory)
        gone = self._gone(to)
        begin = gone if self.planned is None else max(gone, self.planned)
        self.planned = min(gone + int(to.llen(self.key)), begin + self.most)
        return {"event": self.planned}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.planned = end["event"]
        step = max(1, -(-(end["event"] - start["event"]) // self.slices))
        return [Slice(at, min(at + step, end["event"])) for at in range(start["event"], end["event"], step)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        to = client(self.factory)
        gone = self._gone(to)
        if gone > partition.begin:
            raise RuntimeError(f"events {partition.begin} to {gone} have left the list {self.key} already: does another stream read it?")
        for at, value in enumerate(to.lrange(self.key, partition.begin - gone, partition.end - gone - 1), partition.begin):
            yield value.decode() if isinstance(value, bytes) else value, f"{self.key}-{at}"

    def commit(self, end: dict) -> None:
        to = client(self.factory)
        done = end["event"] - self._gone(to)
        if done > 0:
            both = to.pipeline(transaction=True)
            both.ltrim(self.key, done, -1)
            both.incrby(f"{self.key}:gone", done)
            both.execute()


def push(rows: DataFrame, key: str, factory: str = FACTORY) -> None:
    """Appends each row as JSON to the list, one connection a partition."""

    def send(part) -> None:
        to = client(factory)
        for row in part:
            to.rpush(key, json.dumps(row.asDict(recursive=True), default=str))

    rows.foreachPartition(send)
