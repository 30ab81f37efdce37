"""What a running service tells of itself: counters, gauges and latency histograms, in the text format that scrapers read.

A stream records one entry for each micro-batch; ``observed`` gives the same counts for any batch job through Spark's own
observations, without another pass over the data.
"""

from __future__ import annotations

from bisect import bisect_left
from threading import Lock

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilspan.functions import patterns as P

#: Upper bounds, in seconds, of the histograms' buckets.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0)
TYPES = (*P.REGEX_PATTERNS, "PERSON")


class Histogram:
    def __init__(self, bounds: tuple[float, ...] = BUCKETS):
        self.bounds, self.counts, self.sum = bounds, [0] * (len(bounds) + 1), 0.0

    def observe(self, seconds: float) -> None:
        self.counts[bisect_left(self.bounds, seconds)] += 1
        self.sum += seconds

    def lines(self, name: str) -> list[str]:
        """Counts up to each bound, as scrapers expect them."""
        upto, out = 0, []
        for bound, n in zip([*map(str, self.bounds), "+Inf"], self.counts, strict=True):
            upto += n
            out.append(f'{name}_bucket{{le="{bound}"}} {upto}')
        return [*out, f"{name}_sum {self.sum:g}", f"{name}_count {upto}"]


class ServiceMetrics:
    """Counters since the start of the process. Recording and rendering may happen in different threads."""

    def __init__(self, prefix: str = "veilspan"):
        self.prefix, self.lock = prefix, Lock()
        self.lines, self.quarantined, self.store_size = 0, 0, 0
        self.detections: dict[str, int] = {}
        self.saves = {"persisted": 0, "skipped": 0}
        self.batch_seconds, self.save_seconds = Histogram(), Histogram()

    def record(self, lines: int, quarantined: int, detections: dict[str, int], seconds: float, save_seconds: float, store_size: int) -> None:
        """A micro-batch. A save that left the store as large as it was had nothing to keep."""
        with self.lock:
            self.lines += lines
            self.quarantined += quarantined
            for kind, n in detections.items():
                self.detections[kind] = self.detections.get(kind, 0) + n
            self.saves["persisted" if store_size > self.store_size else "skipped"] += 1
            self.store_size = store_size
            self.batch_seconds.observe(seconds)
            self.save_seconds.observe(save_seconds)

    def render(self) -> str:
        p = self.prefix
        with self.lock:
            out = [f"{p}_lines_total {self.lines}", f"{p}_quarantined_total {self.quarantined}", f"{p}_token_store_size {self.store_size}"]
            out += [f'{p}_detections_total{{type="{kind}"}} {n}' for kind, n in sorted(self.detections.items())]
            out += [f'{p}_store_save_total{{outcome="{outcome}"}} {n}' for outcome, n in self.saves.items()]
            return "\n".join([*out, *self.batch_seconds.lines(f"{p}_batch_seconds"), *self.save_seconds.lines(f"{p}_store_save_seconds")]) + "\n"


def observed(processed: DataFrame, name: str = "anonymization") -> tuple[DataFrame, Observation]:
    """``processed`` (``anonymize.process_lines``) and an observation of it, which holds lines, spans, lines_with_spans and the
    number of spans of each known type once the rows have been written or counted."""
    observation = Observation(name)
    of_kind = lambda kind: F.filter("audit_events", lambda e: e["field_type"] == kind)
    kinds = [F.sum(F.size(of_kind(kind))).alias(kind) for kind in TYPES]
    counts = [F.count(F.lit(1)).alias("lines"), F.sum("detector_span_count").alias("spans"), F.count_if(F.col("detector_span_count") > 0).alias("lines_with_spans")]
    return processed.observe(observation, *counts, *kinds), observation
