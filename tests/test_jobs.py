"""Tokens, audit, drift, sources and streams."""

import json
import os
import sqlite3
import threading
import types
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.operators import anonymize, detect, drift, evaluate, tokens
from veilspan.plans import weekly
from veilspan.sources import logs, queues, readers
from veilspan.streaming import metrics, pipeline

KEYS = anonymize.Keys("p", "t", "a", "f")


def test_token_type_is_first_seen_and_kept(spark, tmp_path):
    lines = spark.createDataFrame([(1, "x a@b.co MRN-1234567"), (2, "MRN-1234567 and c@d.org")], "line_id long, log string")
    spans = detect.scan_regex(F.col("log"))
    store = tokens.TokenStore(spark, str(tmp_path / "store"))
    assert store.append(tokens.first_seen(lines, spans), KEYS).count() == 3
    again = store.append(tokens.first_seen(lines, spans), anonymize.Keys("p", "other", "a", "f", "2"))
    assert again.count() == 3 and again.select("key_epoch").distinct().count() == 1
    store.compact()
    assert store.read().count() == 3
    out = tokens.anonymize_with_store(lines, spans, KEYS, store.read())
    back = {r["line_id"]: r["restored"] for r in tokens.detokenize(out, store.read()).collect()}
    assert back == {r["line_id"]: r["log"] for r in lines.collect()}


def test_policy_labels_and_unknown_types(spark):
    row = spark.range(1).select(
        anonymize.method_of(F.lit("OTHER")).alias("m"),
        anonymize.anonymize_by_policy(F.lit("abc"), F.array(F.struct(F.lit("OTHER").alias("type"), F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("m").alias("method"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("entropy"))), KEYS).alias("t"),
    ).first()
    assert (row["m"], row["t"]) == (P.MASK_METHOD, "abc")


def test_audit_event_matches_plain_python(spark):
    import hashlib
    import hmac

    e = spark.range(1).select(anonymize.audit_event(F.lit("IP"), F.lit("10.0.0.1"), KEYS, F.lit(5)).alias("e")).first()["e"].asDict()
    tag = e.pop("authentication_tag")
    assert tag == hmac.new(b"a", json.dumps(e, sort_keys=True).encode(), hashlib.sha256).hexdigest()


def stats(spark, total, hits):
    return spark.createDataFrame([("t", "f", total, hits)], "log_type string, field string, total long, critical_hits long")


def test_drift_gates(spark):
    assert drift.compare(stats(spark, 100, 5), stats(spark, 100, 6)).count() == 0
    assert drift.compare_all(stats(spark, 100, 5), stats(spark, 100, 6)).first()["flagged"] is False
    assert drift.compare(stats(spark, 100, 0), stats(spark, 100, 20)).count() == 1
    assert drift.insufficient(stats(spark, 3, 0), stats(spark, 3, 3)).count() == 1
    empty = stats(spark, 1, 1).limit(0)
    assert drift.insufficient(stats(spark, 50, 0), empty).first()["current_n"] == 0


def test_ip_is_no_critical_type(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("a@b.co",), ("johnsmith",), (None,)], "v string")
    assert [r[0] for r in df.select(F.coalesce(drift.is_critical(F.col("v")), F.lit(False))).collect()] == [False, True, True, False]


def test_weekly_job(spark, sf_dir, tmp_path):
    lines = logs.log_lines(spark, sf_dir)
    done = anonymize.process_lines(lines, detect.scan_regex(F.col("log")), KEYS, F.lit(1))
    (tmp_path / "token.key").write_text("old")
    sent = []
    out = weekly.run(done, lines.where("line_id < 500"), lines.where("line_id >= 500"), str(tmp_path), push=lambda m: sent.append(m.count()))
    found = done.where("detector_span_count > 0").count()
    assert out["sample"].count() == max(1, int(found * 0.05)) and sent and out["token_key"]["retired_key_path"] and out["pseudonym_key"]["retired_key_path"] is None
    assert out["summary"].first()["baseline_entries"] == 500


def test_sources(spark, tmp_path):
    path = str(tmp_path / "entries")
    rows = spark.createDataFrame([("a", "syslog", []), ("b", "other", [(0, 1, "IP")])], readers.ENTRY_SCHEMA)
    readers.write_entries(rows, path)
    assert readers.read_entries(spark, path, 0).count() == 2 and readers.read_entries(spark, path, 1).count() == 1
    assert [r["log_type"] for r in readers.split_by_type(rows).collect()] == ["syslog"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/syslog.log").write_text("x\ny\n")
    assert {r["log_type"] for r in readers.read_raw_logs(spark, str(tmp_path / "raw")).collect()} == {"syslog"}
    with zipfile.ZipFile(tmp_path / "names.zip", "w") as z:
        z.writestr("a.csv", "name,rank,count\nSMITH,1,10\nSmith,2,5\nALL OTHER NAMES,0,99\nX,3,bad\n")
        z.writestr("yob2001.txt", "Mary,F,7\nMary,M,1\n")
    assert {tuple(r) for r in readers.read_census_names(spark, str(tmp_path / "names.zip")).collect()} == {("smith", 15)}
    assert {tuple(r) for r in readers.read_given_names(spark, str(tmp_path / "names.zip")).collect()} == {("mary", 8)}


def test_requests_need_the_key(spark):
    good = '{"log": "a", "log_type": "syslog"}'
    rows = spark.createDataFrame([(1, good, "secret"), (2, good, "other"), (3, good, None), (4, "no json", "secret")], "i int, body string, api_key string")
    got = {r["i"]: (r["log"], r["error"]) for r in readers.requests(rows, key="api_key", expected_key="secret").collect()}
    assert got == {1: ("a", None), 2: (None, "unauthorized"), 3: (None, "unauthorized"), 4: (None, "invalid json")}
    assert "api_key" not in readers.requests(rows, key="api_key", expected_key="secret").columns
    with pytest.raises(ValueError):
        readers.requests(rows, key="api_key", expected_key="")


def test_weighted_sample(spark):
    names = spark.createDataFrame([("a", 900), ("b", 100), ("c", 0)], "name string, count long")
    got = evaluate.weighted_sample(names, 2000).groupBy("name").count().collect()
    counts = {r["name"]: r["count"] for r in got}
    assert sum(counts.values()) == 2000 and 120 < counts["b"] < 280 and "c" not in counts


def run_stream(spark, tmp_path, counted=None):
    query = pipeline.start(pipeline.file_events(spark, str(tmp_path / "in")), KEYS, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True, metrics=counted)
    query.awaitTermination()
    out = readers.read_routed(spark, str(tmp_path / "out"))
    return {r["sink"]: r["count"] for r in out.groupBy("sink").count().collect()}


def test_stream_loses_nothing_and_repeats_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [{"message": "from 10.0.0.1 by a@b.co", "log_type": "syslog"}, {"message": "", "log_type": "syslog"}, {"log_type": "syslog"}]
    lines = [json.dumps(e) for e in events] + ["{broken", "{broken"] + [json.dumps(events[0])] * 4
    (tmp_path / "in" / "1.json").write_text("\n".join(lines) + "\n")
    counted = metrics.ServiceMetrics()
    # five equal lines are five events, the empty message is none
    assert run_stream(spark, tmp_path, counted) == {"anonymized": 5, "audit": 10, "quarantine": 3}
    (tmp_path / "in" / "2.json").write_text(json.dumps({"message": "c@d.org", "log_type": None}) + "\n")
    assert run_stream(spark, tmp_path, counted) == {"anonymized": 6, "audit": 11, "quarantine": 3}
    assert spark.read.parquet(str(tmp_path / "store" / "00000000-base")).count() == 2
    text = counted.render()
    for line in ("veilspan_lines_total 9", "veilspan_quarantined_total 3", "veilspan_token_store_size 2", 'veilspan_detections_total{type="EMAIL"} 6', 'veilspan_detections_total{type="IP"} 5', 'veilspan_store_save_total{outcome="persisted"} 2', "veilspan_batch_seconds_count 2"):
        assert line in text.splitlines(), line
    rows = pipeline.parsed(spark.createDataFrame([("1", None, "{bad")], "doc_id string, ts timestamp, value string")).collect()
    assert rows[0]["log"] == "{bad" and rows[0]["quarantine_reason"]


def test_repeated_batch_replaces_itself(spark, tmp_path):
    events = spark.createDataFrame([(json.dumps({"message": "mail a@b.co", "log_type": "syslog"}), "f")] * 3, "value string, file string").withColumn("ts", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    store = tokens.TokenStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        pipeline.process_batch(pipeline.parsed(events), KEYS, store, str(tmp_path / "out"), 7, F.lit(1))
    out = readers.read_routed(spark, str(tmp_path / "out"))
    assert out.where("sink = 'anonymized'").count() == 3 and out.where("sink = 'audit'").count() == 3 and store.read().count() == 1
    assert {r["suffix"] for r in out.where("sink = 'audit'").collect()} == {"2026.01"}
    # the same ids in a later batch: the later rows stand
    later = out.where("sink = 'anonymized'").withColumn("message", F.lit("later"))
    readers.append(later, str(tmp_path / "out"), 8)
    assert {r["message"] for r in readers.read_routed(spark, str(tmp_path / "out")).where("sink = 'anonymized'").collect()} == {"later"}


def test_equal_lines_keep_their_ids(spark):
    lines = spark.createDataFrame([("f", "same")] * 25 + [("f", "other"), ("g", "same")], "file string, value string").withColumn("ts", F.lit(None).cast("timestamp"))
    first, again = (sorted(r["doc_id"] for r in pipeline.numbered(lines.repartition(n)).collect()) for n in (1, 5))
    assert first == again and len(set(first)) == 27


def test_event_time_windows_and_watermark(spark, tmp_path):
    """As a stream: windows are told once the watermark has passed them, and lines later than it are left out."""
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    schema = "ts timestamp, log_type string, log string"

    def put(number, *rows):
        lines = [json.dumps({"ts": ts, "log_type": "windows_event", "log": log}) for ts, log in rows]
        (tmp_path / f"{number}.json").write_text("\n".join(lines))
        source.mkdir(exist_ok=True)
        os.rename(tmp_path / f"{number}.json", source / f"{number}.json")

    def run():
        stats = pipeline.windowed_field_stats(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)), over="1 hour", late="10 minutes")
        stats.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return {(r["start"].hour, r["field"]): (r["total"], r["critical_hits"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    put(1, ("2026-01-01 10:05:00", "User=johnsmith"), ("2026-01-01 10:50:00", "User=nobody"))
    put(2, ("2026-01-01 12:30:00", "User=a@b.co"))
    assert run() == {(10, "User"): (2, 1)}
    put(3, ("2026-01-01 10:59:00", "User=johnsmith"), ("2026-01-01 14:00:00", "User=x"))
    assert run() == {(10, "User"): (2, 1), (12, "User"): (1, 1)}


class SqliteList:
    """A list store in a file, which many processes share, with the commands of the queue's client."""

    def __init__(self, path):
        self.db = sqlite3.connect(path, timeout=30)
        self.db.execute("create table if not exists items (id integer primary key autoincrement, key text, value text)")
        self.db.execute("create table if not exists numbers (key text primary key, value integer)")

    def rpush(self, key, value):
        with self.db:
            self.db.execute("insert into items (key, value) values (?, ?)", (key, value))

    def llen(self, key):
        return self.db.execute("select count(*) from items where key = ?", (key,)).fetchone()[0]

    def lrange(self, key, first, last):
        return [v.encode() for (v,) in self.db.execute("select value from items where key = ? order by id limit ? offset ?", (key, last - first + 1, first))]

    def get(self, key):
        row = self.db.execute("select value from numbers where key = ?", (key,)).fetchone()
        return row and row[0]

    def pipeline(self, transaction):
        steps = []
        delete = "delete from items where key = ? and id in (select id from items where key = ? order by id limit ?)"
        add = "insert into numbers values (?, ?) on conflict (key) do update set value = value + excluded.value"

        def execute():
            with self.db:
                for sql, values in steps:
                    self.db.execute(sql, values)

        return types.SimpleNamespace(ltrim=lambda key, n, _: steps.append((delete, (key, key, n))), incrby=lambda key, n: steps.append((add, (key, n))), execute=execute)


@pytest.fixture
def factory(tmp_path):
    """A client of a list store in a file, for any process."""
    return f"tests.test_jobs:SqliteList:{tmp_path / 'list.db'}"


def test_queue_is_read_as_a_stream_and_trimmed_on_commit(spark, tmp_path, factory):
    store = SqliteList(str(tmp_path / "list.db"))
    queues.push(spark.range(7).select(F.concat(F.lit("m"), F.col("id").cast("string"), F.lit(" a@b.co")).alias("message"), F.lit("syslog").alias("log_type")), "k", factory)
    assert store.llen("k") == 7

    def run():
        events = pipeline.queue_events(spark, "k", factory, most=3)
        query = pipeline.start(events, KEYS, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
        return readers.read_routed(spark, str(tmp_path / "out")).where("sink = 'anonymized'").count()

    assert run() == 7
    for i in range(4):
        store.rpush("k", json.dumps({"message": f"later {i}", "log_type": "syslog"}))
    assert run() == 11
    assert store.llen("k") + (store.get("k:gone") or 0) == 11 and (store.get("k:gone") or 0) >= 7


def test_queue_offsets(tmp_path, factory):
    store = SqliteList(str(tmp_path / "list.db"))
    for i in range(10):
        store.rpush("k", str(i))
    reader = queues.ListQueueReader({"key": "k", "factory": factory, "most": "4", "slices": "3"})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert (start, end) == ({"event": 0}, {"event": 4})
    read = lambda a, b: [row for part in reader.partitions(a, b) for row in reader.read(part)]
    assert read(start, end) == read(start, end) == [(str(i), f"k-{i}") for i in range(4)]
    reader.commit(end)
    assert store.llen("k") == 6 and reader.latestOffset() == {"event": 8} and read(end, {"event": 8}) == [(str(i), f"k-{i}") for i in range(4, 8)]
    with pytest.raises(RuntimeError):
        read(start, end)


class KafkaStandIn:
    """What the stream reader and writers are asked for, answered by files."""

    def __init__(self, real, log):
        self.real, self.log = real, log

    def format(self, name):
        self.log.append(("format", name))
        return self

    def option(self, name, value):
        self.log.append((name, value))
        return self

    def options(self, **values):
        self.log += values.items()
        return self

    def load(self):
        return self.real

    def save(self):
        self.log.append(("saved", True))


def test_kafka_source_and_sink(spark, tmp_path):
    """No broker here: the topic's columns come from files, and the options are those that the connector is given."""
    (tmp_path / "topic").mkdir()
    (tmp_path / "topic" / "1.json").write_text("\n".join(json.dumps({"value": json.dumps({"message": "by a@b.co", "log_type": "syslog"}), "topic": "logs", "partition": p, "offset": o, "timestamp": "2026-01-01 00:00:00"}) for p, o in ((0, 5), (1, 5))))
    topic = spark.readStream.schema("value string, topic string, partition int, offset long, timestamp timestamp").json(str(tmp_path / "topic"))
    log = []
    session = types.SimpleNamespace(readStream=KafkaStandIn(topic.withColumn("value", F.col("value").cast("binary")), log))
    events = pipeline.kafka_events(session, "broker:9092", "logs", per_trigger=10)
    assert dict(log) == {"format": "kafka", "kafka.bootstrap.servers": "broker:9092", "subscribe": "logs", "startingOffsets": "earliest", "maxOffsetsPerTrigger": 10}
    pipeline.start(events, KEYS, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert {r["doc_id"] for r in readers.read_routed(spark, str(tmp_path / "out")).where("sink = 'anonymized'").collect()} == {"logs-0-5", "logs-1-5"}
    sent = []

    class Rows:
        isStreaming = False

        def select(self, *columns):
            self.columns = columns
            return types.SimpleNamespace(write=KafkaStandIn(None, sent))

    pipeline.to_kafka(Rows(), "broker:9092", "out")
    assert dict(sent) == {"format": "kafka", "kafka.bootstrap.servers": "broker:9092", "topic": "out", "kafka.acks": "all", "saved": True}


def test_two_writers_wait_for_each_other(spark, tmp_path):
    """Eight writers of 25 new values each: every value has one token that resolves."""
    store, failed = tokens.TokenStore(spark, str(tmp_path / "store")), []

    def write(n):
        try:
            values = spark.range(25).select(F.concat(F.lit(f"{n % 4}-"), F.col("id").cast("string")).alias("original"), F.lit("MRN").alias("pii_type"))
            tokens.TokenStore(spark, str(tmp_path / "store")).append(values, KEYS)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = store.read()
    assert not failed and rows.count() == rows.select("original").distinct().count() == 100 and not (tmp_path / "store" / "_writing").exists()


def test_observed_counts(spark):
    lines = spark.createDataFrame([(1, "a@b.co 10.0.0.1"), (2, "nothing"), (3, "MRN-1234567")], "line_id long, log string")
    done, observation = metrics.observed(anonymize.process_lines(lines, detect.scan_regex(F.col("log")), KEYS, F.lit(1)))
    assert done.count() == 3
    got = observation.get
    assert (got["lines"], got["spans"], got["lines_with_spans"], got["EMAIL"], got["IP"], got["MRN"], got["PERSON"]) == (3, 3, 2, 1, 1, 1, 0)


def test_histogram():
    h = metrics.Histogram((1.0, 2.0))
    for x in (0.5, 1.0, 1.5, 9):
        h.observe(x)
    assert h.lines("x") == ['x_bucket{le="1.0"} 2', 'x_bucket{le="2.0"} 3', 'x_bucket{le="+Inf"} 4', "x_sum 12", "x_count 4"]


def test_slow_windows_are_exact(spark):
    """Windows of many, equal, negative, missing and not-a-number values; values without a time are a window of their own."""

    def p95(values):
        return sorted(values, key=lambda x: (x != x, x))[-(-len(values) * 95 // 100) - 1]

    windows = {1: [2.5] * 40, 2: [-i / 7 for i in range(50)] + [0.0, 3.0], 3: [i / 10 for i in range(39)], 4: [float("nan")] * 3 + [7.0] * 16, 5: [1e300, 5e-324, float("inf")], None: [4.0, 9.0, 0.5]}
    windows |= {10 + k: [1 + i / 3 for i in range(n)] for k, n in enumerate((1, 19, 20, 21, 100, 101))}
    rows = spark.createDataFrame([(m, v) for m, values in windows.items() for v in [*values, None]], "m int, seconds double")
    rows = rows.select(F.expr("timestamp_ntz'2024-01-01 00:00:30' + make_interval(0, 0, 0, 0, 0, m)").alias("ts"), "seconds")
    many = spark.range(300_000).select(F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), (1 + F.col("id") * 7919 % 300_000 / 1000).alias("seconds"))
    windows[0] = [1 + i / 1000 for i in range(300_000)]
    rows = rows.unionAll(many)
    got = {r["start"] and r["start"].minute: r["p95"] for r in drift.slow_windows(rows, over="1 minute").select("window.start", "p95").collect()}
    want = {m: x for m, x in ((m, p95(values)) for m, values in windows.items()) if not x <= 1}
    assert {m: str(x) for m, x in got.items()} == {m: str(x) for m, x in want.items()}


def test_review_sample_is_exact(spark):
    import hashlib

    rows = spark.range(5000).select(F.col("id").alias("line_id"), (F.col("id") % 3).cast("int").alias("detector_span_count"))
    found = [i for i in range(5000) if i % 3]
    for rate in (0.0001, 0.05, 1.0):
        want = sorted(found, key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())[: max(1, int(len(found) * rate))]
        assert [r["line_id"] for r in drift.review_sample(rows, rate, 9).collect()] == want


def test_review_sample_searches_what_a_query_made_once(spark):
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("made-here a"), F.col("id"), F.lit("@b.co 10.0.0.1"))).otherwise("nothing")
    lines = spark.range(300).select(F.col("id").alias("line_id"), text.alias("log"))
    spans = F.concat(detect.scan_regex(F.col("log")), detect.scan_flattened_names(F.col("log")))
    sample = drift.review_sample(anonymize.process_lines(lines, spans, KEYS, F.lit(1)), 0.5, 9).select("line_id")
    assert sample._jdf.queryExecution().optimizedPlan().toString().count("made-here") <= 2  # what is taken whole, and what is ranked
    assert sample.count() == 50 and sample.where("line_id % 3 <> 0").count() == 0


def test_review_sample_of_none_of_one_id_and_of_no_id(spark):
    rows = spark.range(40).select(F.when(F.col("id") < 10, F.lit(5)).when(F.col("id") < 20, F.col("id")).alias("line_id"), F.lit(1).alias("detector_span_count"))
    assert drift.review_sample(rows.withColumn("detector_span_count", F.lit(0)), 0.5).count() == 0
    for rate, n, without_id in ((0.2, 8, 0), (0.5, 20, 0), (0.55, 22, 2), (1.0, 40, 20)):
        got = [r["line_id"] for r in drift.review_sample(rows, rate).collect()]
        assert (len(got), got.count(None), got[n - without_id :]) == (n, without_id, [None] * without_id)


def test_sql_surface_equals_the_columns(spark):
    from veilspan.operators import surface

    surface.register(spark)
    texts = ['{"accountId": "730022914466"}', "a@b.co 10.0.0.1 520000111122", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df.createOrReplaceTempView("lines_with_pii")
    got = spark.sql("select i, type, start, end from lines_with_pii, lateral scan_pii(t)").collect()
    want = df.select("i", F.inline(detect.scan_regex(F.col("t")))).select("i", "type", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3
