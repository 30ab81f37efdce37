"""Every query of the engine's own operators, by name, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import fields as fields_of
from veilspan.functions import patterns as P
from veilspan.functions.crypto import decrypt_digits, encrypt_digits
from veilspan.functions.spans import dedup_by_start, shifted, text_of
from veilspan.operators import anonymize, bloom, detect, drift, evaluate, gate, tokens
from veilspan.plans import oracles as O
from veilspan.sources import lineage, readers
from veilspan.sources.logs import log_lines, slot_rows
from veilspan.streaming import pipeline

#: Keys of the test queries; deployments bring their own.
KEYS = anonymize.Keys(pseudonym="test-pseudonym-key", token="test-token-key", audit="test-audit-key", fingerprint="test-fingerprint-key")
PEPPER, FPE_KEY, FPE_TWEAK = "test-pepper", "EF4359D8D580AA4F7F036D6F04FC6A94", "D8E7920AFA330A"
AUDIT_TIME = 1767225600

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its DuckDB counterpart."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _detected(text: Column) -> Column:
    """The production layers without a model: regular expressions, then flattened names."""
    return F.concat(detect.scan_regex(text), detect.scan_flattened_names(text))


def _found(rows: DataFrame, spans: Column, id_: str, text: str) -> DataFrame:
    """id, type, start, end, value of each span."""
    each = rows.select(F.col(id_), F.col(text).alias("_text"), F.explode_outer(spans).alias("s")).where("s is not null")
    return each.select(id_, "s.type", "s.start", "s.end", text_of(F.col("_text"), F.col("s")).alias("value"))


def _spans_sql(spans: str, id_: str) -> str:
    return f'select id as {id_}, type, s as "start", e as "end", v as value from ({spans}) r'


# --- layer 1 and predicates ---

DOC_SPANS = O.regex_spans("documents", "doc_id", "text")


@query(f"select type, count(*) as n from ({DOC_SPANS}) r group by type")
def regex_type_counts(spark, sf_dir):
    found = _documents(spark, sf_dir).select(F.explode(detect.scan_regex(F.col("text"))).alias("s"))
    return found.groupBy("s.type").agg(F.count("*").alias("n"))


@query(_sql := _spans_sql(DOC_SPANS, "doc_id"))
def regex_spans(spark, sf_dir):
    return _found(_documents(spark, sf_dir), detect.scan_regex(F.col("text")), "doc_id", "text")


@query(f"select type, v as value, count(*) as n from ({DOC_SPANS}) r group by type, v order by n desc, type, value limit 20")
def regex_value_topk(spark, sf_dir):
    found = _found(_documents(spark, sf_dir), detect.scan_regex(F.col("text")), "doc_id", "text")
    return found.groupBy("type", "value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type", "value").limit(20)


@query(O.ctes(O.LOGS) + _spans_sql(O.regex_spans("lines", "line_id", "log"), "line_id"))
def log_regex_spans(spark, sf_dir):
    return _found(log_lines(spark, sf_dir), detect.scan_regex(F.col("log")), "line_id", "log")


@query(_spans_sql(O.regex_spans("pages", "page_id", "html"), "page_id"))
def page_regex_spans(spark, sf_dir):
    return _found(readers.spread(_table(spark, sf_dir, "pages").select("page_id", "html")), detect.scan_regex(F.col("html")), "page_id", "html")


@query(O.ctes(O.LOGS) + f"""select log_type, sum(case when kept then 0 else 1 end) as account_ids, sum(case when kept then 1 else 0 end) as cards from (
    select l.log_type, x.id is not null as kept from ({O.matches('lines', 'line_id', 'log', P.REGEX_PATTERNS['CREDIT_CARD'])}) m join lines l on l.line_id = m.id
    left join ({O.regex_spans('lines', 'line_id', 'log')}) x on x.id = m.id and x.s = m.s and x.type = 'CREDIT_CARD') y group by log_type""")
def cc_aws_exclusion(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    numbers = F.size(F.regexp_extract_all("log", F.lit(P.UNICODE + P.REGEX_PATTERNS["CREDIT_CARD"]), F.lit(0)))
    cards = F.size(detect.scan_regex(F.col("log"), ("CREDIT_CARD",)))
    counts = lines.where(numbers > 0).select("log_type", numbers.alias("numbers"), cards.alias("cards"))
    return counts.groupBy("log_type").agg(F.sum(F.col("numbers") - F.col("cards")).alias("account_ids"), F.sum("cards").cast("bigint").alias("cards"))


_ENTITY = "regexp_matches(text, '[A-Za-z]{2,}|[0-9]{2,}')"


@query(f"select role, count(*) as n, sum(case when {_ENTITY} then 0 else 1 end) as skipped from conversations group by role")
def early_exit_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count_if(~detect.could_hold_entity(F.col("text"))).alias("skipped"))


# --- entropy ---


@query(f"select id as doc_id, count(*) as hits from ({O.entropy_hits('documents', 'doc_id', 'text')}) r group by id")
def entropy_tokens(spark, sf_dir):
    found = _documents(spark, sf_dir).select("doc_id", F.size(detect.scan_entropy(F.col("text"))).alias("hits"))
    return found.where("hits > 0").select("doc_id", F.col("hits").cast("bigint").alias("hits"))


_WITH_UUID = O.entropy_hits("lines", "line_id", "log").replace("not regexp_matches", "regexp_matches")


@query(O.ctes(O.LOGS, ("kept", O.entropy_hits("lines", "line_id", "log")), ("held", _WITH_UUID))
    + "select log_type, (select count(*) from kept where id in (select line_id from lines l where l.log_type = t.log_type)) as hits, (select count(*) from held where id in (select line_id from lines l where l.log_type = t.log_type)) as uuids from (select distinct log_type from lines) t")
def uuid_exclusion_counts(spark, sf_dir):
    """Entropy hits, and tokens that would be hits if they held no UUID."""
    text = F.col("log")
    counts = log_lines(spark, sf_dir).select("log_type", F.size(detect.scan_entropy(text)).alias("hits"), F.size(detect.scan_entropy(text, uuids=True)).alias("all"))
    return counts.groupBy("log_type").agg(F.sum("hits").alias("hits"), F.sum(F.col("all") - F.col("hits")).alias("uuids"))


@query("select c as token, round(list_aggregate(string_split(c, ''), 'entropy'), 6) as bits from (select distinct c_name as c from customer) x")
def shannon_entropies(spark, sf_dir):
    names = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("token")).distinct()
    return names.select("token", F.round(detect.shannon_entropy(F.col("token")), 6).alias("bits"))


_GRID = "(select unnest([12, 16, 20]) as min_len) a cross join (select unnest([3.3, 3.6, 3.9, 4.2]) as threshold) b"
_SWEEP = O.ctes(
    O.LOGS, ("gold", O.gold()), ("grid", f"select min_len, cast(threshold as double) as threshold from {_GRID}"),
    ("toks", f"select id, s, e, length(v) as n, list_aggregate(string_split(v, ''), 'entropy') as h from ({O.matches('lines', 'line_id', 'log', P.ENTROPY_TOKEN)}) x where not regexp_matches(v, {O.quoted(P.UUID)})"),
    ("hits", "select min_len, threshold, id, s, e from grid, toks where n >= min_len and h >= threshold"),
    ("tp", "select min_len, threshold, count(distinct (h.id, g.s)) as tp from hits h join gold g on g.id = h.id and h.s < g.e and g.s < h.e group by all"),
    ("flags", "select min_len, threshold, count(*) as flags, count(distinct case when l.used = '' then h.id end) as flagged from hits h join lines l on l.line_id = h.id group by all"),
    ("sums", """select g.min_len, g.threshold, coalesce(tp.tp, 0) as tp, coalesce(flags, 0) - coalesce(tp.tp, 0) as fp, (select count(*) from gold) - coalesce(tp.tp, 0) as fn, coalesce(flagged, 0) as flagged
        from grid g left join tp using (min_len, threshold) left join flags using (min_len, threshold)"""),
    ("rates", """select min_len, threshold, tp, fp, fn, case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0 end as precision, case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0 end as recall,
        cast(flagged as double) / (select count(*) from lines where used = '') as false_alarm_rate from sums"""),
)


@query(_SWEEP + "select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from rates")
def entropy_sweep(spark, sf_dir):
    return evaluate.entropy_sweep(log_lines(spark, sf_dir, gold=True))


@query(_SWEEP + "select min_len, threshold, f1 from (select min_len, threshold, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from rates) x order by f1 desc, min_len, threshold limit 1")
def entropy_best_setting(spark, sf_dir):
    return evaluate.best_setting(evaluate.entropy_sweep(log_lines(spark, sf_dir, gold=True)))


@query(O.ctes(O.LOGS, ("gold", O.gold()), ("hits", O.entropy_hits("lines", "line_id", "log"))) + """select count(*) as flags,
    (select count(distinct (h.id, h.s)) from hits h join gold g on g.id = h.id where h.s < g.e and g.s < h.e) as overlapping_gold, count_if(l.used = '') as on_clean_lines,
    count(distinct case when l.used = '' then h.id end) as clean_lines_flagged, (select count(*) from lines where used = '') as clean_lines from hits h join lines l on l.line_id = h.id""")
def entropy_false_alarms(spark, sf_dir):
    return evaluate.entropy_false_alarms(log_lines(spark, sf_dir, gold=True), examples=0)


# --- flattened names ---


@query(O.ctes(O.LOGS) + _spans_sql(O.flattened("lines", "line_id", "log"), "line_id"))
def flattened_names(spark, sf_dir):
    return _found(log_lines(spark, sf_dir), detect.scan_flattened_names(F.col("log")), "line_id", "log")


#: A dictionary of words that the documents' prose is full of, in all its languages.
WORDS = ("the", "tion", "thon", "der", "les", "que", "una"), ("ring", "ble", "and", "ung", "ment", "ado", "tion")


@query(f"select id as doc_id, v as value, count(*) as n from ({O.flattened_values('documents', 'doc_id', 'text', detect.name_patterns(*WORDS))}) r group by all")
def flattened_names_documents(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    return _found(rows, detect.scan_flattened_names(F.col("text"), *WORDS), "doc_id", "text").groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def _dictionary(spark: SparkSession) -> DataFrame:
    names = sorted({*P.FIRST_NAMES, *P.LAST_NAMES})
    return spark.createDataFrame([(n, n in P.FIRST_NAMES, n in P.LAST_NAMES) for n in names], "name string, is_first boolean, is_last boolean")


@query(O.ctes(O.LOGS) + f'select id as line_id, s as "start", e as "end" from ({O.flattened("lines", "line_id", "log")}) r')
def flattened_names_join(spark, sf_dir):
    return detect.flattened_names_by_join(log_lines(spark, sf_dir), _dictionary(spark), text="log")


# --- fields ---


def _field_rows(lines: DataFrame) -> DataFrame:
    return lines.select("line_id", "log_type", F.inline(fields_of.extract_fields(F.col("log_type"), F.col("log")))).select("line_id", "log_type", "pos", "field", "value")


def _fields_query(log_type: str) -> None:
    def run(spark, sf_dir):
        return _field_rows(log_lines(spark, sf_dir).where(F.col("log_type") == log_type))

    run.__name__ = {"windows_event": "kv_fields", "syslog": "syslog_fields", "cloudtrail": "cloudtrail_fields"}[log_type]
    query(O.ctes(O.LOGS) + f"select line_id, log_type, cast(row_number() over (partition by line_id order by pos) - 1 as integer) as pos, field, value from ({O.fields()}) f where log_type = '{log_type}'")(run)


for _kind in P.LOG_TYPES:
    _fields_query(_kind)


@query(O.ctes(O.LOGS) + f"select l.log_type, count(*) as n, avg(case when f.line_id is null then cast(0 as double) else 1 end) as engaged from lines l left join (select distinct line_id from ({O.fields()}) x) f on f.line_id = l.line_id group by l.log_type")
def field_engagement(spark, sf_dir):
    engaged = (F.size(fields_of.extract_fields(F.col("log_type"), F.col("log"))) > 0).cast("double")
    return log_lines(spark, sf_dir).groupBy("log_type").agg(F.count("*").alias("n"), F.avg(engaged).alias("engaged"))


_HEADED = "select line_id as id, 'Jan ' || lpad(cast(1 + line_id % 28 as varchar), 2, ' ') || ' 10:00:00 host' || cast(line_id % 7 as varchar) || ' ' || log as t, log from lines where log_type = 'syslog'"


@query(O.ctes(O.LOGS, ("headed", _HEADED)) + f"""select id as line_id, type, s + length(t) - length(log) as "start", e + length(t) - length(log) as "end", v as value from ({O.regex_spans('headed', 'id', 'log').replace('select id, t ', 'select id, t ')}) r join (select id as hid, t, log from headed) h on h.hid = r.id""")
def syslog_header_shift(spark, sf_dir):
    head = F.concat(F.lit("Jan "), F.lpad((1 + F.col("line_id") % 28).cast("string"), 2, " "), F.lit(" 10:00:00 host"), (F.col("line_id") % 7).cast("string"), F.lit(" "))
    lines = log_lines(spark, sf_dir).where("log_type = 'syslog'").select("line_id", F.concat(head, "log").alias("log"))
    lines = lines.withColumn("stripped", fields_of.strip_syslog_header(F.col("log")))
    return _found(lines, shifted(detect.scan_regex(F.col("stripped.rest")), F.col("stripped.prefix_len")), "line_id", "log")


@query("""select event_id, 'EventID=' || cast(event_id as varchar) || (case when event_type = 'view' then '' else ' Hostname=' || event_type end) || ' IpPort=' || cast(user_id as varchar) as flat from events""")
def windows_flatten(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    raw = F.to_json(F.struct(F.col("user_id").cast("string").alias("IpPort"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("Hostname"), F.col("event_id").cast("string").alias("EventID")))
    return events.select("event_id", fields_of.flatten_windows_event(raw).alias("flat"))


@query(O.ctes(O.LOGS) + """select json_extract_string(j, '$.eventName') as "eventName", count(*) as n, count(json_extract_string(j, '$.userIdentity.accountId')) as accounts,
    sum(case when length(json_extract(j, '$.requestParameters')::varchar) < 50 then 1 else 0 end) as kept from (select case when log_type = 'cloudtrail' and json_valid(log) then log end as j from lines where log_type = 'cloudtrail') x group by 1""")
def cloudtrail_trims(spark, sf_dir):
    raw = log_lines(spark, sf_dir).where("log_type = 'cloudtrail'").select(F.col("log").alias("value"))
    trimmed = readers.trimmed_cloudtrail(raw, longest=50)
    return trimmed.groupBy("eventName").agg(F.count("*").alias("n"), F.count("userIdentity.accountId").alias("accounts"), F.count("requestParameters").alias("kept"))


# --- drift ---


def _half(spark: SparkSession, sf_dir: str) -> Column:
    """Whether a line is of the first half by number, which is by time; found in the plan, without a job of its own."""
    ids = _table(spark, sf_dir, "events").agg(F.expr("(max(event_id) + 1) div 2").alias("half"))
    return F.col("line_id") < ids.scalar()


def _windows(spark: SparkSession, sf_dir: str, inject: bool = False) -> tuple[DataFrame, DataFrame]:
    first = _half(spark, sf_dir)
    return log_lines(spark, sf_dir).where(first), log_lines(spark, sf_dir, inject).where(~first)


def _stats(spark, sf_dir, inject=False) -> DataFrame:
    """Statistics of both halves; with ``inject`` the second one is drifted."""
    first = _half(spark, sf_dir)
    if not inject:
        return drift.halves(log_lines(spark, sf_dir), first)
    rows = slot_rows(spark, sf_dir).select("line_id", "log_type", "log").where(first).unionAll(slot_rows(spark, sf_dir, inject).select("line_id", "log_type", "log").where(~first))
    return drift.halves(rows, first)


@query(O.ctes(O.LOGS, *O.field_stats(O.fields(), "true", "a")) + "select log_type, field, total, cast(critical_hits as bigint) as critical_hits from a")
def field_stats(spark, sf_dir):
    return drift.field_stats(log_lines(spark, sf_dir))


_RATES = "log_type, field, baseline_rate, current_rate, delta, baseline_n, current_n"


@query(O.drift(f"select {_RATES} from rates where flagged"))
def drift_compare(spark, sf_dir):
    return drift.compare(_stats(spark, sf_dir))


@query(O.drift(f"select {_RATES} from rates where flagged", injected=True))
def drift_compare_injected(spark, sf_dir):
    return drift.compare(_stats(spark, sf_dir, inject=True))


@query(O.drift(f"select {_RATES}, flagged from rates"))
def drift_compare_all(spark, sf_dir):
    return drift.compare_all(_stats(spark, sf_dir))


@query(O.drift("select log_type, field, baseline_n, current_n from compared where baseline_n < 20 or current_n < 20"))
def drift_insufficient(spark, sf_dir):
    return drift.insufficient(_stats(spark, sf_dir))


@query(O.drift("select log_type, field, 'critical_hit_rate' as metric, current_rate as value from rates union all select log_type, field, 'flagged', case when flagged then 1.0 else 0.0 end::double from rates", injected=True))
def drift_metrics(spark, sf_dir):
    return drift.metric_rows(drift.compare_all(_stats(spark, sf_dir, inject=True)))


@query(O.drift("select log_type, field, 'flagged' as metric, 1.0::double as value from rates where flagged", injected=True))
def drift_alerts(spark, sf_dir):
    return drift.firing(drift.metric_rows(drift.compare_all(_stats(spark, sf_dir, inject=True))))


@query(O.drift(f"""select (select count(*) from lines where line_id < {O.HALF}) as baseline_entries, (select count(*) from lines where line_id >= {O.HALF}) as current_entries,
    (select count(*) from rates where flagged) as fields_flagged, (select count(*) from compared where baseline_n < 20 or current_n < 20) as fields_insufficient_data""", injected=True))
def drift_summary(spark, sf_dir):
    return drift.summary(*_windows(spark, sf_dir, inject=True))


@query("select time_bucket(interval '1 day', ts) as start, quantile_disc(value, 0.95) as p95 from events group by 1 having quantile_disc(value, 0.95) > 1")
def latency_alerts(spark, sf_dir):
    return drift.slow_windows(_table(spark, sf_dir, "events"), seconds="value", over="1 day").select("window.start", "p95")


@query(O.ctes(O.LOGS, *O.field_stats(f"select f.*, time_bucket(interval '7 days', l.ts, timestamp '1970-01-01') as start from ({O.fields()}) f join lines l on l.line_id = f.line_id", "true", "a"),
    ("w", "select start, log_type, field, count(*) as total, sum(case when regexp_matches(value, " + O.quoted(O.CRITICAL) + ") or vid in (select id from a_names) then 1 else 0 end) as critical_hits from a_values group by all"))
    + "select start, log_type, field, total, cast(critical_hits as bigint) as critical_hits from w")
def windowed_stats(spark, sf_dir):
    """The stream's event-time windows, over the table."""
    return pipeline.windowed_field_stats(log_lines(spark, sf_dir))


@query("select event_type, count(distinct user_id) as users, true as near from events group by event_type")
def approximate_users(spark, sf_dir):
    users = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return users.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users") + 1).alias("near"))


# --- anonymization, tokens, audit ---


def _values(spark, sf_dir) -> DataFrame:
    return _found(_documents(spark, sf_dir), detect.scan_regex(F.col("text")), "doc_id", "text")


@query(f"select doc_id, type, value, {O.pseudonym('value', 'type', KEYS.pseudonym)} as pseudonym from ({_spans_sql(DOC_SPANS, 'doc_id')}) x where type in ('IP', 'PERSON')")
def pseudonymized_values(spark, sf_dir):
    return _values(spark, sf_dir).where(F.col("type").isin(*P.PSEUDONYMIZE_TYPES)).select("doc_id", "type", "value", anonymize.pseudonym(F.col("value"), F.col("type"), KEYS.pseudonym).alias("pseudonym"))


@query(f"select doc_id, type, value, {O.token('value', 'type', KEYS.token)} as token from ({_spans_sql(DOC_SPANS, 'doc_id')}) x where type not in ('IP', 'PERSON')")
def tokenized_values(spark, sf_dir):
    return _values(spark, sf_dir).where(F.col("type").isin(*P.TOKENIZE_TYPES)).select("doc_id", "type", "value", anonymize.token(F.col("value"), F.col("type"), KEYS.token).alias("token"))


@query(O.ctes(O.LOGS) + _spans_sql(" union all ".join([O.regex_spans("lines", "line_id", "log"), O.ner_spans("lines", "line_id", "log"), f"select id, 'HIGH_ENTROPY' as type, s, e, v from ({O.entropy_hits('lines', 'line_id', 'log')}) h", O.flattened("lines", "line_id", "log")]), "line_id"))
def detect_all_layers(spark, sf_dir):
    return _found(log_lines(spark, sf_dir), detect.detect_all(F.col("log"), detect.rule_ner()), "line_id", "log")


_FIRST_SEEN = f"select v as original, arg_min(type, id * 1000000 - s) as pii_type from ({O.regex_spans('lines', 'line_id', 'log')}) r where type not in ('IP', 'PERSON') group by v"
_STORE = ("store", f"select original, {O.token('original', 'pii_type', KEYS.token)} as token, pii_type, 'current' as key_epoch from ({_FIRST_SEEN}) f")


def _store(lines: DataFrame) -> DataFrame:
    return tokens.minted(tokens.first_seen(lines, _detected(F.col("log"))), KEYS)


@query(O.ctes(O.LOGS, _STORE) + "select * from store")
def token_store_build(spark, sf_dir):
    return _store(log_lines(spark, sf_dir))


@query(O.ctes(O.LOGS, _STORE) + "select token, original from store union all select 'tok_ssn_' || cast(r_regionkey as varchar), null from region")
def resolve_join(spark, sf_dir):
    store = _store(log_lines(spark, sf_dir))
    unknown = _table(spark, sf_dir, "region").select(F.concat(F.lit("tok_ssn_"), F.col("r_regionkey").cast("string")).alias("token"))
    return tokens.resolve(store.select("token").unionByName(unknown), store).select("token", "original")


@query(O.ctes(O.LOGS, _STORE, ("half", f"select * from store where original in (select v from ({O.regex_spans('lines', 'line_id', 'log')}) r where id < {O.HALF})"))
       + f"select original, {O.token('original', 'pii_type', 'rotated-key')} as token, pii_type, 'rotated' as key_epoch from store where original not in (select original from half) union all select * from half")
def rotated_token_store(spark, sf_dir):
    first, _ = _windows(spark, sf_dir)
    old = _store(first)
    rotated = anonymize.Keys(KEYS.pseudonym, "rotated-key", KEYS.audit, KEYS.fingerprint, epoch="rotated")
    return old.unionByName(tokens.minted(tokens.first_seen(log_lines(spark, sf_dir), _detected(F.col("log"))), rotated, old))


_ANON = O.ctes(
    O.LOGS, ("d", O.detected()),
    ("o", "select *, coalesce(lag(e) over (partition by id order by s), 0) as p, row_number() over (partition by id order by s desc) as back from d"),
    ("parts", f"select id, s, substring(log, p + 1, s - p) || {O.replaced('type', 'v', KEYS)} || case when back = 1 then substring(log, e + 1) else '' end as part from o join lines on line_id = id"),
    ("anon", "select id, string_agg(part, '' order by s) as anonymized from parts group by id"),
)


def _anonymized(lines: DataFrame) -> DataFrame:
    return anonymize.process_lines(lines, F.concat(_detected(F.col("log")), detect.scan_entropy(F.col("log"))), KEYS, F.lit(AUDIT_TIME))


@query(_ANON + "select line_id, log_type, coalesce(anonymized, log) as anonymized, (select count(*) from d where d.id = line_id) as detector_span_count from lines left join anon on id = line_id")
def anonymized_logs(spark, sf_dir):
    return _anonymized(log_lines(spark, sf_dir)).select("line_id", "log_type", "anonymized", F.col("detector_span_count").cast("bigint").alias("detector_span_count"))


_DOC_PARTS = O.ctes(
    ("d", f"select id, type, s, e, v from ({DOC_SPANS}) r"),
    ("named", f"select count(*) as n from ({O.flattened_values('documents', 'doc_id', 'text')}) f"),
    ("o", "select *, coalesce(lag(e) over (partition by id order by s), 0) as p, row_number() over (partition by id order by s desc) as back from d"),
    ("parts", f"select id, s, substring(text, p + 1, s - p) || {O.replaced('type', 'v', KEYS)} || case when back = 1 then substring(text, e + 1) else '' end as part from o join documents on doc_id = id"),
    ("anon", "select id, string_agg(part, '' order by s) as anonymized from parts group by id"),
)


@query(_DOC_PARTS + "select doc_id, coalesce(anonymized, text) as anonymized, (select count(*) from d where d.id = doc_id) + (select n from named) as spans from documents left join anon on id = doc_id")
def anonymized_documents(spark, sf_dir):
    """The counterpart takes it that no document holds a name of the dictionary, and counts any that does as an extra span of all."""
    found = _documents(spark, sf_dir).withColumn("found", dedup_by_start(_detected(F.col("text"))))
    return found.select("doc_id", anonymize.anonymize_by_policy(F.col("text"), F.col("found"), KEYS).alias("anonymized"), F.size("found").cast("bigint").alias("spans"))


@query(_ANON.replace(O.replaced("type", "v", KEYS), O.quoted(P.PLACEHOLDER)) + "select line_id, coalesce(anonymized, log) as masked from lines left join anon on id = line_id")
def masked_logs(spark, sf_dir):
    return log_lines(spark, sf_dir).select("line_id", anonymize.mask(F.col("log"), _detected(F.col("log"))).alias("masked"))


_BY_STORE = O.ctes(
    O.LOGS, _STORE, ("d", f"select * from ({O.detected()}) x where type in ('EMAIL', 'MRN', 'CREDIT_CARD', 'SSN')"),
    ("o", "select *, coalesce(lag(e) over (partition by id order by s), 0) as p, row_number() over (partition by id order by s desc) as back from d"),
    ("parts", "select id, s, substring(log, p + 1, s - p) || token || case when back = 1 then substring(log, e + 1) else '' end as part from o join lines on line_id = id join store on original = v"),
    ("anon", "select id, string_agg(part, '' order by s) as anonymized from parts group by id"),
)


@query(_BY_STORE + "select line_id, coalesce(anonymized, log) as anonymized, log as restored from lines left join anon on id = line_id")
def detokenize_roundtrip(spark, sf_dir):
    """Every line with the tokens that the store issued, and with its values again. Texts are searched once."""
    spans = F.filter(_detected(F.col("log")), lambda s: s["type"].isin(*P.TOKENIZE_TYPES))
    lines = lineage.cut(log_lines(spark, sf_dir).select("line_id", "log", spans.alias("spans")))
    store = lineage.cut(tokens.minted(tokens.first_seen(lines, F.col("spans")), KEYS))
    out = tokens.anonymize_with_store(lines, F.col("spans"), KEYS, store)
    return tokens.detokenize(lineage.cut(out), store, keep=True)


_METHOD = f"case when type in ('IP', 'PERSON') then 'pseudonymize' when type in ('EMAIL', 'MRN', 'CREDIT_CARD', 'SSN') then 'tokenize' else {O.quoted(P.MASK_METHOD)} end"
_EVENTS = O.ctes(
    O.LOGS, ("d", O.detected()),
    ("n", f"select id, row_number() over (partition by id order by s) - 1 as number, type, {_METHOD} as method, {O.hmac_sha256_sql(KEYS.fingerprint, 'v')} as fp from d"),
    ("ev", f"select *, '{{\"field_type\": \"' || type || '\", \"method\": \"' || method || '\", \"original_value_fingerprint\": \"' || fp || '\", \"policy_version\": \"1\", \"timestamp\": {AUDIT_TIME}}}' as payload from n"),
)


@query(_EVENTS + f"""select cast(id as varchar) || '-audit-' || cast(number as varchar) as event_id, id as line_id, log_type, type as field_type, method, '1' as policy_version, fp as original_value_fingerprint,
    cast({AUDIT_TIME} as bigint) as timestamp, {O.hmac_sha256_sql(KEYS.audit, 'payload')} as authentication_tag from ev join lines on line_id = id""")
def audit_events(spark, sf_dir):
    return anonymize.audit_rows(_anonymized(log_lines(spark, sf_dir)))


@query(_EVENTS + "select count(*) as events, count(*) as authentic, cast(0 as bigint) as authentic_after_change from ev")
def audit_verify(spark, sf_dir):
    events = anonymize.audit_rows(_anonymized(log_lines(spark, sf_dir))).select(F.struct("field_type", "method", "policy_version", "original_value_fingerprint", "timestamp", "authentication_tag").alias("e"))
    changed = F.col("e").withField("method", F.lit("none"))
    return events.agg(F.count("*").alias("events"), F.count_if(anonymize.verify_audit_event(F.col("e"), KEYS.audit)).alias("authentic"), F.count_if(anonymize.verify_audit_event(changed, KEYS.audit)).alias("authentic_after_change"))


#: A published sample of the cipher, under the test key and tweak.
FPE_SAMPLE = ("890121234567890000", "477064185124354662")


@query(O.ctes(O.LOGS) + f"""select line_id, card, card as restored, length(card) as n, true as changed, cast(null as varchar) as cipher from lines where contains(used, 'card')
    union all select -1, '{FPE_SAMPLE[0]}', '{FPE_SAMPLE[0]}', {len(FPE_SAMPLE[0])}, true, '{FPE_SAMPLE[1]}'""")
def fpe_roundtrip(spark, sf_dir):
    """Card numbers in their own format, and back; and the published sample with its ciphertext."""
    rows = slot_rows(spark, sf_dir).where(F.contains("used", F.lit("card"))).select("line_id", "card")
    rows = rows.unionAll(spark.range(1).select(F.lit(-1).cast("bigint"), F.lit(FPE_SAMPLE[0])))
    rows = rows.withColumn("cipher", encrypt_digits(F.col("card"), FPE_KEY, FPE_TWEAK))
    shown = F.when(F.col("line_id") < 0, F.col("cipher"))
    return rows.select("line_id", "card", decrypt_digits(F.col("cipher"), FPE_KEY, FPE_TWEAK).alias("restored"), F.length("cipher").cast("bigint").alias("n"), (F.col("cipher") != F.col("card")).alias("changed"), shown.alias("cipher"))


@query(O.ctes(O.LOGS, ("d", O.detected()), ("f", "select id as line_id, count(*) as n from d group by id")) + "select line_id from f order by md5('7:' || cast(line_id as varchar)), line_id limit (select greatest(1, floor(count(*) * 0.05)::bigint) from f)")
def review_sample(spark, sf_dir):
    lines = log_lines(spark, sf_dir)  # high-entropy tokens are no spans of a processed line, so that they need not be sought
    return drift.review_sample(anonymize.process_lines(lines, _detected(F.col("log")), KEYS, F.lit(AUDIT_TIME)), seed=7).select("line_id")


# --- evaluation ---


def _labelled(spark, sf_dir, strategy: str = "naive_flattened") -> DataFrame:
    return gate.predicted(log_lines(spark, sf_dir, gold=True), strategy, detect.rule_ner())


_NER = O.ner_spans("lines", "line_id", "log")
_PRED = {
    "regex_only": O.regex_spans("lines", "line_id", "log"),
    "naive": f"{O.regex_spans('lines', 'line_id', 'log')} union all {_NER}",
    "naive_flattened": f"{O.regex_spans('lines', 'line_id', 'log')} union all {_NER} union all {O.flattened('lines', 'line_id', 'log')}",
    "field_gated": O.gated_spans(),
    "tiered": f"with r as ({O.regex_spans('lines', 'line_id', 'log')}) select * from r union all select * from ({_NER}) n where id not in (select id from r)",
}


def _confusion_sql(pred: str) -> tuple[tuple[str, str], ...]:
    """In the fixture, equal-type spans of several detectors are equal or nested at one start, and overlap one labelled span."""
    return (
        O.LOGS, *(O.gate() if "gate_lines" in pred else ()), ("gold", O.gold()), ("raw", pred), ("pred", "select id, type, s, min(e) as e from raw group by all"),
        ("tp", "select type, count(distinct (g.id, g.s)) as tp from gold g join pred p using (type) where g.id = p.id and g.s < p.e and p.s < g.e group by type"),
        ("types", "select type from gold union select type from pred"),
        ("counts", """select t.type, coalesce(tp, 0) as tp, (select count(*) from pred p where p.type = t.type) - coalesce(tp, 0) as fp,
            (select count(*) from gold g where g.type = t.type) - coalesce(tp, 0) as fn from types t left join tp on tp.type = t.type"""),
    )


def _confusion_query(strategy: str) -> None:
    def run(spark, sf_dir):
        return evaluate.confusion(_labelled(spark, sf_dir, strategy))

    run.__name__ = f"confusion_{strategy}"
    query(O.ctes(*_confusion_sql(_PRED[strategy])) + "select * from counts")(run)


for _strategy in gate.STRATEGIES:
    _confusion_query(_strategy)


@query(O.ctes(*_confusion_sql(_PRED["naive_flattened"])) + "select * from counts")
def confusion_predicted_first(spark, sf_dir):
    """Predicted spans lead the matching; where each overlaps one labelled span of its type, that makes no difference."""
    return evaluate.confusion(_labelled(spark, sf_dir), outer="pred")


@query(O.ctes(*_confusion_sql(_PRED["naive_flattened"]), ("all_", "select * from counts union all select 'MICRO-AVG', sum(tp), sum(fp), sum(fn) from counts"),
    ("r", "select type, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0 end as precision, case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0 end as recall from all_"))
    + "select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from r")
def micro_metrics(spark, sf_dir):
    return evaluate.metrics(evaluate.confusion(_labelled(spark, sf_dir)))


@query(O.ctes(*_confusion_sql(_PRED["naive_flattened"])) + 'select id as line_id, type, s as "start", e as "end" from pred')
def span_dedup(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return rows.select("line_id", F.inline(dedup_by_start(F.col("pred")))).select("line_id", "type", "start", "end")


@query(O.ctes(*_confusion_sql(_PRED["naive"])) + """select case when contains(g.v, ' ') then 'spaced' else 'flat' end as format, count(distinct (g.id, g.s)) as gold,
    count(distinct case when g.s < p.e and p.s < g.e then (g.id, g.s) end) as matched from gold g left join (select * from pred where type = 'PERSON') p on p.id = g.id where g.type = 'PERSON' group by 1""")
def person_format_breakdown(spark, sf_dir):
    return evaluate.person_formats(_labelled(spark, sf_dir, "naive"))


@query(O.ctes(O.LOGS, ("a", f"select id, type, s, min(e) as e from ({_PRED['naive']}) x group by all"), ("b", f"select id, type, s, min(e) as e from ({_PRED['naive_flattened']}) x group by all"))
    + "select type, coalesce(naive, 0) as naive, coalesce(flattened, 0) as flattened from (select type, count(*) as flattened from b group by type) y left join (select type, count(*) as naive from a group by type) x using (type)")
def type_tally_pivot(spark, sf_dir):
    lines = gate.predicted(log_lines(spark, sf_dir), "naive", detect.rule_ner(), out="naive")
    lines = lines.withColumn("flattened", dedup_by_start(F.concat("naive", detect.scan_flattened_names(F.col("log")))))
    return evaluate.type_tally(lines, {"naive": dedup_by_start(F.col("naive")), "flattened": F.col("flattened")})


_SKIPPED = "not regexp_matches(log, '[A-Za-z]{2,}|[0-9]{2,}')"


@query(O.ctes(O.LOGS, ("gold", O.gold())) + f"""select log_type, count(*) as lines, count_if({_SKIPPED}) as skipped, count_if({_SKIPPED} and line_id in (select id from gold)) as skipped_with_gold,
    count_if(line_id in (select id from gold)) as with_gold from lines group by log_type""")
def early_exit_safety(spark, sf_dir):
    return evaluate.early_exit_safety(log_lines(spark, sf_dir, gold=True), by="log_type")


@query(O.ctes(*_confusion_sql(O.regex_spans("lines", "line_id", "log", exclude=False))) + """select count(*) as false_positives, count_if(regexp_matches(log, 'accountId": "' || substring(log, s + 1, e - s) || '"')) as account_ids
    from (select * from pred where type = 'CREDIT_CARD' and (id, s) not in (select (p.id, p.s) from pred p join gold g on g.id = p.id and g.type = p.type where g.s < p.e and p.s < g.e and p.type = 'CREDIT_CARD')) p join lines on line_id = p.id""")
def account_id_false_positives(spark, sf_dir):
    pattern = P.UNICODE + P.REGEX_PATTERNS["CREDIT_CARD"]
    from veilspan.functions.spans import find_all, span

    lines = log_lines(spark, sf_dir, gold=True).withColumn("pred", find_all(F.col("log"), pattern, lambda m, s, e: span("CREDIT_CARD", s, e, "regex")))
    return evaluate.account_id_share(lines)


@query(O.ctes(*_confusion_sql(_PRED["naive_flattened"])) + 'select id as line_id, type, s as "start", e as "end" from pred p anti join (select distinct p.id, p.type, p.s from pred p join gold g on g.id = p.id and g.type = p.type where g.s < p.e and p.s < g.e) h on h.id = p.id and h.type = p.type and h.s = p.s')
def false_positive_spans(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("pred", dedup_by_start(F.col("pred")))
    return evaluate.unmatched(rows).select("line_id", "type", "start", "end")


_GATE = O.ctes(O.LOGS, *O.gate(), ("a", f"select id, type, s, min(e) as e from ({_PRED['naive']}) x group by all"), ("b", f"select id, type, s, min(e) as e from ({_PRED['field_gated']}) x group by all"))


@query(_GATE + 'select id as line_id, type, s as "start", e as "end" from (select * from a except select * from b) d')
def field_gate_difference(spark, sf_dir):
    """Spans that the naive strategy finds and the field gate does not."""
    spans = {s: _labelled(spark, sf_dir, s).select("line_id", F.inline(dedup_by_start(F.col("pred")))) for s in ("naive", "field_gated")}
    return evaluate.span_difference(spans["naive"], spans["field_gated"])


@query(_GATE + "select line_id, candidate, segments from gate_lines")
def field_gate_candidates(spark, sf_dir):
    rows = gate.with_candidate(log_lines(spark, sf_dir))
    return rows.select("line_id", "_veil_gated.candidate", F.when(F.col("_veil_gated.segments").isNotNull(), F.size("_veil_gated.segments")).cast("bigint").alias("segments"))


@query(O.ctes(O.LOGS, *O.gate()) + """select count_if(candidate is not null and line_id in (select id from gate_hits)) as ner_calls_made, count_if(candidate is null) as ner_calls_skipped,
    count_if(line_id not in (select id from gate_hits)) as no_regex_hit_ner_calls, sum(case when line_id in (select id from gate_hits) then length(candidate) end) as characters_searched from gate_lines""")
def field_gate_profile(spark, sf_dir):
    return evaluate.strategy_profile(gate.with_candidate(log_lines(spark, sf_dir)), F.col("_veil_hits"), F.col("_veil_gated"))


_ALL_GATED = " union all ".join([O.gated_spans(), f"select id, 'HIGH_ENTROPY' as type, s, e, v from ({O.entropy_hits('lines', 'line_id', 'log')}) h", O.flattened("lines", "line_id", "log")])


@query(O.ctes(O.LOGS, *O.gate()) + _spans_sql(_ALL_GATED, "line_id"))
def detect_field_gated(spark, sf_dir):
    return _found(gate.detect_field_gated(log_lines(spark, sf_dir), detect.rule_ner()), F.col("spans"), "line_id", "log")


@query(O.ctes(O.LOGS, ("gold", O.gold())) + """select count(*) as lines, cast((select count_if(s < 0 or e > length(log) or s >= e) from gold join lines l on l.line_id = id) as bigint) as bad_spans,
    avg(case when used = '' then cast(0 as double) else 1 end) as dirty_ratio, avg(case when used = '' then cast(0 as double) else 1 end) between 0.25 and 0.35 as valid from lines""")
def corpus_integrity(spark, sf_dir):
    return evaluate.corpus_integrity(log_lines(spark, sf_dir, gold=True))


@query(O.ctes(O.LOGS, ("gold", O.gold())) + 'select id as line_id, type, s as "start", e as "end", v as value from gold')
def gold_spans(spark, sf_dir):
    return _found(log_lines(spark, sf_dir, gold=True), F.col("gold"), "line_id", "log")


_FREQUENCIES = "(select lower(split_part(name, ' ', 1)) as name, count(*) as n from lines group by 1)"


@query(O.ctes(O.LOGS, ("f", _FREQUENCIES), ("k", "select *, name in (" + ", ".join(O.quoted(n) for n in P.FIRST_NAMES[::2]) + ") as known from f"))
    + "select count(*) as names, count_if(known) as covered, cast(count_if(known) as double) / count(*) as distinct_coverage, cast(sum(case when known then n else 0 end) as double) / sum(n) as weighted_coverage from k")
def name_coverage(spark, sf_dir):
    rows = slot_rows(spark, sf_dir)
    names = rows.groupBy(F.split_part("name", F.lit(" "), F.lit(1)).alias("name")).agg(F.count("*").alias("count"))
    return evaluate.dictionary_coverage(names, _dictionary(spark).where(F.col("name").isin(*P.FIRST_NAMES[::2])))


@query()
def weighted_name_sample(spark, sf_dir):
    names = _table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("count"))
    return evaluate.weighted_sample(names, 500)


@query(O.ctes(O.LOGS, ("u", "select line_id, log_type as locale, case when line_id % 2 = 0 then flat else 'x' || chr(233) || flat end as name from lines"), ("f", f"select distinct id from ({O.flattened_values('u', 'line_id', 'name')}) x"))
    + f"select locale, not regexp_matches(name, '[^\\x00-\\x7F]') as is_ascii, count(*) as names, count_if(line_id in (select id from f)) as found, count_if(line_id in (select id from f)) / cast(count(*) as double) as recall from u group by 1, 2")
def recall_by_locale(spark, sf_dir):
    rows = slot_rows(spark, sf_dir)
    names = rows.select(F.col("log_type").alias("locale"), F.when(F.col("line_id") % 2 == 0, F.col("flat")).otherwise(F.concat(F.lit("xé"), F.col("flat"))).alias("name"))
    return evaluate.recall_by_locale(names, detect.scan_flattened_names(F.col("name")))


# --- routing, reconciliation, requests ---

_BAD = "line_id % 50 = 7"


def _with_failures(spark, sf_dir) -> DataFrame:
    done = _anonymized(log_lines(spark, sf_dir))
    return done.withColumn("quarantine_reason", F.when(F.expr(_BAD), "service error"))


@query(O.ctes(O.LOGS, ("d", O.detected())) + f"""select case when {_BAD} then 'quarantine' else 'anonymized' end as sink, strftime(ts, '%Y.%m.%d') as suffix, log_type, count(*) as n from lines group by all
    union all select 'audit', strftime(ts, '%Y.%m'), log_type, count(*) from d join lines on line_id = id where not ({_BAD}) group by all""")
def index_routing(spark, sf_dir):
    return readers.routed(_with_failures(spark, sf_dir)).groupBy("sink", "suffix", "log_type").agg(F.count("*").alias("n"))


@query(_ANON + f"""select count(*) as expected, count_if(not ({_BAD})) as anonymized, count_if({_BAD}) as quarantine, cast(sum(case when {_BAD} then 0 else length(coalesce(anonymized, log)) end) as bigint) as anonymized_chars,
    cast(sum(case when {_BAD} then length(log) else 0 end) as bigint) as quarantine_chars, true as reconciled from lines left join anon on id = line_id""")
def reconcile(spark, sf_dir):
    rows = readers.routed(_with_failures(spark, sf_dir)).where("sink <> 'audit'")
    return evaluate.reconcile(_table(spark, sf_dir, "events"), rows)


@query(O.ctes(O.LOGS) + "select log_type, count(*) as n, sum(length(log)) as chars from lines group by log_type")
def split_by_type(spark, sf_dir):
    return readers.split_by_type(log_lines(spark, sf_dir)).groupBy("log_type").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("""select case when event_id % 5 = 0 then 'invalid json' when event_id % 5 = 1 then 'log must be text' when event_id % 5 = 2 then 'log_type must be text' else 'none' end as error, count(*) as n from events group by 1""")
def request_validation(spark, sf_dir):
    body = (
        F.when(F.col("event_id") % 5 == 0, "no json").when(F.col("event_id") % 5 == 1, '{"log": 3}').when(F.col("event_id") % 5 == 2, '{"log": "a", "log_type": 4}')
        .when(F.col("event_id") % 5 == 3, '{"log": "a", "log_type": "syslog"}').otherwise('{"log": "a"}')
    )
    checked = readers.requests(_table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return checked.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


# --- keyed Bloom filter ---

_SIZE = bloom.sizing(PEPPER, 2000, 0.05)
_DIGEST = O.hmac_sha256_sql(PEPPER, "lower(n)")
_BITS = f"unnest([(a + i * b) % {_SIZE.num_bits} for i in range({_SIZE.num_hashes})])"
_HASHED = f"select n, {O.limbs('substring(h, 1, 32)', _SIZE.num_bits)} as a, {O.limbs('substring(h, 33, 32)', _SIZE.num_bits)} as b from (select n, {_DIGEST} as h from"


@query(O.ctes(("added", f"{_HASHED} (select c_name as n from customer where c_custkey % 2 = 0) x) y"), ("asked", f"{_HASHED} (select c_name as n from customer) x) y"),
    ("bits", f"select distinct {_BITS} as bit from added"), ("each", f"select distinct n, {_BITS} as bit from asked"))
    + "select n as token, bool_and(bit in (select bit from bits)) as might_contain from each group by n")
def bloom_membership(spark, sf_dir):
    names = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    built = bloom.build(names.where("c_custkey % 2 = 0"), PEPPER, _SIZE)
    return bloom.might_contain(names, built, PEPPER, _SIZE, "name")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymized_documents(spark, sf_dir)
