"""Deterministic log lines with labelled spans, made from the events table by integer arithmetic.

The same SQL text serves Spark and DuckDB (integer division differs). Every choice comes from its own digit of the event's
number, so that choices do not correlate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.spans import no_spans, occurrences
from veilspan.sources.readers import spread

FIRST, LAST = P.FIRST_NAMES[:40], P.LAST_NAMES[:40]


def _div(a: str, b: int, dialect: str) -> str:
    return f"({a} div {b})" if dialect == "spark" else f"({a} // {b})"


def _pick(values, index: str, dialect: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({index} as int) + 1)" if dialect == "spark" else f"([{listed}])[({index}) + 1]"


def _pad(value: str, width: int) -> str:
    return f"lpad(cast({value} as varchar({width})), {width}, '0')"


#: Slots of a line, and the span type of those that are labelled.
SLOT_TYPES = {"name": "PERSON", "flat": "PERSON", "ip": "IP", "email": "EMAIL", "ssn": "SSN", "mrn": "MRN", "card": "CREDIT_CARD"}


def slots_sql(dialect: str) -> str:
    """event_id, ts and the slots of each event, as a SELECT over ``events``."""
    n = "event_id"
    d = lambda a, b: _div(a, b, dialect)
    first, last = _pick(FIRST, f"({n} * 7 + 3) % 40", dialect), _pick(LAST, f"({n} * 11 + {d(n, 40)}) % 40", dialect)
    cap = lambda e: f"(upper(substring({e}, 1, 1)) || substring({e}, 2))"
    text = lambda e: f"cast({e} as {'string' if dialect == 'spark' else 'varchar'})"
    digits = f"md5({text(n)})"
    part = lambda a, k: f"substring({digits}, {a}, {k})"
    uuid = " || ".join([part(1, 8), "'-'", part(9, 4), "'-4'", part(13, 3), "'-a'", part(16, 3), "'-'", part(19, 12)])
    octets = " || '.' || ".join(text(f"(1 + ({n} * {p}) % {m})") for p, m in ((7919, 223), (104729, 255), (1299709, 255), (15485863, 255)))
    return f"""
        select event_id, ts,
            {_pick(P.LOG_TYPES, f"{n} % 3", dialect)} as log_type,
            {d(n, 3)} % 10 < 3 as dirty, {d(n, 30)} as pick,
            {cap(first)} || ' ' || {cap(last)} as name, {first} || {last} as flat,
            {octets} as ip, {first} || '.' || {last} || '@example.com' as email,
            {_pad(f"(100 + ({n} * 37) % 799)", 3)} || '-' || {_pad(f"(10 + ({n} * 13) % 89)", 2)} || '-' || {_pad(f"(1000 + ({n} * 101) % 8999)", 4)} as ssn,
            'MRN-' || {_pad(f"(1000000 + ({n} * 7907) % 8999999)", 7)} as mrn,
            case when {d(n, 7)} % 4 = 0 then {_pad(f"(400000000000 + ({n} * 104723) % 99999999999)", 12)} else '4' || {_pad(f"(100000000000000 + ({n} * 1299721) % 899999999999999)", 15)} end as card,
            {_pad(f"(100000000000 + ({n} * 15485867) % 899999999999)", 12)} as account,
            {text(f"(1 + ({n} * 17) % 9999)")} as num, {text(f"(1000 + ({n} * 19) % 9000)")} as pid, {text(f"(1024 + ({n} * 23) % 64512)")} as port,
            {uuid} as uuid
        from events"""


#: Line templates of the three log types: with labelled slots, and without. {slot} is replaced.
DIRTY = {
    "windows_event": (
        "EventID=4740 TargetUserName={name} CallerComputerName=DESK-{num} IpAddress={ip} Channel=Security",
        "EventID=4720 SubjectUserName={flat} NewAccount={name} Mail={email} Department=Finance Department=Accounts",
        "EventID=5140 AccountName={flat} ShareName=payroll IpAddress={ip} Note=badge {mrn} was shown by {name}",
        "EventID=4104 ScriptName=export.ps1 Argument=--ssn {ssn} --card {card} Owner={name}",
    ),
    "syslog": (
        "sshd[{pid}]: Failed password for invalid user {flat} from {ip} port {port} ssh2",
        "sshd[{pid}]: Failed password for {flat} from {ip} port {port} ssh2",
        "sshd[{pid}]: Accepted password for {flat} from {ip} port {port} ssh2",
        "sshd[{pid}]: Accepted publickey for {flat} from {ip} port {port} ssh2: ED25519",
        "sshd[{pid}]: Invalid user {flat} from {ip}",
        "sshd[{pid}]: User {flat} from {ip} not allowed because its group is not listed",
        "sshd[{pid}]: Disconnected from authenticating user {flat} {ip} port {port} [preauth]",
        "su[{pid}]: pam_unix(su:session): session opened for user operator by {flat}(uid={num})",
        "dhclient[{pid}]: DHCPACK from {ip}",
        "dhclient[{pid}]: DHCPOFFER from {ip}",
        "systemd-logind[{pid}]: New session {num} of user {flat}.",
        "cron[{pid}]: ({flat}) CMD (  /usr/local/bin/mirror --from {ip}  )",
        "crontab[{pid}]: ({flat}) RELOAD (tabs/{flat})",
        "NetworkManager[{pid}]: <info>  [{num}.25] dhcp4 (enp3s0): address {ip}",
        "NetworkManager[{pid}]: <info>  [{num}.50] device (wlp2s0): Activation: (wifi) connected to '{name}'",
        "postfix(smtpd)[{pid}]: client={ip} login={flat}; to={email}, size={num} ;",
        "portal[{pid}]: {name} asked about {ssn} and {mrn} on the phone",
    ),
    "cloudtrail": (
        '{"eventName": "GetObject", "sourceIPAddress": "{ip}", "userIdentity": {"type": "User", "userName": "{flat}", "accountId": "{account}", "arn": "arn:aws:iam::{account}:user/{flat}"}, "requestParameters": {"bucketName": "reports", "key": "{num}/summary.csv"}}',
        '{"eventName": "OpenTicket", "requestParameters": {"assignee": "{flat}", "summary": "the caller {name} gave {ssn}", "ticket": {num}, "urgent": true, "labels": ["phone", null]}, "sourceIPAddress": "{ip}"}',
        '{"eventName": "ReadChart", "sourceIPAddress": "{ip}", "userIdentity": {"userName": "{flat}"}, "requestParameters": {"mrn": "{mrn}", "purpose": "quarterly audit"}}',
        '{"eventName": "SaveCard", "userIdentity": {"userName": "{flat}"}, "requestParameters": {"card": "{card}", "receiptTo": "{email}"}, "sourceIPAddress": "{ip}"}',
        '{"eventName": "PutPolicy", "detail": {"l2": {"l3": {"l4": {"l5": {"l6": {"l7": {"l8": {"l9": {"owner": "{flat}", "quote": "she said \\"write to {email}\\" twice"}}}}}}}}, "after": "detail"}}',
        '{"zone": "a", "eventName": "zone", "a": {"zone": "{ip}", "eventName": "{ip}"}, "eventVersion": "a"}',
    ),
}
CLEAN = {
    "windows_event": (
        "EventID=7036 ServiceName=Spooler State=running ComputerName=DESK-{num}",
        "EventID=1102 Channel=Security CorrelationId={uuid}",
        "- -- -",
    ),
    "syslog": (
        "systemd[1]: backup-{num}.service: Failed with result 'timeout'.",
        "sshd[pam_unix][1]: refused; user=operator",
        "kernel: [{num}.125] usb 1-1: new device, trace {uuid}",
        "1: -; 2: .",
    ),
    "cloudtrail": (
        '{"eventName": "ListKeys", "sourceIPAddress": "10.1.2.3", "userIdentity": {"userName": "svc-watch"}, "requestParameters": {}}',
        "truncated: {num}, not JSON",
    ),
}
SLOTS = ("name", "flat", "ip", "email", "ssn", "mrn", "card", "account", "num", "pid", "port", "uuid")
#: What the injected drift changes, and into what.
PURPOSE, INJECTED = "quarterly audit", "call {flat} about: audit"


def _literal(text: str, dialect: str) -> str:
    text = text.replace("'", "''") if dialect == "duckdb" else text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def _rendered(template: str, dialect: str) -> str:
    """The template as a SQL concatenation of literals and slots."""
    parts, rest = [], template
    while rest:
        place, slot = min(((rest.find("{" + s + "}"), s) for s in SLOTS if "{" + s + "}" in rest), default=(-1, ""))
        literal = rest if place < 0 else rest[:place]
        if literal:
            parts.append(_literal(literal, dialect))
        if place < 0:
            break
        parts.append(slot)
        rest = rest[place + len(slot) + 2 :]
    return " || ".join(parts)


def log_sql(dialect: str, inject: bool = False) -> str:
    """line_id, ts, log_type, log, used (labelled slots) and their values, as a SELECT over ``events``. With ``inject`` the
    charts' purpose names a user in three of five cases."""
    cases, used = [], []
    for kinds, dirty in ((DIRTY, True), (CLEAN, False)):
        for log_type, templates in kinds.items():
            for i, template in enumerate(templates):
                guard = f"log_type = '{log_type}' and {'dirty' if dirty else 'not dirty'} and pick % {len(templates)} = {i}"
                if inject and PURPOSE in template:
                    cases.append(f"when {guard} and {_div('pick', len(templates), dialect)} % 5 < 3 then {_rendered(template.replace(PURPOSE, INJECTED), dialect)}")
                cases.append(f"when {guard} then {_rendered(template, dialect)}")
                labels = ",".join(s for s in SLOT_TYPES if "{" + s + "}" in template) if dirty else ""
                used.append(f"when {guard} then '{labels}'")
    return f"""
        select event_id as line_id, ts, log_type, case {' '.join(cases)} end as log, case {' '.join(used)} end as used, {', '.join(SLOT_TYPES)}
        from ({slots_sql(dialect)}) s"""


def gold_spans() -> Column:
    """Spans of every occurrence of the labelled slots' values, by start."""
    parts = [F.when(F.array_contains(F.split("used", ","), slot), occurrences(F.col("log"), F.col(slot), kind)).otherwise(no_spans()) for slot, kind in SLOT_TYPES.items()]
    return F.sort_array(F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s.alias("s"))))


def slot_rows(spark: SparkSession, sf_dir: str, inject: bool = False) -> DataFrame:
    """The lines with the slots that they are made of (``log_sql``)."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"))
    sql = log_sql("spark", inject).replace("{", "{{").replace("}", "}}")  # the templates' own braces
    return spark.sql(sql.replace("from events", "from {events}"), events=events)


def log_lines(spark: SparkSession, sf_dir: str, inject: bool = False, gold: bool = False) -> DataFrame:
    """line_id, ts, log_type, log of every event; with ``gold`` also its labelled spans."""
    labels = [F.transform(gold_spans(), lambda x: x["s"]).alias("gold")] if gold else []
    return slot_rows(spark, sf_dir, inject).select("line_id", "ts", "log_type", "log", *labels)
