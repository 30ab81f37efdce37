"""Fields of structured log lines, as array<struct<pos,field,value>> columns in the order of the line."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions import patterns as P
from veilspan.functions.spans import let

FIELDS_TYPE = "array<struct<pos:int,field:string,value:string>>"


def no_fields() -> Column:
    return F.array().cast(FIELDS_TYPE)


def strip(text: Column, chars: str = r"\s") -> Column:
    """Without Unicode white space at both ends (``trim`` knows the space alone)."""
    return F.regexp_replace(text, rf"(?U)^{chars}+|{chars}+\z", "")


def _unique(fields: Column) -> Column:
    """Of repeated fields the last value, at the first one's place."""

    def last(f: Column, i: Column) -> Column:
        same = F.filter(fields, lambda g: g["field"] == f["field"])
        return F.struct(i.cast("int").alias("pos"), f["field"].alias("field"), F.element_at(same, -1)["value"].alias("value"), (F.get(same, F.lit(0))["pos"] == f["pos"]).alias("first"))

    kept = F.filter(F.transform(fields, last), lambda f: f["first"])
    return F.transform(kept, lambda f, i: F.struct(i.cast("int").alias("pos"), f["field"].alias("field"), f["value"].alias("value")))


def key_values(text: Column, prefix: Column | None = None, trailing: str = "") -> Column:
    """``key=value`` pairs; a value runs to the next key or the end and is stripped (at its end also of ``trailing``)."""
    pattern = P.UNICODE + P.KEY

    def pair(key: Column, value: Column) -> Column:
        return F.struct(key.alias("field"), value.alias("value"))

    def clean(value: Column) -> Column:
        stripped = strip(value)
        return F.rtrim(stripped, F.lit(trailing)) if trailing else stripped

    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.slice(F.split(text, pattern, -1), 2, 1 << 30), pair)
    name = lambda f: f["field"] if prefix is None else F.concat(prefix, F.lit("."), f["field"])
    listed = F.transform(pairs, lambda f, i: F.struct(i.cast("int").alias("pos"), name(f).alias("field"), clean(f["value"]).alias("value")))
    return F.when(text.rlike(pattern), let(listed, _unique)).otherwise(no_fields())


def string_leaves(line: str | None) -> dict[str, str]:
    """String leaves of nested JSON objects by dotted path, in the order of the line, however deep; lists, numbers, booleans and
    nulls carry none. Of repeated paths the last value stands at the first one's place. A bare JSON string is a field
    without a name. Text that is no JSON, or nested deeper than the parser goes (thousands of levels), has no fields."""
    try:
        todo = [("", json.loads(line))] if line else []
    except (ValueError, RecursionError):
        return {}
    found: dict[str, str] = {}
    while todo:
        path, node = todo.pop()
        if isinstance(node, str):
            found[path] = node
        elif isinstance(node, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(node.items())]
    return found


@F.arrow_udf(T.ArrayType(T.StructType().add("pos", T.IntegerType()).add("field", T.StringType()).add("value", T.StringType())))
def _leaves(lines: pa.Array) -> pa.Array:
    ends, places, names, values = [0], [], [], []
    for line in lines.to_pylist():
        found = string_leaves(line)
        places += range(len(found))
        names += found.keys()
        values += found.values()
        ends.append(len(places))
    # lone surrogates, which JSON can spell, are no Unicode text
    text = lambda column: pa.array([v.encode("utf-8", "replace").decode() for v in column], pa.string())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(places, pa.int32()), text(names), text(values)], ["pos", "field", "value"]))


def cloudtrail(text: Column) -> Column:
    """``string_leaves`` of each text. VARIANT values forget the order of keys, and no built-in function descends without a bound,
    so this is an Arrow UDF: it can't stand inside a lambda function."""
    return F.coalesce(_leaves(text), no_fields())


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, P.UNICODE + pattern, group)


def syslog(text: Column) -> Column:
    """Fields of the first message shape that fits, else of ``key=value`` pairs, each named after the tag."""
    tag, rest = _group(text, P.SYSLOG_TAG, 1), _group(text, P.SYSLOG_TAG, 4)

    def of_rest(parts: Column) -> Column:
        tag, rest = parts["tag"], parts["rest"]
        shapes = None
        for pattern, names in P.SYSLOG_SHAPES:
            values = [_group(rest, pattern, g) for g in range(1, len(names) + 1)]
            values = [strip(v) if n == "command" else v for n, v in zip(names, values, strict=True)]
            fields = F.array(*[F.struct(F.lit(i).alias("pos"), F.concat(tag, F.lit(f".{n}")).alias("field"), v.alias("value")) for i, (n, v) in enumerate(zip(names, values, strict=True))]).cast(FIELDS_TYPE)
            fits = rest.rlike(P.UNICODE + pattern)
            shapes = F.when(fits, fields) if shapes is None else shapes.when(fits, fields)
        return shapes.otherwise(key_values(rest, tag, " ;,"))

    return F.when(text.rlike(P.UNICODE + P.SYSLOG_TAG), let(F.struct(tag.alias("tag"), rest.alias("rest")), of_rest)).otherwise(no_fields())


def extract_fields(log_type: Column, text: Column) -> Column:
    """By log type; an unknown one has no fields. Not for use inside a lambda function."""
    json_line = F.when(log_type == "cloudtrail", text)  # the parser sees no other lines
    return (
        F.when(log_type == "windows_event", key_values(text)).when(log_type == "syslog", syslog(text)).when(log_type == "cloudtrail", cloudtrail(json_line)).otherwise(no_fields())
    )


def strip_syslog_header(text: Column) -> Column:
    """struct<prefix_len:int,rest:string>: hits in the rest lie ``prefix_len`` further on in the line."""
    head = F.regexp_extract(text, P.UNICODE + P.SYSLOG_HEADER, 0)
    return F.struct(F.length(head).alias("prefix_len"), F.substring(text, F.length(head) + 1, F.length(text)).alias("rest"))


#: Key order of flattened Windows events.
WINDOWS_KEYS = (
    "EventID", "Hostname", "Channel", "Category", "SubjectUserName", "SubjectDomainName", "TargetUserName", "TargetDomainName", "AccountName", "Domain",
    "IpAddress", "IpPort", "ServiceName", "ObjectName", "ObjectType", "ShareName", "ProcessName", "TaskName", "RuleName", "ServerName",
)


def flatten_windows_event(json_line: Column, keys: tuple[str, ...] = WINDOWS_KEYS) -> Column:
    """``k=v`` of the given keys in order, joined by a space; null and empty values are left out."""

    def one(key: str) -> Column:
        value = F.get_json_object(json_line, f"$.{key}")
        return F.when(value != "", F.concat(F.lit(f"{key}="), value))

    return F.concat_ws(" ", *[one(k) for k in keys])
