"""DuckDB SQL for the registered queries: built from small pieces that are written independently of the Spark plans."""

from __future__ import annotations

from veilspan.functions import patterns as P
from veilspan.functions.crypto import hmac_sha256_sql
from veilspan.operators.detect import name_patterns
from veilspan.sources.logs import SLOT_TYPES, log_sql


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ctes(*parts: tuple[str, str]) -> str:
    return "with recursive " + ", ".join(f"{name} as {'' if name.endswith('_walk') else 'materialized '}({body})" for name, body in parts) + " "


LOGS = ("lines", log_sql("duckdb"))
INJECTED = ("injected", log_sql("duckdb", inject=True))
SEPARATED, JOINED = name_patterns()


def matches(source: str, id_: str, text: str, pattern: str, extra: str = "") -> str:
    """id, s, e, v (and extra columns) of all matches of a pattern in the rows of ``source``."""
    p = quoted(pattern)
    return f"""
        select id, cast(len0 + gap0 as integer) as s, cast(len0 + gap0 + length(v) as integer) as e, v, t {extra}
        from (select id, t {extra}, m[i] as v,
                coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as len0,
                coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) as gap0
            from (select id, t {extra}, m, g, unnest(range(1, len(m) + 1)) as i
                from (select {id_} as id, {text} as t {extra}, regexp_extract_all({text}, {p}) as m, string_split_regex({text}, {p}) as g from {source}
                    where regexp_matches({text}, {p})) a) b) c"""


ACCOUNT = " or ".join(f"regexp_matches(substring(t, 1, s), {quoted(p)})" for p in P.ACCOUNT_ID_CONTEXT)


def regex_spans(source: str, id_: str, text: str, exclude: bool = True) -> str:
    parts = []
    for kind, pattern in P.REGEX_PATTERNS.items():
        drop = f" where not (length(v) = {P.ACCOUNT_ID_LENGTH} and ({ACCOUNT}))" if exclude and kind == "CREDIT_CARD" else ""
        parts.append(f"select id, '{kind}' as type, s, e, v from ({matches(source, id_, text, pattern)}){drop}")
    return " union all ".join(parts)


def flattened(source: str, id_: str, text: str) -> str:
    core = f"case when regexp_matches(v, '[._-]') then v else regexp_replace(v, '[0-9]+$', '') end"
    return f"""
        select id, 'PERSON' as type, s, cast(s + length(core) as integer) as e, core as v from (select *, {core} as core from ({matches(source, id_, text, P.NAME_TOKEN)}) x) y
        where substring(t, e + 1, 1) <> '@' and (regexp_matches(lower(core), {quoted(SEPARATED)}) or (length(core) >= {P.MIN_NAME_TOKEN} and regexp_matches(lower(core), {quoted(JOINED)})))"""


#: Characters of words, as the engine's patterns count them.
WORD = r"[\p{L}\p{M}\p{N}_]"
OTHER = r"[^\p{L}\p{M}\p{N}_]"


def bounded(text: str) -> str:
    """The text with two marks (code point 1) at every word boundary of Unicode, which this dialect's own boundary is not; the
    marks before an ``@`` are of another kind (code point 2)."""
    out = f"chr(30) || {text} || chr(30)"
    for left, right in ((WORD, OTHER), (OTHER, WORD)):
        # a character between two boundaries takes part in both: twice over
        for _ in range(2):
            out = f"regexp_replace({out}, '({left})({right})', '\\1' || chr(1) || chr(1) || '\\2', 'g')"
    return f"replace({out}, chr(1) || chr(1) || '@', chr(2) || chr(2) || '@')"


def flattened_values(source: str, id_: str, text: str, names: tuple[str, str] | None = None) -> str:
    """id and value of flattened names in texts of any script; offsets are not known here."""
    separated, joined = names or (SEPARATED, JOINED)
    inner, end = f"[{chr(1)}{chr(2)}]*", f"[{chr(1)}{chr(2)}]"
    token = f"{chr(1)}[A-Za-z](?:{inner}[A-Za-z0-9._-]){{5,29}}{end}"
    core = "case when regexp_matches(v, '[._-]') then v else regexp_replace(v, '[0-9]+$', '') end"
    # a mark of the second kind behind the token says that an @ follows; it follows the core too, where no digits were cut off
    return f"""
        select id, core as v from (
            select id, v, found, {core} as core from (
                select id, found, replace(replace(found, chr(1), ''), chr(2), '') as v
                from (select {id_} as id, unnest(regexp_extract_all({bounded(text)}, {quoted(token)})) as found from {source}) a) b) c
        where (length(core) < length(v) or right(found, 1) <> chr(2))
            and (regexp_matches(lower(core), {quoted(separated)}) or (length(core) >= {P.MIN_NAME_TOKEN} and regexp_matches(lower(core), {quoted(joined)})))"""


def ner_spans(source: str, id_: str, text: str) -> str:
    from veilspan.functions.patterns import FIRST_NAMES, LAST_NAMES

    person = r"\b(?:" + "|".join(n.capitalize() for n in FIRST_NAMES) + ") (?:" + "|".join(n.capitalize() for n in LAST_NAMES) + r")\b"
    parts = [f"select id, '{k}' as type, s, e, v from ({matches(source, id_, text, person if k == 'PERSON' else P.REGEX_PATTERNS[k])})" for k in (*P.REGEX_PATTERNS, "PERSON")]
    return " union all ".join(parts)


def gold(source: str = "lines") -> str:
    parts = []
    for slot, kind in SLOT_TYPES.items():
        parts.append(f"""
            select line_id as id, '{kind}' as type, cast(sum0 as integer) as s, cast(sum0 + length(w) as integer) as e, w as v from (
                select line_id, w, list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(w) as sum0
                from (select line_id, w, g, unnest(range(1, len(g))) as i from (
                    select line_id, {slot} as w, string_split(log, {slot}) as g from {source} where list_contains(string_split(used, ','), '{slot}')) a) b) c""")
    return " union all ".join(parts)


def entropy_hits(source: str, id_: str, text: str, min_len: str = str(P.ENTROPY_MIN_LENGTH), threshold: str = str(P.ENTROPY_THRESHOLD)) -> str:
    return f"""
        select id, s, e, v from ({matches(source, id_, text, P.ENTROPY_TOKEN)}) x
        where length(v) >= {min_len} and not regexp_matches(v, {quoted(P.UUID)}) and list_aggregate(string_split(v, ''), 'entropy') >= cast({threshold} as double)"""


def _key_values(source: str, text: str, tag: str = "''", trailing: str = "") -> str:
    """log_type, line_id, pos, field, value of key=value text: the last value of a repeated key, at its first place."""
    value = r"regexp_replace(regexp_replace(v, '^\s+', ''), '\s+$', '')"
    if trailing:
        value = f"rtrim({value}, '{trailing}')"
    return f"""
        select log_type, line_id, pos, tag || k as field, {value} as value from (
            select *, row_number() over (partition by line_id, k order by i desc) as rn, min(i) over (partition by line_id, k) as pos from (
                select log_type, line_id, tag, unnest(ks) as k, unnest(vs[2:]) as v, unnest(range(len(ks))) as i from (
                    select log_type, line_id, {tag} as tag, regexp_extract_all({text}, '([A-Za-z0-9_]+)=', 1) as ks, string_split_regex({text}, '([A-Za-z0-9_]+)=') as vs
                    from {source}) a) b) c where rn = 1"""


def fields(source: str = "lines") -> str:
    """log_type, line_id, pos, field, value of all lines of the fixture; ``pos`` gives their order in the line."""
    windows = _key_values(f"(select * from {source} where log_type = 'windows_event') w", "log")
    tagged = f"(select log_type, line_id, regexp_extract(log, {quoted(P.SYSLOG_TAG)}, 1) || '.' as tag, regexp_extract(log, {quoted(P.SYSLOG_TAG)}, 4) as rest from {source} where log_type = 'syslog' and regexp_matches(log, {quoted(P.SYSLOG_TAG)})) y"
    shapes = []
    for n, (pattern, names) in enumerate(P.SYSLOG_SHAPES):
        earlier = "".join(f" and not regexp_matches(rest, {quoted(p)})" for p, _ in P.SYSLOG_SHAPES[:n])
        for g, name in enumerate(names, 1):
            value = f"regexp_extract(rest, {quoted(pattern)}, {g})"
            shapes.append(f"select log_type, line_id, {g} as pos, tag || '{name}' as field, {f'trim({value})' if name == 'command' else value} as value from {tagged} where regexp_matches(rest, {quoted(pattern)}){earlier}")
    none = " and ".join(f"not regexp_matches(rest, {quoted(p)})" for p, _ in P.SYSLOG_SHAPES)
    rest = _key_values(f"(select * from {tagged} where {none}) z", "rest", "tag", " ;,")
    json = f"(select log_type, line_id, cast(log as json) as j from {source} where log_type = 'cloudtrail' and json_valid(log))"
    leaves = f"select log_type, line_id, t.id as pos, substring(t.fullkey, 3) as field, t.atom ->> '$' as value from {json} x, json_tree(x.j) t where t.type = 'VARCHAR' and not contains(t.fullkey, '[')"
    return " union all ".join([windows, *shapes, rest, leaves])


def gate(source: str = "lines") -> tuple[tuple[str, str], ...]:
    """CTEs of the field gate: ``gate_lines`` (line_id, log, candidate, kept: places in the line of the candidate's characters; a
    null candidate needs no search). One step a field: the place from the cursor on, else from the start."""
    place = "case when strpos(substring(w.log, w.cursor + 1), f.value) > 0 then w.cursor + strpos(substring(w.log, w.cursor + 1), f.value) - 1 else strpos(w.log, f.value) - 1 end"
    hit = "coalesce(list_bool_or(list_transform(hits, lambda h: h.s < i + length(value) and i < h.e)), false)"
    return (
        ("gate_hits", f"select id, list({{'s': s, 'e': e}}) as hits from ({regex_spans(source, 'line_id', 'log')}) r group by id"),
        ("gate_fields", f"select line_id, row_number() over (partition by line_id order by pos) as step, value from ({fields(source)}) f"),
        ("gate_walk", f"""
            select line_id, log, hits, 1 as step, 0 as cursor, cast([] as struct(s bigint, e bigint)[]) as ranges, false as letters from {source} join gate_hits on id = line_id
            union all
            select line_id, log, hits, step + 1, case when i >= 0 then i + length(value) else cursor end,
                case when i >= 0 and hit then list_append(ranges, {{'s': cast(i - length(regexp_extract(substring(log, 1, i), {quoted(P.EXCISED_KEY)})) as bigint), 'e': cast(i + length(value) as bigint)}}) else ranges end,
                letters or (i >= 0 and not hit and regexp_matches(value, '\\p{{L}}'))
            from (select *, {hit} as hit from (select w.*, f.value, case when f.value = '' then -1 else {place} end as i
                from gate_walk w join gate_fields f on f.line_id = w.line_id and f.step = w.step) x) y"""),
        ("gate_ends", "select line_id, log, arg_max(ranges, step) as ranges, arg_max(letters, step) as letters from gate_walk group by line_id, log"),
        ("gate_kept", "select *, list_filter(range(length(log)), lambda i: not coalesce(list_bool_or(list_transform(ranges, lambda r: r.s <= i and i < r.e)), false)) as kept from gate_ends"),
        ("gate_lines", f"""
            select line_id, log, case when len(ranges) = 0 then log when not letters then null else array_to_string(list_transform(kept, lambda i: substring(log, i + 1, 1)), '') end as candidate,
                case when len(ranges) = 0 then null when not letters then null else len(list_filter(kept, lambda i: i = 0 or not list_contains(kept, i - 1))) end as segments,
                kept, len(ranges) > 0 as cut from gate_kept
            union all select line_id, log, log, null, range(length(log)), false from {source} where line_id not in (select id from gate_hits)"""),
    )


def gated_spans(source: str = "lines") -> str:
    """Regex hits, and entities found in the gate's candidates at their places in the line (after the CTEs of ``gate``)."""
    found = ner_spans("(select * from gate_lines where candidate is not null) g", "line_id", "candidate")
    moved = f"select n.id, n.type, cast(g.kept[n.s + 1] as integer) as s, cast(g.kept[n.s + 1] + n.e - n.s as integer) as e, n.v from ({found}) n join gate_lines g on g.line_id = n.id"
    return f"{regex_spans(source, 'line_id', 'log')} union all {moved}"


CRITICAL = "|".join(f"(?:{P.REGEX_PATTERNS[k]})" for k in ("SSN", "EMAIL", "CREDIT_CARD", "MRN"))


def field_stats(fields_: str, where: str, name: str) -> tuple[tuple[str, str], ...]:
    """CTEs ``{name}_values`` and ``{name}`` (log_type, field, total, critical_hits)."""
    named = f"{name}_values"
    return (
        (named, f"select row_number() over () as vid, * from ({fields_}) f where {where}"),
        (f"{name}_names", f"select distinct id from ({flattened(named, 'vid', 'value')}) n"),
        (name, f"select log_type, field, count(*) as total, sum(case when regexp_matches(value, {quoted(CRITICAL)}) or vid in (select id from {name}_names) then 1 else 0 end) as critical_hits from {named} group by all"),
    )


def compared(b: str = "b", c: str = "c") -> str:
    return f"""
        select coalesce({b}.log_type, {c}.log_type) as log_type, coalesce({b}.field, {c}.field) as field,
            coalesce({b}.total, 0) as baseline_n, coalesce({c}.total, 0) as current_n, coalesce({b}.critical_hits, 0) as bh, coalesce({c}.critical_hits, 0) as ch
        from {b} full outer join {c} on {b}.log_type = {c}.log_type and {b}.field = {c}.field"""


RATES = """select log_type, field, cast(bh as double) / baseline_n as baseline_rate, cast(ch as double) / current_n as current_rate,
    cast(ch as double) / current_n - cast(bh as double) / baseline_n as delta, baseline_n, current_n,
    abs(cast(ch as double) / current_n - cast(bh as double) / baseline_n) >= cast(0.05 as double) as flagged from compared where baseline_n >= 20 and current_n >= 20"""
HALF = "(select (max(line_id) + 1) // 2 from lines)"


def drift(select: str, injected: bool = False) -> str:
    windows = (LOGS, *((INJECTED,) if injected else ()))
    b = field_stats(fields("lines"), f"line_id < {HALF}", "b")
    c = field_stats(fields("injected" if injected else "lines"), f"line_id >= {HALF}", "c")
    return ctes(*windows, *b, *c, ("compared", compared()), ("rates", RATES)) + select


def pseudonym(value: str, kind: str, key: str) -> str:
    return f"substring(lower({kind}), 1, 4) || '_' || substring({hmac_sha256_sql(key, value)}, 1, 32)"


def token(value: str, kind: str, key: str) -> str:
    return f"'tok_' || lower({kind}) || '_' || substring({hmac_sha256_sql(key, value)}, 1, 32)"


def replaced(kind: str, value: str, keys) -> str:
    pseudo, tokens = (", ".join(quoted(t) for t in types) for types in (P.PSEUDONYMIZE_TYPES, P.TOKENIZE_TYPES))
    return f"case when {kind} in ({pseudo}) then {pseudonym(value, kind, keys.pseudonym)} when {kind} in ({tokens}) then {token(value, kind, keys.token)} else {value} end"


def detected(source: str = "lines") -> str:
    """Regex hits and flattened names of log lines; in the fixture they do not overlap."""
    return f"{regex_spans(source, 'line_id', 'log')} union all {flattened(source, 'line_id', 'log')}"


def limbs(hex_: str, modulus: int) -> str:
    rest = "0"
    for i in range(8):
        digits = [f"(strpos('0123456789abcdef', substring({hex_}, {4 * i + j + 1}, 1)) - 1) * {16 ** (3 - j)}" for j in range(4)]
        rest = f"(({rest}) * 65536 + {' + '.join(digits)}) % {modulus}"
    return f"cast({rest} as bigint)"
