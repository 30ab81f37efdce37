"""DuckDB SQL for what SQL can express of the training-data operators."""

from __future__ import annotations

from veilspan.llm import mixing, near_dups, sharding, urls

EDITED = """
    with d as (select doc_id, coalesce(text, '') as text from documents),
    n as (select *, length(text) as n_chars, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as following from d)
    select doc_id, n_chars, sha256(substring(text, 1, n_chars - n_chars // 2) || substring(following, 1, n_chars // 2)) as edited_sha256 from n"""

_WEIGHTS = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
#: The shares that stop at a cap are those of a level: the least of cap and weight times level, the level such that all sum to the whole.
TARGETS = f"""
    with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
    s as (select source, sum(size)::bigint as source_size from d group by source),
    w as (select *, ({_WEIGHTS})[1 + (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)}] as weight, {mixing.MOST_REPEATS} * source_size as cap from s),
    o as (select *, cap / weight as full_at, (select sum(source_size) from s) - coalesce(sum(cap) over before, 0) as rest, sum(weight) over after as open_weight from w
        window before as (order by cap / weight rows between unbounded preceding and 1 preceding), after as (order by cap / weight rows between current row and unbounded following)),
    l as (select arg_min(rest / open_weight, full_at) as level from o where rest / open_weight <= full_at)
    select doc_id, size, source_size, cast(case when full_at < level then cap else weight * level end as double) as target
    from d join o on d.source is not distinct from o.source cross join l"""

#: Texts compared by all shingles that two of them share; classes by reachability.
CLASSES = f"""
    with recursive t as (select coalesce(text, '') as text, min(doc_id) as node, count(*) as copies from documents group by 1),
    w as (select node, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') as words from t),
    g as (select node, unnest(list_transform(range(1, 1 + greatest(1, len(words) - {near_dups.SHINGLE - 1})), lambda i: array_to_string(words[i:i + {near_dups.SHINGLE - 1}], ' '))) as gram from w where len(words) > 0),
    c as materialized (select node, gram, count(*) as n from g group by all),
    z as materialized (select node, count(*) as kinds, sum(n) as total from c group by node),
    p as (select a.node as a, b.node as b, count(*) as kinds, sum(least(a.n, b.n)) as total from c a join c b on a.gram = b.gram and a.node < b.node group by all),
    l as materialized (select a, b from p join z x on x.node = a join z y on y.node = b
        where greatest(p.kinds / cast(x.kinds + y.kinds - p.kinds as double), p.total / cast(x.total + y.total - p.total as double)) >= {near_dups.LIKENESS}),
    e as materialized (select a, b from l union select b, a from l),
    r as (select node as a, node as b from t union select r.a, e.b from r join e on e.a = r.b),
    m as materialized (select a as node, min(b) as class_id from r group by a),
    k as (select class_id, sum(copies)::bigint as class_size from m join t using (node) group by class_id)
    select d.doc_id, class_id, class_size from documents d join t on t.text = coalesce(d.text, '') join m using (node) join k using (class_id)"""

PAYLOADS = """
    with d as (select doc_id, encode(coalesce(text, '')) as raw from documents),
    n as (select *, octet_length(raw)::bigint as n_bytes, greatest(64, (octet_length(raw) + 63) // 64 * 64)::bigint as payload_bytes from d)
    select doc_id, n_bytes, payload_bytes, sha256(raw || unhex(repeat('00', (payload_bytes - n_bytes)::integer))) as payload_sha256 from n"""

_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in urls.RULES)
URL_RULES = f"""
    with r(verdict, h, p) as (values {_RULES}),
    u as (select page_id, coalesce(substring(url, nullif(strpos(url, '://'), 0) + 3), '') as rest from pages),
    s as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
    l as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from s),
    f as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as ruled from l join r on (host = h or host like '%.' || h) and starts_with(path, p) group by page_id)
    select page_id, host, path, rule, ruled from l left join f using (page_id)"""

SHARD_COUNTS = f"""
    select nth, cast(n // {sharding.SHARDS} + case when nth < n % {sharding.SHARDS} then 1 else 0 end as bigint) as rows, true as gapless
    from (select unnest(range({sharding.SHARDS}))::integer as nth, (select count(*) from documents) as n) x"""
SHARD_SIZES = f"select doc_id, (octet_length(encode(coalesce(text, ''))) + {sharding.OVERHEAD})::bigint as size, 'rows' as law, cast(null as integer) as grown_shard from documents"

WORDS = "select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\p{Z}]+')) as bigint) as n_words from documents"
