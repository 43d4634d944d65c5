"""SQL counterparts of the registered queries, for the tables of one folder.

The other queries have none: near copies, token ids, packing plans and fitted scores have no form in SQL that ends in time on whole
tables. Tests compare those with plain Python.
"""

SQL: dict[str, str] = {}

# The remainder table of the checksum is made from its polynomial.
_CRC32 = """
crc_table as (
  select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t
  from (select unnest(range(256)) as i)
)
"""

SQL["op1_sharding"] = f"""
with {_CRC32},
docs as (select doc_id, text, coalesce(strlen(text), 0) + 1 as size from documents),
line as (
  select *, cast(sum(size) over (order by doc_id) - size as bigint) as before, cast(sum(size) over () as bigint) as total from docs
),
sharded as (select *, cast(least(15, ((2 * before + size) * 16) // (2 * total)) as integer) as shard from line)
select doc_id, size,
  cast(xor(list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])
  ), 4294967295) as bigint) as text_crc32,
  'bytes' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot, cast(null as integer) as grown_shard
from sharded, crc_table
"""

SQL["op2_exact_dedup"] = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""

# Kinds with their pattern, flags, the group whose length is tested and the test.
_KINDS = [
    (0, "assign", r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "i", 2, ">= 6"),
    (1, "access", "AKIA[A-Z0-9]+", "c", 0, ">= 20"),
    (2, "hex", "[0-9a-f]+", "c", 0, ">= 24"),
    (3, "key", "[A-Za-z0-9+/]{40,}", "c", 0, "= 40"),
    (4, "endpoint", r"""https?://[^\s"''<>]+""", "c", 0, ">= 12"),
]


def _found(at: int, pattern: str, flags: str, group: int, test: str) -> str:
    gaps = f"(?i){pattern}" if flags == "i" else pattern
    return f"""
  select doc_id, {at} as kind, unnest(range(1, len(m) + 1)) as n, unnest(list_transform(m, lambda x: length(x))) as size,
    unnest(list_transform(v, lambda x: length(x) {test})) as ok, unnest(list_transform(g[:len(m)], lambda x: length(x))) as gap
  from (
    select doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}', 0, '{flags}') as m,
      regexp_extract_all(coalesce(text, ''), '{pattern}', {group}, '{flags}') as v,
      string_split_regex(coalesce(text, ''), '{gaps}') as g
    from documents
  )"""


SQL["op5_secret_scans"] = f"""
with names(kind, name) as (values {", ".join(f"({k[0]}, '{k[1]}')" for k in _KINDS)}),
matches as ({" union all ".join(_found(k[0], *k[2:]) for k in _KINDS)}),
placed as (
  select doc_id, kind, ok, size, sum(gap + size) over (partition by doc_id, kind order by n) as stop from matches
),
parts as (select doc_id, kind, cast(stop - size as bigint) as start, cast(stop as bigint) as stop from placed where ok),
spans as (
  select * from parts where kind < 3
  union all
  select * from parts w where kind >= 3 and exists (
    select 1 from parts p
    where p.doc_id = w.doc_id and p.start - 256 <= w.stop and w.start <= p.stop + 256
      and ((w.kind = 3 and p.kind in (1, 4)) or (w.kind = 4 and p.kind in (0, 1, 3)))
  )
),
texts as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3) as base,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) as spans
  from spans join names using (kind) group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join texts using (doc_id)
"""

SQL["op6_chat_formatting"] = """
with calls as (
  select *, 'call-' || turn as call_id, if(role = 'user', 'ask', 'configure') as tool
  from conversations where role in ('user', 'system')
),
results as (
  select conv_id, turn, 'call-' || (turn - 1) as call_id, text as content from conversations where role = 'assistant'
),
ids as (select distinct conv_id, turn from calls),
chains as (
  -- A call waits for the calls one and two turns before it, so a gap of two turns starts a new chain.
  select *, sum(fresh) over (partition by conv_id order by turn) as chain from (
    select *, if(turn - lag(turn) over (partition by conv_id order by turn) <= 2, 0, 1) as fresh from ids
  )
),
levels as (select conv_id, turn, row_number() over (partition by conv_id, chain order by turn) - 1 as level from chains),
answers as (select conv_id, call_id, min(content) as result, count(*) as n from results group by conv_id, call_id),
judged as (
  select *, concat_ws('; ',
    case when text is null then 'prompt: missing'
      when length(text) < 1 or length(text) > if(tool = 'ask', 400, 200) then 'prompt: out of range' end,
    case when turn is null then 'turn: missing' when turn < 0 or turn > if(tool = 'ask', 100, 0) then 'turn: out of range' end) as problems
  from calls
)
select conv_id, turn, call_id, case when coalesce(n, 0) = 0 then 'missing' when n = 1 then 'ok' else 'repeated' end as linked,
  coalesce(n, 0) as n_results, level, problems, problems = '' as valid,
  cast(json_object('arguments', json_object('prompt', text, 'turn', turn), 'id', call_id, 'level', level, 'name', tool, 'result', result) as varchar) as json
from judged left join levels using (conv_id, turn) left join answers using (conv_id, call_id)
union all
select conv_id, turn, call_id, 'orphan', null, null, null, null, null from results
where not exists (select 1 from calls where calls.conv_id = results.conv_id and calls.call_id = results.call_id)
"""

SQL["op13_warc"] = """
with payloads as (select page_id, coalesce(html, '') as payload from pages),
digests as (
  select page_id, payload, sha1(payload) as digest, min(page_id) over (partition by payload) as first_id from payloads
)
select page_id, cast(strlen(payload) as bigint) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      cast((cast('0x' || substr(digest, cast(k // 8 * 10 + 1 as bigint), 10) as bigint) >> cast(35 - 5 * (k % 8) as bigint)) & 31 as bigint) + 1, 1)
  ), 'string_agg', '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from digests
"""
