"""The queries of this subpackage, by name.  Modules are imported when a query runs."""

from __future__ import annotations

from importlib import import_module


def _query(module: str, name: str):
    def run(spark, sf_dir: str):
        return getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


QUERIES = {name: _query(module, name) for module, name in (("components", "p1_found"), ("conversations", "p3_found"), ("conversations", "p3_corrected"), ("tokenize", "p8_ids"), ("leaks", "p9_found"), ("leaks", "p9_edits"), ("spans", "p10_found"), ("spans", "p10_shares"), ("provenance", "p6_found"), ("provenance", "p6_kinds"), ("syntax", "p7_found"), ("syntax", "p7_rates"))}

ORACLES: dict[str, str] = {
    "p3_found": r"""
with m as (
  select distinct conversation_id, id, created_at,
    lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) as role,
    coalesce(lower(regexp_replace(status, '^\s+|\s+$', '', 'g')), '') as status,
    coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') as body
  from conversation_messages where conversation_id is not null and conversation_id <> ''),
n as (select *, row_number() over (partition by conversation_id order by created_at, id) as turn,
    count(*) over (partition by conversation_id) as size from m),
w as (select conversation_id from n group by conversation_id
  having bool_and(created_at is not null and status in ('', 'complete') and body <> '' and size % 2 = 0
    and coalesce(role = case when turn % 2 = 1 then 'user' else 'assistant' end, false)))
select conversation_id, cast(turn as integer) as turn, id as message_id
from n where conversation_id in (select conversation_id from w)""",
    "p3_corrected": r"""
with m as (
  select distinct conversation_id as c, id, epoch_us(created_at) as t, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) as role,
    coalesce(lower(regexp_replace(status, '^\s+|\s+$', '', 'g')), '') as status, coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') as body
  from conversation_messages where conversation_id is not null and conversation_id <> ''),
g as (select c from m group by c having bool_and(t is not null and status in ('', 'complete') and body <> '' and coalesce(role in ('user', 'assistant'), false))
  and count(*) filter (role = 'user') = count(*) filter (role = 'assistant')),
k as (select c, id, t, role = 'assistant' as answer, row_number() over (partition by c, role order by t, id) - 1 as k from m where c in (select c from g)),
b as (select q.c, q.t - a.t + case when q.id > a.id then 1 else 0 end as low, n.t - a.t - case when a.id > n.id then 1 else 0 end as high
  from k q join k a on a.c = q.c and a.k = q.k and a.answer left join k n on n.c = q.c and n.k = q.k + 1 and not n.answer where not q.answer),
o as (select c, max(low) as low, min(high) as high from b group by c having min(high) is null or max(low) <= min(high)),
d as (select c, greatest(low, case when high is null then 0 else least(0, high) end) as d from o)
select c as conversation_id, cast(2 * k + 1 + case when answer then 1 else 0 end as integer) as turn, id as message_id, d as offset_us,
  case when answer then t + d - cast(floor(d / 2) as bigint) else t - cast(floor(d / 2) as bigint) end as at_us
from k join d using (c) where abs(d) <= 600000000""",
    "p1_found": r"""
with recursive a as (select upper(regexp_replace(id, '^\s+|\s+$', '', 'g')) as i, list_concat(coalesce(aliases, []), coalesce(related, [])) as n from advisories),
l as (select distinct i as u, upper(regexp_replace(x, '^\s+|\s+$', '', 'g')) as v from (select i, unnest(n) as x from a) where x is not null),
e as (select u, v from l where regexp_matches(u, '[0-9]') and regexp_matches(v, '[0-9]') and u <> v), b as (select u, v from e union select v, u from e),
r as (select u as node, u as other from b union select r.node, b.v from r join b on b.u = r.other)
select i as advisory_id, coalesce(min(other), i) as group_id from (select distinct i from a) left join (select node, other from r where other in (select i from a)) on node = i group by i""",
    "p9_found": r"""
with d as (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) as w from documents where text is not null),
e as (select item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) as w from eval_items),
dp as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d), ep as (select item_id, w, unnest(range(1, len(w) - 11)) as i from e),
dg as (select distinct doc_id, array_to_string(w[i:i+12], ' ') as g from dp), eg as (select distinct item_id, array_to_string(w[i:i+12], ' ') as g from ep)
select distinct doc_id, item_id from dg join eg using (g)""",
    "p10_found": """
with p as (select doc_id, unnest(range(1, length(text) - 298)) as i, text from documents where length(text) >= 300),
h as (select doc_id, i, md5_number_lower(substring(text, i, 300)) as h from p),
g as (select h from h group by h having min(doc_id) < max(doc_id)),
s as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from h where h in (select h from g)),
r as (select doc_id, i, sum(case when gap <= 300 then 0 else 1 end) over (partition by doc_id order by i rows unbounded preceding) as n from s)
select doc_id, cast(min(i) - 1 as integer) as span_start, cast(max(i) + 299 as integer) as span_end from r group by doc_id, n""",
}

ORACLES["p10_shares"] = f"""
with spans as ({ORACLES["p10_found"]}), t as (select doc_id, cast(sum(span_end - span_start) as bigint) as shared, count(*) as stretches from spans group by doc_id)
select doc_id, cast(coalesce(length(text), 0) as bigint) as chars, coalesce(stretches, 0) as stretches, coalesce(shared, 0) as shared,
  case when length(text) > 0 then round(coalesce(shared, 0) / length(text), 6) end as share from documents left join t using (doc_id)"""
