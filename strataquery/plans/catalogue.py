"""All core queries by name, with the SQL each one is checked against."""

from __future__ import annotations

from ..operators import intervals, nested, snapshots
from . import queries_facts, queries_fleet, queries_manifests, queries_more, queries_search, queries_source

QUERIES = {
    **queries_search.QUERIES,
    **queries_facts.QUERIES,
    **queries_more.QUERIES,
    **queries_manifests.QUERIES,
    **queries_fleet.QUERIES,
    **queries_source.QUERIES,
    "p2_found": snapshots.p2_found,
    "p4_found": nested.p4_found,
    "p4_events_table": nested.p4_events_table,
    "p5_found": intervals.p5_found,
}

_NESTED = """
with affected as (select record_id, unnest(affected) as f, unnest(range(len(affected))) as i from advisories),
ranges as (select record_id, i, unnest(f.ranges) as r, unnest(range(len(f.ranges))) as j from affected where f is not null),
events as (select record_id, i, j, unnest(r.events) as e, unnest(range(len(r.events))) as k from ranges where r is not null)"""

_P4 = (
    _NESTED
    + """,
texts as (select distinct report_id, case when json_valid(text) then case json_type(text) when 'OBJECT' then text when 'VARCHAR' then json_extract_string(text, '$') end end as t from sarif_reports),
logs as (select report_id, cast(t as json) as t from texts where json_valid(t) and json_type(t) = 'OBJECT'),
runs0 as (select report_id, case json_type(t, '$.runs') when 'ARRAY' then json_extract(t, '$.runs[*]') when 'OBJECT' then [json_extract(t, '$.runs')] end as a from logs),
runs as (select report_id, unnest(a) as o, unnest(range(len(a))) as i from runs0),
results0 as (select report_id, i, case json_type(o, '$.results') when 'ARRAY' then json_extract(o, '$.results[*]') when 'OBJECT' then [json_extract(o, '$.results')] end as a from runs where json_type(o) = 'OBJECT'),
results as (select report_id, i, unnest(a) as o, unnest(range(len(a))) as j from results0),
locations0 as (select report_id, i, j, case json_type(o, '$.locations') when 'ARRAY' then json_extract(o, '$.locations[*]') when 'OBJECT' then [json_extract(o, '$.locations')] end as a from results where json_type(o) = 'OBJECT'),
locations as (select report_id, i, j, unnest(a) as o, unnest(range(len(a))) as k from locations0),
severity as (select record_id, unnest(severity) as s, unnest(range(len(severity))) as i from advisories),
refs as (select record_id, unnest(refs) as s, unnest(range(len(refs))) as i from advisories),
inner_severity as (select record_id, i, unnest(f.severity) as s, unnest(range(len(f.severity))) as j from affected where f is not null)
select 'advisories' as table_name, record_id, 'severity[' || i || ']' as node, '' as parent_node from severity where s is not null
union all select 'advisories', record_id, 'refs[' || i || ']', '' from refs where s is not null
union all select 'advisories', record_id, 'affected[' || i || ']', '' from affected where f is not null
union all select 'advisories', record_id, 'affected[' || i || '].severity[' || j || ']', 'affected[' || i || ']' from inner_severity where s is not null
union all select 'advisories', record_id, 'affected[' || i || '].ranges[' || j || ']', 'affected[' || i || ']' from ranges where r is not null
union all select 'advisories', record_id, 'affected[' || i || '].ranges[' || j || '].events[' || k || ']', 'affected[' || i || '].ranges[' || j || ']' from events where e is not null
union all select 'sarif_reports', report_id, 'runs[' || i || ']', '' from runs where json_type(o) = 'OBJECT'
union all select 'sarif_reports', report_id, 'runs[' || i || '].results[' || j || ']', 'runs[' || i || ']' from results where json_type(o) = 'OBJECT'
union all select 'sarif_reports', report_id, 'runs[' || i || '].results[' || j || '].locations[' || k || ']', 'runs[' || i || '].results[' || j || ']' from locations where json_type(o) = 'OBJECT'"""
)

_P2 = r"""
with r as (select distinct monitor_id, created_at, id, cast(json_extract(result_keys_json, '$') as varchar[]) as keys from monitor_runs where status = 'complete' and json_valid(result_keys_json) and json_type(result_keys_json) = 'ARRAY'),
p as (select *, lag(keys) over w as before, lag(id) over w as previous from r window w as (partition by monitor_id order by created_at, id)),
o as (select distinct *, case when coalesce(regexp_replace(fingerprint, '^\s+|\s+$', '', 'g'), '') <> '' then regexp_replace(fingerprint, '^\s+|\s+$', '', 'g')
    else concat_ws('|', coalesce(key, ''), coalesce(path, ''), coalesce(cast(start_line as varchar), ''), coalesce(message, '')) end as k
  from insight_observations where kind = 'finding' and suppressed = false and coalesce(state, '') <> 'quarantined'),
f as (select repository_id, tool, branch, run_id, k, (lower(coalesce(severity, '')), coalesce(message, ''), coalesce(path, ''), coalesce(cast(start_line as varchar), '')) as h from o
  qualify row_number() over (partition by repository_id, tool, branch, run_id, k order by id desc) = 1),
s as (select repository_id, tool, branch, run_id, min(observed_at) as seen from o group by all),
n as (select *, lag(run_id) over w as previous, lead(run_id) over w as next from s window w as (partition by repository_id, tool, branch order by seen, run_id)),
g as (select n.previous, n.next, f.* from n join f on n.repository_id is not distinct from f.repository_id and n.tool is not distinct from f.tool and n.branch is not distinct from f.branch and n.run_id = f.run_id)
select 'monitor_runs' as table_name, cast(id as varchar) as snapshot_id, x as record_key, 'added' as change from (select id, unnest(list_filter(list_distinct(keys), lambda x: not list_contains(before, x))) as x from p where previous is not null)
union all select 'monitor_runs', cast(id as varchar), x, 'removed' from (select id, unnest(list_filter(list_distinct(before), lambda x: not list_contains(keys, x))) as x from p where previous is not null)
union all select 'insight_observations', b.run_id, b.k, case when a.k is null then 'added' else 'changed' end from g b left join g a on a.run_id = b.previous and a.repository_id is not distinct from b.repository_id and a.tool is not distinct from b.tool and a.branch is not distinct from b.branch and a.k = b.k
  where b.previous is not null and (a.k is null or a.h <> b.h)
union all select 'insight_observations', a.next, a.k, 'removed' from g a left join g b on b.run_id = a.next and a.repository_id is not distinct from b.repository_id and a.tool is not distinct from b.tool and a.branch is not distinct from b.branch and a.k = b.k where a.next is not null and b.k is null"""

FLAGSHIP = "search_ranked_topk"

ORACLES: dict[str, str] = {
    **queries_search.ORACLES,
    **queries_facts.ORACLES,
    **queries_more.ORACLES,
    **queries_manifests.ORACLES,
    **queries_fleet.ORACLES,
    **queries_source.ORACLES,
    "p2_found": _P2,
    "p4_found": _P4,
    "p4_events_table": _NESTED + """
select record_id, 'affected[' || i || '].ranges[' || j || '].events[' || k || ']' as node, 'affected[' || i || '].ranges[' || j || ']' as parent_node,
  e.introduced, e.fixed, e.last_affected, e."limit" from events where e is not null""",
    "p5_found": r"""
with r as (
  select distinct lower(regexp_replace(source_name, '^\s+|\s+$', '', 'g')) as a, lower(regexp_replace(target_name, '^\s+|\s+$', '', 'g')) as b,
    epoch_us(observed_from) as lo, epoch_us(observed_to) as hi from runtime_observations where observed_from <= observed_to),
y as (select *, max(hi) over (partition by a, b order by lo, hi rows between unbounded preceding and 1 preceding) as m from r where a <> '' and b <> ''),
z as (select *, sum(case when m is null or lo > m then 1 else 0 end) over (partition by a, b order by lo, hi rows unbounded preceding) as g from y),
p as (select a, b, g, min(lo) as lo, max(hi) as hi from z group by a, b, g),
q as (select *, lag(hi) over (partition by a, b order by g) as h from p)
select a as source_name, b as target_name, 'period' as kind, lo as from_us, hi as to_us from p
union all select a, b, 'gap', h, lo from q where h is not null""",
}
