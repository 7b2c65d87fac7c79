"""Symbols, scopes, imports, incremental work and scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, versions
from ..operators import contexts, graph, insights, resolution, search, store, symbols, topology
from ..session import Scratch, table
from ..sources import extract
from ..sources.python_syntax import python_facts
from .queries_facts import _O, _SERVICE, version_sql
from .queries_search import _BY_LANGUAGE, FILES_SQL, source


def match_fragments(spark, sf_dir):
    rows = search.lines(source(spark, sf_dir).filter("text is not null")).filter(F.contains(F.lower("line"), F.lit("retry")))
    found = search.once(rows.select("file_id", F.col("number").cast("long"), search.fragments(F.col("line"), "retry").alias("fs")))
    return found.select("file_id", "number", F.explode("fs").alias("f")).select("file_id", "number", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"))


def match_citations(spark, sf_dir):
    f = source(spark, sf_dir).filter("text is not null").withColumn("total", F.size(F.split("text", "\n", -1)))
    w = scalars.source_window(F.lit(90), F.col("total"))
    return search.once(f.filter("total >= 30").select("file_id", scalars.citation(F.col("repository"), F.col("revision"), F.col("path"), F.lit(3), F.lit(9)).alias("citation"), w["first"].cast("long").alias("first"), w["last"].cast("long").alias("last")))


def scoped_lines(spark, sf_dir):
    scopes = [contexts.Scope(1, "src"), contexts.Scope(1, "src/a"), contexts.Scope(2), contexts.Scope(3, "cmd/"), contexts.Scope(1, "lib", True)]
    f = source(spark, sf_dir).filter(contexts.scope_predicate(scopes, F.col("repository_id"), F.col("path")))
    return search.once(f.select("file_id", "path"))


def effective_contexts(spark, sf_dir):
    f = source(spark, sf_dir)
    top = F.regexp_extract("path", "^[^/]+", 0)
    a = f.filter("language = 'Go'").select("repository_id", top.alias("folder")).distinct()
    b = f.filter("language = 'Python'").select("repository_id", top.alias("folder")).distinct()
    return contexts.effective(("go", a), ("python", b))


def symbol_definitions(spark, sf_dir):
    """Compiler facts where there are any - Python's own parser - and patterns elsewhere."""
    f = source(spark, sf_dir).filter("text is not null")
    syntax = extract.symbols(f).groupBy("repository", "path", "kind", "name").agg(F.count("*").alias("n"))
    compiler = python_facts(f).filter("fact = 'symbol'").groupBy("repository", "path", "kind", "name").agg(F.count("*").alias("n"))
    return symbols.merge_definitions(syntax, compiler, ["repository", "path"]).groupBy("source", "kind").agg(F.sum("n").alias("n"))


def symbol_search(spark, sf_dir):
    d = extract.symbols(source(spark, sf_dir).filter("text is not null"))
    return d.filter(symbols.name_match(F.col("name"), "index", "prefix")).groupBy("kind", "name").agg(F.count("*").alias("n"))


def reference_targets(spark, sf_dir):
    o = table(spark, sf_dir, "insight_observations").filter("kind = 'finding' and path is not null and message is not null").distinct()
    rel = o.select("repository_id", "path", F.coalesce("start_line", F.lit(0)).cast("long").alias("line"), F.concat(F.regexp_extract("message", r"(\S+)$", 1), F.lit("<T>")).alias("target"))
    defs = o.select("repository_id", F.regexp_extract("message", r"(\S+)$", 1).alias("name"), F.col("path").alias("def_path")).filter("name rlike '^[A-Za-z_]'").distinct()
    return symbols.resolve_targets(rel, defs)


def reference_cap(spark, sf_dir):
    rows = extract.references(search.lines(source(spark, sf_dir).filter("text is not null")), "registry")
    return symbols.capped(search.once(rows.select("repository_id", "file_id", F.col("number").cast("long"))), ["repository_id"], [F.asc("file_id"), F.asc("number")], 5)


def import_packages(spark, sf_dir):
    paths = search.once(source(spark, sf_dir).select("file_id", "repository_id", F.col("path").alias("import_path"))).drop("file_id")
    packages = paths.select("repository_id", F.regexp_extract("import_path", "^[^/]+/[^/]+", 0).alias("package")).filter("package <> ''").distinct()
    return symbols.packages_used(paths, packages)


def import_quarantine(spark, sf_dir):
    o = table(spark, sf_dir, "insight_observations").select("id", "repository_id", "revision", "path").distinct()
    r = table(spark, sf_dir, "repositories").select(F.col("id").alias("repository_id"), "indexed_commit")
    return insights.quarantine(o, r, source(spark, sf_dir).select("repository_id", "path")).select("id", "verdict")


def runtime_import(spark, sf_dir):
    """Every observation with the reason it would be refused, or accepted."""
    o = table(spark, sf_dir, "runtime_observations").distinct()
    return topology.import_verdicts(o).select("source_name", "target_name", "protocol", "observed_from", "observed_to", "request_count", "error_count", "verdict")


def registry_latest_stable(spark, sf_dir):
    a = table(spark, sf_dir, "advisories").select(F.explode("affected").alias("f")).filter("f.ecosystem is not null and f.name is not null").select(F.col("f.ecosystem").alias("ecosystem"), F.col("f.name").alias("package"), F.explode("f.versions").alias("version")).filter("version is not null").distinct()
    good = a.filter(versions.stable(F.col("version")))
    return good.groupBy("ecosystem", "package").agg(F.max(F.struct(versions.version_key(F.col("ecosystem"), F.col("version")).alias("k"), "version")).alias("m")).select("ecosystem", "package", F.col("m.version").alias("latest"))


def registry_ttl(spark, sf_dir):
    r = table(spark, sf_dir, "repositories")
    expires = F.col("discovered_at") + F.expr("INTERVAL 24 HOURS")
    return r.select("id", scalars.ttl_state(F.col("scan_state"), expires, F.lit("2025-02-01").cast("timestamp_ntz")).alias("state"))


def revision_prefix(spark, sf_dir):
    """Two-digit revision prefixes and the one repository they name, if only one."""
    r = table(spark, sf_dir, "repositories").filter("head_commit <> ''")
    return r.groupBy(F.substring("head_commit", 1, 2).alias("prefix")).agg(F.count_distinct("head_commit").alias("n"), F.min("id").alias("first_id")).select("prefix", F.when(F.col("n") == 1, F.col("first_id")).alias("repository_id"))


def incremental_pending(spark, sf_dir):
    """Repositories whose head isn't indexed yet: what the next incremental run takes."""
    r = table(spark, sf_dir, "repositories")
    done = source(spark, sf_dir).select("repository_id", "revision").distinct()
    wanted = r.select(F.col("id").alias("repository_id"), F.col("head_commit").alias("revision"))
    return wanted.join(done, ["repository_id", "revision"], "left_anti").select("repository_id")


def artifact_readiness(spark, sf_dir):
    r = table(spark, sf_dir, "repositories").select(F.col("id").alias("repository_id"))
    have = source(spark, sf_dir).select("repository_id").distinct()
    missing = r.join(have, "repository_id", "left_anti").agg(F.count("*").alias("missing"))
    return missing.select("missing", (F.col("missing") == 0).alias("complete"))


def evidence_cap(spark, sf_dir):
    """Distinct evidence of each key in a total order, at most twelve."""
    o = table(spark, sf_dir, "insight_observations").filter("path is not null")
    out = graph.merge_evidence(o.select("key", F.concat_ws(":", "path", F.coalesce("start_line", F.lit(0))).alias("evidence")), ["key"], "evidence")
    return out.select("key", F.array_join("evidence", ",").alias("evidence"), "total")


def budget_skip(spark, sf_dir):
    """Files taken in path order while a size budget lasts, at most 50 of a repository; one too large is skipped."""
    f = search.once(source(spark, sf_dir).filter("text is not null").select("repository_id", "path", "file_id", F.length("text").cast("long").alias("size")))
    return store.greedy_budget(f, "repository_id", ["path", "file_id"], "size", 20_000, 50, Scratch(spark, "budget")).select("repository_id", "file_id", "used")


def identifier_words(spark, sf_dir):
    d = extract.symbols(source(spark, sf_dir).filter("text is not null")).select("name").distinct()
    return d.select(F.explode(F.array_distinct(scalars.identifier_parts(F.col("name")))).alias("word")).groupBy("word").agg(F.count("*").alias("names"))


def test_paths(spark, sf_dir):
    o = table(spark, sf_dir, "insight_observations").filter("path is not null").select("path").distinct()
    renamed = o.select(F.regexp_replace("path", r"/([a-z])", "/test_$1").alias("path")).unionByName(o)
    return renamed.select("path", scalars.test_path(F.col("path")).alias("is_test"))


def comment_free(spark, sf_dir):
    f = source(spark, sf_dir).filter("text is not null and path like '%.java'")
    return search.once(f.select("file_id", F.md5(scalars.without_comments(F.col("text"))).alias("digest")))


def private_packages(spark, sf_dir):
    a = table(spark, sf_dir, "advisories").select(F.explode("affected").alias("f")).filter("f.name is not null").select(F.col("f.name").alias("package")).distinct()
    return a.filter(scalars.private_package(F.col("package"), ["rode", "vella", "plive", "volani"])).select("package")


def _pairs(spark, sf_dir):
    o = table(spark, sf_dir, "runtime_observations").filter("source_name is not null and target_name is not null")
    return o.select(scalars.service_name(F.col("source_name")).alias("source"), scalars.service_name(F.col("target_name")).alias("target")).filter("source <> '' and target <> ''").distinct()


def topology_assembly(spark, sf_dir):
    """Edges whose both ends are known; of the components only those that an edge touches."""
    o = _pairs(spark, sf_dir)
    known = o.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter("n >= 3").select(F.col("name").alias("id"), (F.length("name") % 2 == 0).alias("external"))
    edges, nodes = topology.assemble(known, o)
    return edges.select(F.lit("connection").alias("what"), "source", "target").unionByName(nodes.select(F.lit("component").alias("what"), F.col("id").alias("source"), F.lit("").alias("target")))


def neighborhood_roles(spark, sf_dir):
    """Callers, callees and context of the service that calls the most others, to depth two."""
    o = _pairs(spark, sf_dir).filter("source <> target")
    me = o.groupBy("source").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "source")).alias("m")).select(F.col("m.source").alias("id"))  # one row
    return topology.neighborhood(o, me).select(F.col("id").alias("node"), "role")


def reachability_states(spark, sf_dir):
    """Conservative verdicts: unreachable only where evidence is complete and the symbol is private."""
    f = source(spark, sf_dir)
    d = extract.symbols(f.filter("text is not null")).distinct()
    c = extract.calls(f.filter("text is not null")).select(F.concat_ws("#", "repository", "target").alias("node")).distinct()
    partial = f.filter("text is null").select("repository").distinct().withColumn("partial", F.lit(True))
    nodes = d.join(partial, "repository", "left").select("*", F.concat_ws("#", "repository", "name").alias("node"), F.col("name").rlike("^[a-z_]").alias("private"), F.col("partial").isNull().alias("complete"))
    return graph.verdicts(nodes, c).select("repository", "path", "kind", "name", "state")


def client_reference_targets(spark, sf_dir):
    o = table(spark, sf_dir, "runtime_observations").filter("source_name is not null and target_name is not null")
    refs = o.select(F.col("source_name").alias("source"), F.concat(F.lit("http://"), F.trim("target_name"), F.lit(":80/x")).alias("target"), F.when(F.col("provider") == "tracehub", "high").otherwise("low").alias("confidence"))
    services = o.filter("protocol = 'http'").select(F.col("target_name").alias("name"))
    return resolution.client_references(refs, services)


def component_reasons(spark, sf_dir):
    o = table(spark, sf_dir, "insight_observations").filter("path is not null").select(F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("name"), "path", "start_line").distinct()
    c = o.select("name", "path", (F.length("path") % 5 != 0).alias("has_source"), F.lit(False).alias("external"), F.lit(1).alias("references"))
    return resolution.root_reasons(c).select("name", "path", "reason")


def placeholder_resolution(spark, sf_dir):
    """Repositories as placeholders, environments' observations as assignments."""
    r = table(spark, sf_dir, "repositories")
    p = r.select(F.col("path").alias("source"), F.concat(F.regexp_replace(F.upper("name"), "-", "_"), F.lit("_URL")).alias("variable"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("http://"), "name")).alias("default_value"), F.when(F.col("id") % 5 == 0, F.col("default_revision")).alias("map_key"))
    reg = r.filter("id % 3 = 0").select(F.col("default_revision").alias("map_key"), F.concat(F.lit("svc-"), F.length("default_revision")).alias("value"))
    asg = r.filter("id % 2 = 0").select(F.concat(F.regexp_replace("name", "-", "_"), F.lit("_url")).alias("variable"), F.concat(F.lit("host-"), F.col("id") % 4).alias("value"), (F.col("id") % 3).alias("rank"))
    return resolution.resolve_placeholders(p, reg, asg)


QUERIES = {f.__name__: f for f in (client_reference_targets, component_reasons, placeholder_resolution, match_fragments, match_citations, scoped_lines, effective_contexts, symbol_definitions, symbol_search, reference_targets, reference_cap, import_packages, import_quarantine, runtime_import, registry_latest_stable, registry_ttl, revision_prefix, incremental_pending, artifact_readiness, evidence_cap, budget_skip, identifier_words, test_paths, comment_free, private_packages, topology_assembly, neighborhood_roles, reachability_states)}

_LINES = f"{FILES_SQL}, l as (select file_id, repository_id, string_split(text, chr(10)) as a from f where text is not null), n as (select file_id, repository_id, unnest(range(1, len(a) + 1)) as number, a from l)"
_PAIRS = f"p as (select distinct {_SERVICE.format('source_name')} as src, {_SERVICE.format('target_name')} as dst from runtime_observations where source_name is not null and target_name is not null), o as (select * from p where src <> '' and dst <> '')"
ORACLES = {
    "client_reference_targets": f"""with r as (select {_SERVICE.format('source_name')} as source, {_SERVICE.format("'http://' || trim(target_name, ' ') || ':80/x'")} as target, provider = 'tracehub' as high from runtime_observations where source_name is not null and target_name is not null),
s as (select distinct {_SERVICE.format('target_name')} as target from runtime_observations where source_name is not null and target_name is not null and protocol = 'http')
select source, target, case when bool_or(high) then 'high' else 'low' end as confidence, case when bool_or(high) then count(*) filter (high) else count(*) end as evidence from r where source <> target and target <> '' and target in (select target from s) group by source, target""",
    "component_reasons": """with o as (select distinct string_split(path, '/')[-2] as name, path, start_line from insight_observations where path is not null)
select name, path, case when coalesce(trim(name), '') = '' then 'no name' when regexp_matches(lower(name), '^(?:test|tests|example|examples|demo|sample|fixture)s?(?:-|$)') or regexp_matches(lower(path), '(?:^|/)(?:test|tests|testdata|examples?|fixtures?)(?:/|$)') then 'test or example'
  when regexp_matches(lower(name), '^(?:localhost|127\\.|0\\.0\\.0\\.0|::1)') then 'loopback' when length(path) % 5 = 0 then 'no deployable source' else 'kept' end as reason from o""",
    "placeholder_resolution": f"""with p as (select path as source, upper(replace(name, '-', '_')) || '_URL' as variable, case when id % 7 = 0 then 'http://' || name end as d, case when id % 5 = 0 then default_revision end as k from repositories),
g as (select default_revision as k, count(distinct 'svc-' || length(default_revision)) as rn, min('svc-' || length(default_revision)) as rv from repositories where id % 3 = 0 group by 1),
a as (select lower(replace(name, '-', '_') || '_url') as v, 'host-' || (id % 4) as value, id % 3 as rank from repositories where id % 2 = 0),
b as (select v, count(distinct value) as an, min(value) as av from (select * from a qualify rank() over (partition by v order by rank desc) = 1) group by v),
t as (select *, case when rn = 1 then 'registry' when coalesce(d, '') <> '' then 'default' when an = 1 then 'assignment' when an > 1 then 'ambiguous_assignment' when rn > 1 then 'ambiguous_registry' when variable <> '_URL' then 'name' else 'unresolved' end as tier
  from p left join g using (k) left join b on b.v = lower(variable)),
x as (select source, variable, tier, case tier when 'registry' then rv when 'default' then d when 'assignment' then av when 'name' then replace(lower(regexp_extract(variable, '^(.+?)_URL$', 1)), '_', '-') end as value from t)
select source, variable, tier, {_SERVICE.format('value')} as target from x""",
    "match_fragments": f"""with recursive {_LINES}, x as (select file_id, number, lower(a[number]) as t from n where contains(lower(a[number]), 'retry')),
r as (select file_id, number, t, strpos(t, 'retry') - 1 as start from x union all select file_id, number, t, start + 5 + strpos(substr(t, start + 6), 'retry') - 1 from r where strpos(substr(t, start + 6), 'retry') > 0)
select file_id, cast(number as bigint) as number, cast(start as bigint) as start, cast(start + 5 as bigint) as "end" from r""",
    "match_citations": f"with {FILES_SQL}, l as (select *, len(string_split(text, chr(10))) as total from f where text is not null) select file_id, repository || '@' || left(revision, 8) || ':' || path || '#L3-L9' as citation, 10::bigint as first, least(total, 209) as last from l where total >= 30",
    "scoped_lines": f"with {FILES_SQL} select file_id, path from f where (repository_id = 1 and (path = 'src' or starts_with(path, 'src/') or path = 'lib' or starts_with(path, 'lib/'))) or repository_id = 2 or (repository_id = 3 and starts_with(path, 'cmd/'))",
    "effective_contexts": f"with {FILES_SQL}, c as (select distinct repository_id, regexp_extract(path, '^[^/]+') as folder, lower(language) as g from f where language in ('Go', 'Python')) select repository_id, folder, string_agg(g, ',' order by g) as origins from c group by all",
    "symbol_search": f"with {FILES_SQL}, s as ({_BY_LANGUAGE}) select kind, name, count(*) as n from s where starts_with(lower(name), 'index') group by all",
    "reference_targets": f"""with {_O}, q as (select * from o where kind = 'finding' and path is not null and message is not null), e as (select repository_id, regexp_extract(message, '(\\S+)$', 1) as name, path from q),
d as (select repository_id, name, count(distinct path) as c from e where regexp_matches(name, '^[A-Za-z_]') group by all),
m as (select repository_id, path, coalesce(start_line, 0) as line, regexp_extract(message, '(\\S+)$', 1) as t,
  list_last(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_extract(message, '(\\S+)$', 1) || '<T>', '<.*$|\\[.*$|\\(.*$', '', 'g'), '^[*&@\\s]+', ''), '[?!;,\\s]+$', ''), '::|->|[./#$]')) as name from q),
one as (select repository_id, name, min(path) as def_path from e where regexp_matches(name, '^[A-Za-z_]') group by all having count(distinct path) = 1)
select m.repository_id, m.path, cast(m.line as bigint) as line, t || '<T>' as target, case when c is null then 'external' when c = 1 then 'resolved' else 'ambiguous' end as state, coalesce(c, 0) as candidates, def_path from m left join d using (repository_id, name) left join one using (repository_id, name)""",
    "reference_cap": f"""with {_LINES}, x as (select repository_id, file_id, number from n where list_contains(regexp_split_to_array(a[number], '[^\\p{{L}}\\p{{Nd}}_$]+'), 'registry')),
r as (select *, row_number() over (partition by repository_id order by file_id, number) as k, count(*) over (partition by repository_id) > 5 as truncated from x) select repository_id, file_id, cast(number as bigint) as number, truncated from r where k <= 5""",
    "import_packages": f"with {FILES_SQL}, p as (select repository_id, path, regexp_extract(path, '^[^/]+/[^/]+') as package from f) select repository_id, package, count(*) as imports from p where package <> '' group by all",
    "import_quarantine": f"""with {_O}, k as (select distinct repository_id, path from source_files), j as (select o.*, r.indexed_commit, k.path as p from o left join repositories r on r.id = o.repository_id left join k on k.repository_id = o.repository_id and k.path = o.path)
select id, case when indexed_commit is null then 'unknown_repository' when coalesce(revision, '') <> indexed_commit then 'quarantined' when coalesce(path, '') = '' then 'measured' when p is null then 'unresolved_path' else 'measured' end as verdict from j""",
    "runtime_import": """select source_name, target_name, protocol, observed_from, observed_to, request_count, error_count, case when coalesce(trim(source_name), '') = '' then 'no source' when coalesce(trim(target_name), '') = '' then 'no target' when observed_from is null or observed_to is null then 'no window' when observed_from > observed_to then 'window ends first'
  when observed_to > observed_from + interval 31 days then 'window too long' when coalesce(request_count, 0) < 0 or coalesce(error_count, 0) > coalesce(request_count, 0) then 'bad counts' else 'accepted' end as verdict from (select distinct * from runtime_observations)""",
    "registry_ttl": "select id, case when discovered_at + interval 24 hours <= timestamp '2025-02-01' then 'stale' when scan_state = 'ok' then 'fresh' else 'failed' end as state from repositories",
    "revision_prefix": "select left(head_commit, 2) as prefix, case when count(distinct head_commit) = 1 then min(id) end as repository_id from repositories where head_commit <> '' group by 1",
    "incremental_pending": "select id as repository_id from repositories r where not exists (select 1 from source_files s where s.repository_id = r.id and s.revision = r.head_commit)",
    "artifact_readiness": "select count(*) as missing, count(*) = 0 as complete from repositories where id not in (select repository_id from source_files)",
    "evidence_cap": "with e as (select key, list_sort(list_distinct(list(path || ':' || coalesce(start_line, 0)))) as e from insight_observations where path is not null group by key) select key, array_to_string(e[1:12], ',') as evidence, len(e) as total from e",
    "test_paths": "with o as (select distinct path from insight_observations where path is not null), r as (select regexp_replace(path, '/([a-z])', '/test_\\1', 'g') as path from o union all select path from o) select path, list_has_any(string_split(lower(path), '/'), ['test', 'tests', '__tests__', 'spec', 'testing']) or regexp_matches(regexp_extract(lower(path), '[^/]*$'), '^test_|\\.(?:test|spec)\\.|_(?:test|spec)\\.[a-z]+$|tests?\\.(?:java|kt|cs|swift)$') as is_test from r",
    "comment_free": f"""with {FILES_SQL} select file_id, md5(regexp_replace(text, '("(?:\\\\.|[^"\\\\\\n])*"|''(?:\\\\.|[^''\\\\\\n])*'')|//[^\\n]*|/\\*(?s:.*?)\\*/', '\\1', 'g')) as digest from f where text is not null and path like '%.java'""",
    "registry_latest_stable": f"""with a as (select unnest(affected) as f from advisories), v as (select distinct f.ecosystem as ecosystem, f.name as package, unnest(f.versions) as version from a where f.ecosystem is not null and f.name is not null),
k as (select *, {version_sql('ecosystem', 'version')} as k from v where version is not null and regexp_matches(version, '[0-9]') and not regexp_matches(lower(trim(version)), '(?:^|[0-9._+-])(?:snapshot|alpha|beta|preview|milestone|dev|rc|cr|ea|pre)(?:[0-9._+-]|$)'))
select ecosystem, package, arg_max(version, (k, version)) as latest from k group by ecosystem, package""",
    "budget_skip": """with recursive f as (select distinct repository_id, path, file_id, cast(length(content) as bigint) as size from source_files where content is not null),
o as (select *, row_number() over (partition by repository_id order by path, file_id) as i from f where size <= 20000),
r as (select repository_id, i, file_id, 0::bigint as used, true as taken, size as total, 1 as n from o where i = 1
  union all select o.repository_id, o.i, o.file_id, r.total, r.total + o.size <= 20000 and r.n < 50, case when r.total + o.size <= 20000 and r.n < 50 then r.total + o.size else r.total end, case when r.total + o.size <= 20000 and r.n < 50 then r.n + 1 else r.n end
  from r join o on o.repository_id = r.repository_id and o.i = r.i + 1)
select repository_id, file_id, used from r where taken""",
    "identifier_words": f"""with {FILES_SQL}, s as ({_BY_LANGUAGE}), d as (select distinct name from s),
x as (select name, regexp_replace(regexp_replace(regexp_replace(name, '([\\p{{Ll}}\\d])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '(\\p{{L}})(\\d)', '\\1 \\2', 'g') as y from d),
w as (select unnest(list_distinct(list_filter(regexp_split_to_array(lower(y), '[^\\p{{L}}\\p{{N}}]+'), lambda z: z <> ''))) as word from x) select word, count(*) as names from w group by word""",
    "private_packages": "with a as (select distinct f.name as package from (select unnest(affected) as f from advisories) where f.name is not null) select package from a where list_has_any(regexp_split_to_array(lower(package), '[@/:._-]+'), ['rode', 'vella', 'plive', 'volani'])",
    "topology_assembly": f"""with {_PAIRS}, k as (select src from (select src from o union all select dst from o) group by src having count(*) >= 3), b as (select src as source, dst as target from o where src in (select src from k) and dst in (select src from k))
select 'connection' as what, source, target from b union all select 'component', src, '' from k where length(src) % 2 = 1 or src in (select source from b union all select target from b)""",
    "neighborhood_roles": f"""with {_PAIRS}, e as (select * from o where src <> dst), h as (select src as me from e group by src order by count(*) desc, src desc limit 1),
n as (select dst as node, 'callee' as role from e, h where src = me union all select src, 'caller' from e, h where dst = me), b as (select src as a, dst as b from e union all select dst, src from e)
select * from n union all select distinct b.b, 'context' from b where b.a in (select node from n) and b.b not in (select node from n) and b.b not in (select me from h)""",
    "reachability_states": f"""with {FILES_SQL}, s as ({_BY_LANGUAGE}), d as (select distinct * from s), c as (select distinct repository, unnest(regexp_extract_all(text, '(?:[0-9A-Za-z_]+\\.)*([0-9A-Za-z_]+)\\(', 1)) as name from f where text is not null),
k as (select * from c where name not in ('if', 'for', 'while', 'switch', 'return', 'catch', 'func', 'function', 'def', 'print', 'elif', 'except', 'and', 'or', 'not', 'in')), p as (select distinct repository from f where text is null)
select d.repository, d.path, d.kind, d.name, case when k.name is not null then 'reachable' when p.repository is not null then 'unknown' when regexp_matches(d.name, '^[a-z_]') then 'probably_unreachable' else 'public' end as state from d left join k on k.repository = d.repository and k.name = d.name left join p on p.repository = d.repository""",
}
