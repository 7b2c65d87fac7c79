"""Packages, imports, composed snapshots, suggestions, the language of queries, and merged definitions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars
from ..operators import contexts, entities, graph, history, packages, reachability, search, symbols
from ..session import Scratch, table
from ..sources import extract, scip, syntax_nodes
from .lang import QueryError, complete, parse, result_type
from .predicates import text_predicate, validate
from .queries_facts import _edges, _EDGES
from .queries_fleet import _indexes, brand_ids
from .queries_manifests import _PACKAGES, _packages, _texts
from .queries_search import FILES_SQL, source


def _paths(spark, sf_dir) -> DataFrame:
    return search.once(source(spark, sf_dir).select("file_id", "repository_id", "repository", "path"))


def go_packages(spark, sf_dir):
    f = _paths(spark, sf_dir)
    more = f.select("repository", F.regexp_replace("path", r"\.go$", "_test.go").alias("path")).unionByName(f.select("repository", F.concat(F.lit("cmd/"), "path").alias("path")))
    return packages.go_packages(f.select("repository", "path").unionByName(more).distinct())


def _imports(spark, sf_dir) -> DataFrame:
    """Every file imports the folder of another file of its repository by its module's name, and a package of elsewhere."""
    f = _paths(spark, sf_dir).select("repository", "path").distinct()
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return f.select("repository", F.regexp_replace("path", r"\.[a-z]+$", F.when(F.length("path") % 2 == 0, ".go").otherwise("_test.go")).alias("path"), F.explode(F.array(F.concat(F.lit("x.example/"), "repository", F.lit("/"), F.regexp_replace(folder, "^([^/]+)/.*$", "$1")), F.concat(F.lit("pkg.example/"), F.regexp_replace("path", "/.*$", ""), F.lit("/v2")))).alias("target"))


def import_edges(spark, sf_dir):
    i = _imports(spark, sf_dir)
    modules = i.select("repository").distinct().withColumn("module", F.concat(F.lit("x.example/"), "repository"))
    known = _paths(spark, sf_dir).select("repository", F.regexp_extract("path", "^[^/]+", 0).alias("package")).distinct()
    return packages.import_edges(i, modules, known)


def dependency_usage(spark, sf_dir):
    i = _imports(spark, sf_dir)
    names = ["pkg.example/lib", "pkg.example/cmd", "pkg.example/nothing"]
    d = i.select("repository").distinct().select("repository", F.explode(F.array(*[F.lit(n) for n in names])).alias("package"))
    return packages.dependency_usage(i, d)


def deployment_only(spark, sf_dir):
    """Repositories of which half have all their files moved below a deployment folder; and what their edges come to."""
    f = _paths(spark, sf_dir).select("repository", "repository_id", "path").distinct()
    moved = f.select("repository", F.when(F.col("repository_id") % 2 == 0, F.regexp_replace("path", r"^(.*)\.[^.]+$", "deploy/$1.yaml")).otherwise(F.col("path")).alias("path"))
    edges, gone = packages.suppress(moved.select("repository", F.col("path").alias("target")), packages.deployment_only(moved))
    return edges.groupBy("repository").agg(F.count("*").alias("kept")).withColumn("suppressed", F.lit(0).cast("long")).unionByName(gone.select("repository", F.lit(0).cast("long").alias("kept"), "suppressed"))


def snapshot_compose(spark, sf_dir):
    """The files of repositories on disk whose number is asked for, and which repositories have none."""
    r = table(spark, sf_dir, "repositories").select(F.col("id").alias("repository_id"))
    rows, ready = packages.compose_snapshot(r, _paths(spark, sf_dir))
    n = rows.groupBy("repository_id").agg(F.count("*").alias("files"))
    return ready.join(n, "repository_id", "left").select("repository_id", "ready", F.coalesce("files", F.lit(0)).alias("files"))


def context_suggest(spark, sf_dir):
    return packages.suggest_paths(_paths(spark, sf_dir).select("path").distinct(), "in", 50)


def line_scopes(spark, sf_dir):
    """Matching lines inside scopes: a folder of one repository, some lines of whole repositories."""
    f = _paths(spark, sf_dir).select("repository_id").distinct()
    allowed = contexts.allowed_ids([set(range(1, 60)), set(range(20, 200))], {33, 34})
    scopes = [contexts.Scope(i, "", True, (1, 12)) for i in sorted(allowed)] + [contexts.Scope(21, "lib")]
    hits = extract.references(search.lines(source(spark, sf_dir).filter("text is not null")), "registry").join(F.broadcast(f), "repository_id", "left_semi")
    return search.once(hits.filter(contexts.scope_predicate(scopes, F.col("repository_id"), F.col("path"), F.col("number"))).select("file_id", F.col("number").cast("long").alias("number")))


def route_snapshot(spark, sf_dir):
    line = F.concat(F.lit('\tmux.Handle("'), F.when(F.col("k") % 2 == 0, "GET ").otherwise(""), F.lit("/"), "package", F.lit('", h)'))
    p = _packages(spark, sf_dir)
    routes = extract.go_routes(_texts(p, "main.go", line))
    seen = p.select("repository").distinct().filter("repository <> 'brand#3'").withColumn("revision", F.lit("0123456789abcdef"))
    return packages.route_snapshot(routes, seen)


def service_lines(spark, sf_dir):
    k = F.col("k")
    line = F.when(k % 3 == 0, F.concat(F.lit('  conn := grpc.Dial(ctx, "'), "package", F.lit(':50051")'))).when(k % 3 == 1, F.concat(F.lit('  url = "postgres://u:p@'), "package", F.lit('.db:5432/x"'))).otherwise(F.concat(F.lit("// "), "package"))
    return extract.service_lines(search.lines(_texts(_packages(spark, sf_dir), "a.go", line, "s := mcp.NewServer()\n"))).select("repository", "path", F.col("number").cast("long").alias("number"), "protocol", "target")


def language_labels(spark, sf_dir):
    f = _paths(spark, sf_dir)
    names = ["a.go", "b.tsx", "c.kts", "d.scss", "e.bash", "f.gradle", "g.json", "h.unknown", "i.PY", "Makefile"]
    many = f.select("repository").distinct().select("repository", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return many.select("repository", "name", *[scalars.language_of(F.col("name"), w).alias(w) for w in ("metrics", "map", "scanner")])


def definition_merge(spark, sf_dir):
    """Definitions of compiler indexes instead of the patterns' ones in files that have any."""
    compiler = scip.definition_names(scip.occurrences(_indexes(spark, sf_dir))).select("index_id", "path", "name", "line")
    p = _packages(spark, sf_dir)
    ids = brand_ids(spark, sf_dir)
    syntax = p.join(F.broadcast(ids), "repository").select("index_id", F.concat("folder", F.when(F.col("k") % 2 == 0, "/a.go").otherwise("/b.go")).alias("path"), F.upper("package").alias("name"), F.lit(1).alias("line"))
    return symbols.merge_definitions(syntax, compiler, ["index_id", "path"]).select("index_id", "path", "name", F.col("line").cast("long").alias("line"), "source")


def evidence_text(spark, sf_dir):
    """Derived evidence needs any of the included texts, entities need all."""
    q = parse("lib- content:brand#1 content:test -content:lib-9")
    p = _packages(spark, sf_dir)
    hay = F.concat_ws("\n", "repository", "package", "usage")
    return p.select("package", text_predicate(q, hay).alias("evidence"), text_predicate(q, hay, include="all").alias("entity")).filter("evidence or entity")


def diff_page(spark, sf_dir):
    """At most 25 diffs of a repository, newest file first, and whether there were more."""
    f = _paths(spark, sf_dir)
    return symbols.capped(f, ["repository_id"], [F.desc("file_id")], history.MOST_DIFFS).select("repository_id", "file_id", "truncated")


def search_identity(spark, sf_dir):
    """Files that match with the identity of their repository, where it is ready; the others are counted."""
    hits = search.once(source(spark, sf_dir).filter("text is not null and contains(lower(text), 'registry')").select("file_id", "repository_id", "path"))
    rows, dropped = search.with_identity(hits, table(spark, sf_dir, "repositories").filter("index_state = 'ready'"))
    return rows.select("file_id", "path", "repository_name", "indexed_revision").unionByName(dropped.select(F.lit(None).cast("long").alias("file_id"), F.concat(F.lit("dropped: "), "dropped").alias("path"), F.lit("").alias("repository_name"), F.lit("").alias("indexed_revision")))


def impact_limited(spark, sf_dir):
    """The first two hundred nodes, by distance and name, of what depends on one nation."""
    hit = graph.impact(_edges(spark, sf_dir), spark.createDataFrame([("nation:3",)], "node string"), 2, Scratch(spark, "limited"), "in", 200)
    return hit.select("node", F.col("distance").cast("long").alias("distance"))


def symbol_containers(spark, sf_dir):
    """For every call the tightest declaration around it, by the scanner's spans."""
    f = source(spark, sf_dir).select("file_id", "repository", "path", "text")
    d = syntax_nodes.declarations(f).filter("kind <> 'variable_declaration'").select("repository", "path", F.col("line").cast("long").alias("lo"), F.col("end_line").cast("long").alias("hi"), "name")
    r = syntax_nodes.relations(f).filter("kind = 'call'").select("repository", "path", F.col("line").cast("long").alias("line")).distinct()
    return graph.tightest_container(r, d, ["repository", "path"], "line")


def route_search(spark, sf_dir):
    line = F.concat(F.lit('\tmux.Handle("'), F.when(F.col("k") % 2 == 0, "GET ").otherwise(""), F.lit("/"), "package", F.lit('", h)'))
    routes = extract.go_routes(_texts(_packages(spark, sf_dir), "main.go", line))
    return entities.search_routes(routes, parse("type:route lib-1 content:get content:brand#2 -content:lib-19 path:m1 -repo:brand#21"), 200)


def reachability_report(spark, sf_dir):
    """Declarations of all files: what is reached from mains, initializers and frameworks, and from where."""
    files = source(spark, sf_dir).select("file_id", "repository", "path", "text")
    return reachability.report(files, Scratch(spark, "report")).select("repository", "path", "kind", "name", F.col("line").cast("long").alias("line"), "state", F.col("distance").cast("long").alias("distance"), "ambiguous")


ASKED = ['retry lang:go -path:test "a b"', "type:commit author:x", "x:y z", "-w", "type:diff type:commit", "lang:", '"open', "type:route lang:go", "+a"]


def query_language(spark, sf_dir):
    """What queries mean: their text, filters and kind, or what is wrong with them."""
    rows = []
    for text in ASKED:
        try:
            q = parse(text)
            kind = result_type(q)
            validate(q, kind)
            rows.append((text, q.text, " ".join(f"{'-' if f.negative else ''}{f.field}={f.value}" for f in q.filters), kind, False))
        except QueryError:
            rows.append((text, None, None, None, True))
    rows.append(("la", ",".join(c["insert_text"] for c in complete("x la", 4)), "", "completion", False))
    return spark.createDataFrame(rows, "query string, text string, filters string, kind string, refused boolean")


QUERIES = {f.__name__: f for f in (go_packages, import_edges, dependency_usage, deployment_only, snapshot_compose, context_suggest, line_scopes, route_snapshot, service_lines, language_labels, definition_merge, evidence_text, diff_page, query_language, route_search, reachability_report, search_identity, impact_limited, symbol_containers)}

_IMPORTS = r"""f as (select distinct repository, path from source_files),
i as (select repository, regexp_replace(path, '\.[a-z]+$', case when length(path) % 2 = 0 then '.go' else '_test.go' end) as path, unnest(['x.example/' || repository || '/' || regexp_extract(path, '^[^/]+'), 'pkg.example/' || regexp_extract(path, '^[^/]+') || '/v2']) as target from f where contains(path, '/')
  union all select repository, regexp_replace(path, '\.[a-z]+$', case when length(path) % 2 = 0 then '.go' else '_test.go' end), unnest(['x.example/' || repository || '/' || path, 'pkg.example/' || path || '/v2']) from f where not contains(path, '/'))"""
ORACLES = {
    "go_packages": r"""with f as (select distinct repository, path from source_files), m as (select * from f union select repository, regexp_replace(path, '\.go$', '_test.go') from f union select repository, 'cmd/' || path from f),
g as (select repository, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as package, min(path) as first_file from m where ends_with(path, '.go') and not ends_with(path, '_test.go') group by all)
select repository, package, case when package = '' then repository else regexp_extract(package, '[^/]*$') end as label, first_file, regexp_matches(package, '^cmd/[^/]+') as entrypoint from g""",
    "import_edges": f"""with {_IMPORTS}, k as (select distinct repository, regexp_extract(path, '^[^/]+') as package from f),
e as (select distinct repository, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as source, substr(target, length('x.example/' || repository) + 2) as target from i where starts_with(target, 'x.example/' || repository || '/'))
select e.* from e join k on k.repository = e.repository and k.package = e.target where source <> target""",
    "dependency_usage": f"""with {_IMPORTS}, d as (select distinct repository, unnest(['pkg.example/lib', 'pkg.example/cmd', 'pkg.example/nothing']) as package from f),
u as (select d.repository, d.package, count(distinct path) as files, bool_and(ends_with(path, '_test.go')) as tests from d join i on i.repository = d.repository and starts_with(i.target, d.package || '/') group by all)
select d.repository, d.package, coalesce(files, 0) as files, case when files is null then 'unused' when tests then 'test' else 'production' end as usage from d left join u using (repository, package)""",
    "deployment_only": r"""with f as (select distinct repository, repository_id, path from source_files), m as (select repository, case when repository_id % 2 = 0 then regexp_replace(path, '^(.*)\.[^.]+$', 'deploy/\1.yaml') else path end as path from f),
s as (select *, regexp_matches(path, '^deploy/.*\.yaml$') or regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^values|deployment|manifest') and regexp_matches(lower(path), '\.(ya?ml|json|toml|properties|env|tf|tfvars|ts|m?js|cjs|py)$')
  or regexp_matches(lower(path), '(^|/)(deploy|deployment|deployments|k8s|kubernetes|helm|charts|terraform|infra|infrastructure|iac|overlays|environments|cdk)/') and regexp_matches(lower(path), '\.(ya?ml|json|toml|properties|env|tf|tfvars|ts|m?js|cjs|py)$') as infra, regexp_matches(lower(path), '\.(go|java|js|mjs|cjs|jsx|ts|tsx|kt|kts|groovy|gradle|py|sql|sh|bash)$') as src from m),
g as (select repository, count(*) as n, bool_or(infra) and not bool_or(src and not infra) as only_ from s group by 1) select repository, case when only_ then 0 else n end as kept, case when only_ then n else 0 end as suppressed from g""",
    "snapshot_compose": "select id as repository_id, count(file_id) > 0 as ready, count(distinct file_id) as files from repositories left join source_files on repository_id = id group by id",
    "context_suggest": """with f as (select distinct path, string_split(path, '/') as a from source_files), d as (select a, unnest(range(1, len(a))) as n from f), e as (select distinct array_to_string(a[1:n], '/') as path, 'directory' as kind from d union all select path, 'file' from f)
select path, kind from e where contains(lower(path), 'in') order by case when starts_with(lower(path), 'in') then 0 else 1 end, kind, length(path), path limit 50""",
    "line_scopes": f"""with {FILES_SQL}, l as (select file_id, repository_id, path, string_split(text, chr(10)) as a from f where text is not null), p as (select *, unnest(range(1, len(a) + 1)) as number from l)
select file_id, cast(number as bigint) as number from p where list_contains(regexp_split_to_array(a[number], '[^\\p{{L}}\\p{{Nd}}_$]+'), 'registry') and (repository_id between 20 and 59 and repository_id not in (33, 34) and number between 1 and 12 or repository_id = 21 and (path = 'lib' or starts_with(path, 'lib/')))""",
    "route_snapshot": f"with {_PACKAGES}, r as (select *, case when k % 2 = 0 then 'GET' else 'ANY' end as verb from p where repository <> 'brand#3') select 'route:' || repository || ':' || verb || ':/' || package as id, verb || ' /' || package as label, repository, folder || '/main.go' as path, repository || '@01234567:' || folder || '/main.go#L1' as citation from r",
    "search_identity": f"""with {FILES_SQL}, h as (select f.*, r.id, r.name, r.indexed_commit from f left join (select * from repositories where index_state = 'ready') r on r.id = f.repository_id where contains(lower(text), 'registry'))
select file_id, path, name as repository_name, indexed_commit as indexed_revision from h where id is not null union all select null, 'dropped: ' || count(*), '', '' from h where id is null""",
    "impact_limited": f"""with {_EDGES}, a as (select distinct src as node from e where dst = 'nation:3'), b as (select distinct e.src as node from e join a on e.dst = a.node),
m as (select 'nation:3' as node, 0::bigint as distance union all select node, 1 from a union all select node, 2 from b where node not in (select node from a)) select node, distance from m order by distance, node limit 200""",
    "route_search": f"""with {_PACKAGES}, r as (select distinct case when k % 2 = 0 then 'GET' else 'ANY' end || ' /' || package as title, repository, folder || '/main.go' as path from p), h as (select *, lower(concat_ws(chr(10), title, repository, path)) as h from r)
select title, repository, path from h where contains(h, 'lib-1') and (contains(h, 'get') or contains(h, 'brand#2')) and not contains(h, 'lib-19') and contains(path, 'm1') and repository <> 'brand#21' order by lower(repository), path, title limit 200""",
    "service_lines": f"""with {_PACKAGES}, n as (select *, 1 + row_number() over (partition by repository, folder order by k) as number from p)
select repository, folder || '/a.go' as path, number, case k % 3 when 0 then 'grpc' else 'postgres' end as protocol, case k % 3 when 0 then package else package || '.db' end as target from n where k % 3 < 2
union all select distinct repository, folder || '/a.go', 1, 'mcp', repository from p""",
    "language_labels": """with f as (select distinct repository from source_files), n(name, metrics, map, scanner) as (values ('a.go', 'Go', 'Go', 'go'), ('b.tsx', 'TypeScript', 'TypeScript', 'tsx'), ('c.kts', 'Kotlin', 'Kotlin', 'kotlin'), ('d.scss', '', 'CSS', ''), ('e.bash', '', 'Shell', 'bash'),
  ('f.gradle', '', '', 'groovy'), ('g.json', '', 'JSON', ''), ('h.unknown', '', '', ''), ('i.PY', 'Python', 'Python', 'python'), ('Makefile', '', '', '')) select repository, name, metrics, map, scanner from f, n""",
    "definition_merge": f"""with {_PACKAGES}, b as (select *, dense_rank() over (order by repository) as index_id from p) select index_id, folder || '/a.go' as path, package as name, k + 1 as line, 'compiler' as source from b
union all select index_id, folder || '/b.go', upper(package), 1, 'syntax' from b where k % 2 = 1""",
    "evidence_text": f"with {_PACKAGES}, h as (select package, concat_ws(chr(10), repository, package, usage) as h from p), m as (select package, contains(h, 'brand#1') as a, contains(h, 'test') as b, contains(h, 'lib-9') as c from h) select package, (a or b) and not c as evidence, a and b and not c as entity from m where (a or b) and not c",
    "diff_page": f"with {FILES_SQL} select repository_id, file_id, count(*) over (partition by repository_id) > 25 as truncated from f qualify row_number() over (partition by repository_id order by file_id desc) <= 25",
    "query_language": """select * from (values ('retry lang:go -path:test "a b"', 'retry a b', 'language=go -path=test', 'content', false), ('type:commit author:x', '', 'result_type=commit author=x', 'commit', false), ('x:y z', 'x:y z', '', 'content', false), ('-w', '', '-content=w', 'content', false),
  ('type:diff type:commit', null, null, null, true), ('lang:', null, null, null, true), ('"open', null, null, null, true), ('type:route lang:go', null, null, null, true), ('+a', '+a', '', 'content', false), ('la', 'language:', '', 'completion', false)) t(query, text, filters, kind, refused)""",
}
