"""Search, files, history, ownership and extraction over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import history, ownership, search
from ..session import table
from ..sources import extract
from .lang import parse
from .predicates import all_of, basename, contains, validate

#: An ownership file for the fixture's repositories.
OWNERS = """
*                 @platform
/internal/        @core  ops@example.org
*.go              @gophers
/internal/**/*.py @py-core nobody
docs/             @writers
cmd/*/*.java      @java-cmd
"""


def source(spark, sf_dir: str) -> DataFrame:
    """Files as delivered, absent language as empty.

    A file may be delivered twice: whatever is derived from it is made distinct (``search.once``) when
    its text is gone, so filters reach the scan and no text is shuffled.
    """
    return table(spark, sf_dir, "source_files").select("file_id", "repository_id", "repository", "path", F.coalesce("language", F.lit("")).alias("language"), "revision", F.col("content").alias("text"))


FILES_SQL = "f as (select file_id, repository_id, repository, path, coalesce(language, '') as language, revision, content as text from (select distinct on (file_id) * from source_files))"


def search_content_substring(spark, sf_dir):
    q = parse("registry")
    validate(q, "content")
    return search.search_content(source(spark, sf_dir), q).select("repository", "path", "language", F.col("match_count").cast("long"), F.col("line_count").cast("long"), F.col("first_line").cast("long"))


def search_content_regex(spark, sf_dir):
    q = parse('"[a-z]+_limit ?= ?[0-9]+"')
    return search.search_content(source(spark, sf_dir), q, "regex").select("repository", "path", F.col("match_count").cast("long"), F.col("line_count").cast("long"))


def search_filters_or_and_not(spark, sf_dir):
    q = parse("retry lang:python lang:go path:internal path:cmd -file:cache -schema")
    validate(q, "content")
    return search.search_content(source(spark, sf_dir), q).select("repository", "path", F.col("match_count").cast("long"))


def search_line_matches_context(spark, sf_dir):
    out = search.matching_lines(source(spark, sf_dir), lambda x: contains(x, "conflict"))
    return out.select("file_id", F.col("number").cast("long"), "line", "before", "after")


def _scored(spark, sf_dir, text):
    return search.search_content(source(spark, sf_dir), parse(text)).withColumn("score", F.col("match_count").cast("double"))


def search_ranked_topk(spark, sf_dir):
    q = parse("registry")
    return search.rank(_scored(spark, sf_dir, "registry"), q, 50).select("repository", "path", "score", F.col("rank_class").cast("long"), F.round("weight", 6).alias("weight"))


def search_facets(spark, sf_dir):
    return search.facets(_scored(spark, sf_dir, "registry"), ["language", "repository"])


def search_totals(spark, sf_dir):
    return search.totals(_scored(spark, sf_dir, "registry"), search.DEFAULT_LIMIT)


def search_mixed_union(spark, sf_dir):
    c = _scored(spark, sf_dir, "registry").select(F.lit("content").alias("result_type"), "repository", "path", F.col("score").alias("weight"))
    paths = search.once(source(spark, sf_dir).filter(contains(F.col("path"), "registry")).select("file_id", "repository", "path"))
    p = paths.select(F.lit("file_path").alias("result_type"), "repository", "path", F.when(F.startswith(F.lower(basename(F.col("path"))), F.lit("registry")), 70.0).otherwise(40.0).alias("weight"))
    return search.mixed(c, p, 100)


def file_window(spark, sf_dir):
    return search.once(search.lines(source(spark, sf_dir).filter("text is not null"), "text", 3, 12).select("file_id", F.col("number").cast("long"), "line"))


def tree_listing(spark, sf_dir):
    return search.directory_closure(search.once(source(spark, sf_dir).select("file_id", "path")))


def language_summary(spark, sf_dir):
    n = search.once(source(spark, sf_dir).select("file_id", "language")).groupBy("language").agg(F.count("*").alias("files"))
    total = n.agg(F.sum("files").alias("t"))  # one row
    return n.join(F.broadcast(total)).select("language", "files", F.round(100.0 * F.col("files") / F.col("t"), 6).alias("percent"))


def commit_search(spark, sf_dir):
    q = parse("type:commit author:customer#00000001 after:1996-02-01 before:1997-06-30 -message:low")
    validate(q, "commit")
    commits = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return commits.filter(history.commit_predicate(q, F.col("c_name"), F.col("o_orderpriority"), F.col("o_orderdate"))).select(F.col("o_orderkey").alias("revision"), F.col("c_name").alias("author"), F.col("o_orderpriority").alias("message"))


def commit_log_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_orderkey").alias("revision"), F.col("o_orderdate").alias("authored_at")).limit(51)


def diff_sides(spark, sf_dir):
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" "), x))
    patches = source(spark, sf_dir).filter("text is not null").select("file_id", F.concat(F.lit("--- a\n+++ b\n"), F.array_join(parts, "\n")).alias("patch"))
    return search.once(history.diff_sides(patches).select("file_id", F.md5("added").alias("added"), F.md5("removed").alias("removed")))


def line_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "insight_observations").select("tool", "repository_id", "path")
    a, b = rows.filter("tool = 'secscan'"), rows.filter("tool = 'depaudit'")
    return history.line_difference(a, b, ["repository_id"], "path").groupBy("repository_id", "path", "side").agg(F.count("*").alias("n"))


def ownership_last_match(spark, sf_dir):
    files = search.once(source(spark, sf_dir).select("file_id", "repository", "path"))
    names = ["mede-artifact", "velre-budget", "soriba-envelope"]
    rules = ownership.rule_table(spark, {n: OWNERS for n in names})
    return ownership.resolve(files, rules).select("file_id", "state", "owners", F.col("rule_line").cast("long"))


def symbols_extract(spark, sf_dir):
    return extract.symbols(source(spark, sf_dir).filter("text is not null")).groupBy("repository", "path", "kind", "name").agg(F.count("*").alias("n"))


def symbol_calls(spark, sf_dir):
    return extract.calls(source(spark, sf_dir).filter("text is not null")).groupBy("target").agg(F.count("*").alias("files"))


def symbol_references(spark, sf_dir):
    rows = search.lines(source(spark, sf_dir).filter("text is not null"))
    return search.once(extract.references(rows, "registry").select("file_id", F.col("number").cast("long")))


def endpoint_hosts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("source").alias("repository"), F.col("doc_id").cast("string").alias("path"), "text")
    return extract.endpoints(search.lines(docs)).groupBy("protocol", "host").agg(F.count("*").alias("n"))


def route_template_match(spark, sf_dir):
    obs = table(spark, sf_dir, "insight_observations").filter("path is not null").select(F.concat(F.lit("/"), F.col("path")).alias("called")).distinct()
    routes = spark.createDataFrame([("/cmd/{name}/{file}",), ("/internal/{a}/{b}/{c}",), ("/src/*/*",), ("/:root/nabato/:rest",), ("/lib/parser/{file}",)], "route string")
    return extract.match_route(obs, routes)


QUERIES = {f.__name__: f for f in (search_content_substring, search_content_regex, search_filters_or_and_not, search_line_matches_context, search_ranked_topk, search_facets, search_totals, search_mixed_union, file_window, tree_listing, language_summary, commit_search, commit_log_page, diff_sides, line_difference, ownership_last_match, symbols_extract, symbol_calls, symbol_references, endpoint_hosts, route_template_match)}

_HITS = f"""{FILES_SQL}, h as (select repository, path, language, len(string_split(lower(text), 'registry')) - 1 as match_count,
  list_filter(list_transform(string_split(text, chr(10)), lambda x, i: case when contains(lower(x), 'registry') then i end), lambda x: x is not null) as n from f where contains(lower(text), 'registry'))"""
_ESC = r"\\"

ORACLES = {
    "search_content_substring": f"with {_HITS} select repository, path, language, cast(match_count as bigint) as match_count, cast(len(n) as bigint) as line_count, cast(n[1] as bigint) as first_line from h",
    "search_content_regex": f"""with {FILES_SQL} select repository, path, cast(len(regexp_extract_all(text, '(?i)[a-z]+_limit ?= ?[0-9]+')) as bigint) as match_count,
  cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)[a-z]+_limit ?= ?[0-9]+'))) as bigint) as line_count from f where regexp_matches(text, '(?i)[a-z]+_limit ?= ?[0-9]+')""",
    "search_filters_or_and_not": f"""with {FILES_SQL} select repository, path, cast(len(string_split(lower(text), 'retry')) - 1 as bigint) as match_count from f
where contains(lower(text), 'retry') and lower(language) in ('python', 'go') and (contains(lower(path), 'internal') or contains(lower(path), 'cmd')) and not contains(lower(path), 'cache') and not contains(lower(text), 'schema')""",
    "search_line_matches_context": f"""with {FILES_SQL}, l as (select file_id, string_split(text, chr(10)) as a from f where text is not null),
p as (select file_id, unnest(range(1, len(a) + 1)) as number, a from l)
select file_id, cast(number as bigint) as number, a[number] as line, coalesce(case when number > 1 then a[number - 1] end, '') as before, coalesce(a[number + 1], '') as after from p where contains(lower(a[number]), 'conflict')""",
    "search_ranked_topk": f"""with {_HITS}, s as (select repository, path, cast(match_count as double) as score, len(n) as lc, lower(path) as lp, lower(regexp_extract(path, '[^/]*$')) as fn,
  list_filter(regexp_split_to_array(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '{_ESC[:1]}1 {_ESC[:1]}2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') as w from h),
r as (select *, rank() over (order by score desc) as rk, lp = 'registry' or fn = 'registry' as e, starts_with(fn, 'registry') as pf, contains(lp, 'registry') as c, string_split(lp, '/') as parts from s),
t as (select *, case when e then 3 when pf then 2 when c then 1 else 0 end as rank_class,
  case when e then 100 when pf then 60 when c then 30 else 0 end
  + case when len(list_filter(w, lambda x: x = 'registry' or (len(x) >= 3 and (starts_with(x, 'registry') or starts_with('registry', x))))) > 0 then 40.0 else 0 end
  + least(greatest(lc - 1, 0) * 10, 30)
  - case when list_has_any(parts, ['test', 'tests', '__tests__', 'spec', 'testing']) or starts_with(fn, 'test_') or regexp_matches(fn, '\\.test\\.|\\.spec\\.') or regexp_matches(fn, '(_test\\.go|_test\\.py|_test\\.rb|_spec\\.rb|_test\\.cpp|_test\\.c|_test\\.dart|_test\\.lua|_spec\\.lua|test\\.java|tests\\.java|test\\.kt|tests\\.kt|spec\\.kt|test\\.swift|tests\\.swift|spec\\.swift|test\\.cs|tests\\.cs|spec\\.scala|suite\\.scala|test\\.scala)$') then 30 else 0 end
  - case when list_has_any(parts, ['compat', '_compat', 'legacy']) then 20 else 0 end
  - case when list_has_any(parts, ['example', 'examples', '_example', '_examples', 'doc_src', 'docs_src']) then 20 else 0 end
  - case when ends_with(fn, '.d.ts') or fn in ('__init__.py', 'package-info.java') then 10 else 0 end
  + 40.0 / rk as weight from r)
select repository, path, score, cast(rank_class as bigint) as rank_class, round(cast(weight as double), 6) as weight from t order by rank_class desc, round(cast(weight as double), 6) desc, score desc, repository, path limit 50""",
    "search_facets": f"with {_HITS} select 'language' as field, language as value, count(*) as count from h where language <> '' group by language union all select 'repository', repository, count(*) from h where repository <> '' group by repository",
    "search_totals": f"with {_HITS} select count(*) as total_files, cast(coalesce(sum(match_count), 0) as bigint) as total_matches, count(*) > 100 as truncated from h",
    "search_mixed_union": f"""with {_HITS}, u as (select 'content' as result_type, repository, path, cast(match_count as double) as weight from h
union all select 'file_path', repository, path, case when starts_with(lower(regexp_extract(path, '[^/]*$')), 'registry') then 70.0 else 40.0 end from f where contains(lower(path), 'registry'))
select result_type, repository, path, cast(weight as double) as weight from u order by weight desc, result_type, repository, path limit 100""",
    "file_window": f"with {FILES_SQL}, p as (select file_id, unnest(range(3, 13)) as number, string_split(text, chr(10)) as a from f where text is not null) select file_id, cast(number as bigint) as number, a[number] as line from p where number <= len(a)",
    "tree_listing": f"with {FILES_SQL}, p as (select string_split(path, '/') as a from f), q as (select a, unnest(range(1, len(a))) as n from p) select array_to_string(a[1:n], '/') as directory, count(*) as files from q group by 1",
    "language_summary": f"with {FILES_SQL} select language, count(*) as files, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from f group by language",
    "commit_search": "select o_orderkey as revision, c_name as author, o_orderpriority as message from orders join customer on o_custkey = c_custkey where contains(lower(c_name), 'customer#00000001') and o_orderdate >= timestamp '1996-02-01' and o_orderdate < timestamp '1997-07-01' and not contains(lower(o_orderpriority), 'low')",
    "commit_log_page": "select o_orderkey as revision, o_orderdate as authored_at from orders order by o_orderdate desc, o_orderkey desc limit 51",
    "diff_sides": f"""with {FILES_SQL}, l as (select file_id, list_transform(string_split(text, chr(10)), lambda x, i: (case (i - 1) % 3 when 0 then '+' when 1 then '-' else ' ' end) || x) as a from f where text is not null)
select file_id, md5(coalesce(array_to_string(list_transform(list_filter(a, lambda x: starts_with(x, '+') and not starts_with(x, '+++')), lambda x: substr(x, 2)), chr(10)), '')) as added,
  md5(coalesce(array_to_string(list_transform(list_filter(a, lambda x: starts_with(x, '-') and not starts_with(x, '---')), lambda x: substr(x, 2)), chr(10)), '')) as removed from l""",
    "line_difference": """with a as (select repository_id, path from insight_observations where tool = 'secscan'), b as (select repository_id, path from insight_observations where tool = 'depaudit')
select repository_id, path, '-' as side, count(*) as n from (select * from a except all select * from b) group by 1, 2 union all select repository_id, path, '+', count(*) from (select * from b except all select * from a) group by 1, 2""",
    "ownership_last_match": f"""with {FILES_SQL}, r(line, regex, owners, bad) as (values (2, '(?:^|.*/)[^/]*$', '@platform', 0), (3, '^internal(?:/.*)?$', '@core,ops@example.org', 0), (4, '(?:^|.*/)[^/]*\\.go$', '@gophers', 0),
  (5, '^internal/.*/[^/]*\\.py$', '@py-core', 1), (6, '(?:^|.*/)docs(?:/.*)?$', '@writers', 0), (7, '^cmd/[^/]*/[^/]*\\.java$', '@java-cmd', 0)),
n(repository) as (values ('mede-artifact'), ('velre-budget'), ('soriba-envelope')),
m as (select f.file_id, r.* from f join n using (repository) join r on regexp_matches(f.path, r.regex) qualify row_number() over (partition by f.file_id order by r.line desc) = 1)
select f.file_id, case when n.repository is null then 'unavailable' when m.line is null then 'unowned' when m.bad = 1 then 'unresolved_owner' else 'owned' end as state, coalesce(m.owners, '') as owners, cast(m.line as bigint) as rule_line
from f left join n using (repository) left join m using (file_id)""",
    "symbol_calls": f"""with {FILES_SQL}, c as (select file_id, unnest(list_distinct(regexp_extract_all(text, '(?:[0-9A-Za-z_]+\\.)*([0-9A-Za-z_]+)\\(', 1))) as target from f where text is not null)
select target, count(*) as files from c where target not in ('if', 'for', 'while', 'switch', 'return', 'catch', 'func', 'function', 'def', 'print', 'elif', 'except', 'and', 'or', 'not', 'in') group by target""",
    "symbol_references": f"""with {FILES_SQL}, l as (select file_id, string_split(text, chr(10)) as a from f where text is not null), p as (select file_id, unnest(range(1, len(a) + 1)) as number, a from l)
select file_id, cast(number as bigint) as number from p where list_contains(regexp_split_to_array(a[number], '[^\\p{{L}}\\p{{Nd}}_$]+'), 'registry')""",
    "endpoint_hosts": """with u as (select unnest(regexp_extract_all(text, '\\b((?:https?|grpc|kafka|amqps?|postgres(?:ql)?|mysql|mongodb(?:\\+srv)?|redis)://[^\\s"''`<>)]+)', 1)) as url from documents where text is not null)
select regexp_extract(url, '^([a-z+]+)://', 1) as protocol, lower(regexp_extract(url, '^[a-z+]+://(?:[^@/]*@)?\\[?([^:/?#\\]]+)', 1)) as host, count(*) as n from u group by 1, 2""",
    "route_template_match": """with c as (select distinct '/' || path as called from insight_observations where path is not null),
r(route, regex) as (values ('/cmd/{name}/{file}', '^/+cmd/+[^/]+/+[^/]+/*$'), ('/internal/{a}/{b}/{c}', '^/+internal/+[^/]+/+[^/]+/+[^/]+/*$'), ('/src/*/*', '^/+src/+[^/]+/+[^/]+/*$'), ('/:root/nabato/:rest', '^/+[^/]+/+nabato/+[^/]+/*$'), ('/lib/parser/{file}', '^/+lib/+parser/+[^/]+/*$'))
select called, route from c join r on regexp_matches(called, regex)""",
}

_BY_LANGUAGE = " union all ".join(
    f"""select repository, path, '{kind}' as kind, unnest(regexp_extract_all(text, '{pattern}', 1)) as name from f where text is not null and lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) = '{ext}'"""
    for ext, rules in extract.SYMBOLS.items()
    for kind, pattern in rules
)
ORACLES["symbols_extract"] = f"with {FILES_SQL}, s as ({_BY_LANGUAGE}) select repository, path, kind, name, count(*) as n from s group by all"
