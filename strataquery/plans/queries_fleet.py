"""Findings, filters, entities, orders, topologies out of configuration, sinks and streams over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars, versions
from ..operators import contexts, entities, findings, graph, history, insights, resolution, search, sinks, symbols, topology
from ..session import Scratch, table
from ..sources import config, extract, scip, services, syntax_nodes
from ..streaming import indexing, monitors
from . import filters
from .lang import parse
from .predicates import basename, contains, field_predicate
from .queries_facts import _O, _SERVICE, _obs, version_sql
from .queries_manifests import _PACKAGES, _packages, _texts
from .queries_search import _BY_LANGUAGE, FILES_SQL, source


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


# ---------------------------------------------------------------- findings
def _found(spark, sf_dir) -> DataFrame:
    """One finding for each supplier and part: its line items are the occurrences."""
    li = _t(spark, sf_dir, "lineitem")
    usage = F.element_at(F.array(*[F.lit(u) for u in findings.USAGES]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    spot = F.struct(F.concat(F.lit("m"), F.col("l_partkey") % 9, F.lit("/go.mod")).alias("path"), usage.alias("usage"), F.lit("required").alias("relationship"), F.col("l_returnflag").alias("scope"))
    k = F.col("l_partkey")
    severity = F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "unknown")]), (k % 5 + 1).cast("int"))
    # A supplier sells a part in a handful of orders, so an array of distinct occurrences stays small.
    per = li.select(F.col("l_suppkey").alias("repository"), k, spot.alias("o")).groupBy("repository", "l_partkey").agg(F.array_sort(F.collect_set("o")).alias("occurrences"))
    return per.select(
        F.concat(F.lit("ADV-"), k).alias("advisory"), F.array(F.concat(F.lit("CVE-"), k)).alias("aliases"), F.concat(F.lit("flaw "), k % 17).alias("summary"), F.concat(F.lit("repo-"), "repository").alias("repository"),
        F.when(k % 2 == 0, "npm").otherwise("PyPI").alias("ecosystem"), F.concat(F.lit("Lib_"), k).alias("package"), F.concat_ws(".", k % 4, k % 7).alias("version"), severity.alias("severity"), "occurrences",
    ).withColumn("id", findings.finding_id(F.col("advisory"), F.col("repository"), F.col("package"), F.col("version")))


def finding_page(spark, sf_dir):
    keep = findings.finding_predicate(ecosystem="NPM", usage="build", package="lib_1", text="flaw 3")
    return findings.finding_page(_found(spark, sf_dir), keep, 20, 300).select("id", "advisory", "repository", "package", "severity", findings.primary_usage().alias("usage"))


def finding_facets(spark, sf_dir):
    return findings.finding_facets(_found(spark, sf_dir).filter(findings.finding_predicate(severity="critical", text="m3/go.mod")))


def finding_latest(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    row = lambda eco, at, status: p.select(F.lit(eco).alias("ecosystem"), F.concat(F.lit("lib-"), k).alias("package"), status.alias("status"), F.concat(F.lit(f"{at}."), k % 9).alias("latest"), F.lit(at).alias("fetched_at"))
    answers = row("pypi", 1, F.lit("ok")).unionByName(row("pypi", 2, F.when(k % 3 == 0, "ok").otherwise("error")))
    return findings.with_latest(_found(spark, sf_dir), answers).select("id", "latest_stable")


def finding_gaps(spark, sf_dir):
    """Parts as declarations: by a lock, exactly, as a constraint, or not at all; every third package is covered."""
    p, k = _packages(spark, sf_dir), F.col("k")
    d = p.select("package", F.when(k % 8 == 0, "conan").otherwise("PyPI").alias("ecosystem"), F.when(k % 4 == 0, F.col("version")).alias("resolved"), F.when(k % 4 == 1, F.concat(F.lit("=="), "version")).when(k % 4 == 2, ">=1").otherwise("main").alias("declared"))
    covered = p.filter("k % 3 = 0").select(F.lit("pypi").alias("ecosystem"), F.upper(F.regexp_replace("package", "-", "_")).alias("package"))
    m = findings.matchable_version(F.col("resolved"), F.col("declared"))
    return findings.coverage_gap(d, covered, ["PyPI", "npm"]).select("package", "gap", m["version"].alias("version"), m["basis"].alias("basis"), m["confidence"].alias("confidence"))


def finding_first(spark, sf_dir):
    o = _obs(spark, sf_dir, "repository_id", "key", "path", "start_line", "severity", "observed_at", where="kind = 'finding'")
    return findings.finding_set(o, ["repository_id", "key", "path"], [F.asc("observed_at"), F.asc("id")]).select("id", "repository_id", "key", "path")


def snapshot_drift(spark, sf_dir):
    """Early observations of each repository against later ones, by digests."""
    o = _t(spark, sf_dir, "insight_observations").filter("kind = 'finding'").select("repository_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("key", F.lit("")).alias("key"), "observed_at")
    early = F.col("observed_at") < F.lit("2025-05-01").cast("timestamp_ntz")
    side = lambda cond: findings.set_digest(o.filter(cond), ["repository_id"], ["path", "key"])
    return findings.drift(side(early), side(~early), ["repository_id"])


def inventory_page(spark, sf_dir):
    p, k = _packages(spark, sf_dir), F.col("k")
    inv = p.select("repository", F.concat("folder", F.lit("/go.mod")).alias("path"), F.when(k % 2 == 0, "go").otherwise("npm").alias("ecosystem"), "package", F.col("version").alias("declared"), F.lit("").alias("resolved"), "usage", F.lit("direct").alias("scope"), F.lit("exact").alias("resolution"), F.lit("required").alias("relationship"), F.lit("behind").alias("check_status"), F.lit("minor").alias("distance"))
    keep = filters.declaration_predicate(package="LIB-1", text="m1", ecosystem="GO", usage="production", resolution="exact", distance="minor", check_status="Behind", relationship="required")
    return inv.filter(keep).orderBy(*entities.declaration_order()).limit(search.page_limit(700)).select("repository", "path", "package", "declared")


# ---------------------------------------------------------------- filters
def language_filter(spark, sf_dir):
    f = source(spark, sf_dir).select("file_id", "language", "path")
    return search.once(f.filter(filters.language_predicate(F.col("language"), ["py", " golang", "PY", "cobol"])))


def repository_filter(spark, sf_dir):
    """Repositories named by number and by revision prefix, and not by a name that several have."""
    r = _t(spark, sf_dir, "repositories")
    ids = filters.resolve_repositories(r, ["7", " 12", "7"])
    return r.filter(F.col("id").isin(ids) | filters.revision_predicate(F.col("indexed_commit"), ["AB", "0"])).select("id", "name")


def owner_filter(spark, sf_dir):
    o = _obs(spark, sf_dir, "owner", "path", where="kind = 'finding'").filter("path is not null")
    owners = F.filter(F.array(F.col("owner"), F.regexp_extract("path", "^[^/]+", 0)), lambda x: x != "")
    state = F.when(F.coalesce("owner", F.lit("")) == "", "unowned").otherwise("owned")
    return o.filter(filters.owner_predicate(parse("owner:owned owner:lib -owner:unavailable"), owners, state)).select("id", "owner", "path")


def audit_search(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    keep = filters.columns_contain(["event_id", "ts", "user_id", "event_type", "value", "props"], "9.5") & (F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz"))
    return e.filter(keep).select("event_id", "event_type", "value")


def file_basename_filter(spark, sf_dir):
    """On derived evidence a file filter looks at the name only."""
    o = _obs(spark, sf_dir, "path", where="path is not null")
    q = parse("file:cache file:index -file:test path:lib")
    return o.filter(field_predicate(q, "path", F.col("path")) & field_predicate(q, "file", basename(F.col("path"))))


def severity_import(spark, sf_dir):
    o = _obs(spark, sf_dir, "severity", where="kind = 'finding'")
    return o.select("id", scalars.severity(F.concat(F.lit(" "), F.upper("severity"))).alias("level"))


def text_bounds(spark, sf_dir):
    """Documents' texts compacted and cut, and the line that a place stands in."""
    d = _t(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.md5(scalars.bounded(F.col("text"), 200)).alias("digest"), scalars.line_of(F.col("text"), F.lit(150)).cast("long").alias("line"))


def first_filled(spark, sf_dir):
    o = _obs(spark, sf_dir, "owner", "language", "tool", where="kind = 'finding'")
    return o.select("id", entities.first_filled(F.col("owner"), F.col("language"), F.col("tool")).alias("label"))


def version_order(spark, sf_dir):
    """Versions of each package in the order of their ecosystem, by sort key and by runs of digits."""
    a = _t(spark, sf_dir, "advisories").select(F.explode("affected").alias("f")).filter("f.ecosystem is not null and f.name is not null")
    v = a.select(F.col("f.ecosystem").alias("ecosystem"), F.col("f.name").alias("package"), F.explode("f.versions").alias("version")).filter("version is not null").distinct()
    from pyspark.sql import Window as W

    w = W.partitionBy("ecosystem", "package")  # versions of one package
    key, loose = versions.version_key(F.col("ecosystem"), F.col("version")), versions.loose_parts(F.col("version"))
    return v.select("ecosystem", "package", "version", F.rank().over(w.orderBy(key)).cast("long").alias("place"), F.rank().over(w.orderBy(loose)).cast("long").alias("loose_place"))


# ---------------------------------------------------------------- entities
def repository_search(spark, sf_dir):
    q = parse("type:repository ready content:main content:svc -content:failed")
    q2 = parse("type:repository ready content:main -content:failed")
    r = _t(spark, sf_dir, "repositories")
    both = entities.search_repositories(r, q, 500).withColumn("asked", F.lit("both")).unionByName(entities.search_repositories(r, q2, 500).withColumn("asked", F.lit("one")))
    return both.select("asked", "id", "title", "revision", "citation")


def wiki_search(spark, sf_dir):
    """Documents as pages: the readmes and wikis, each with its repository's files of one folder."""
    d = _t(spark, sf_dir, "documents").filter("doc_kind in ('wiki', 'readme') and text is not null")
    pages = d.select(F.coalesce("source", F.lit("")).alias("repository"), F.lit("0123456789").alias("revision"), F.concat(F.lit("p-"), "doc_id").alias("slug"), F.upper("doc_kind").alias("title"), F.lit("").alias("summary"), F.col("text").alias("body"), F.when(F.col("doc_id") % 7 == 0, "draft").otherwise("ready").alias("status"), F.array(F.concat(F.lit("docs/"), "doc_kind", F.lit(".md")), F.concat(F.lit("src/f"), F.col("doc_id") % 10, F.lit(".go"))).alias("files"))
    return entities.search_pages(pages, parse("type:wiki_page shard path:src file:f3 file:f5"), 400).select("repository", "slug", "title", "citation", F.md5("detail").alias("digest"))


def saved_searches(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    saved = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("user-"), F.col("c_nationkey")).alias("author"), F.when(F.col("c_mktsegment") == "BUILDING", "shared").otherwise("private").alias("visibility"), (F.col("c_custkey") % 10 == 0).alias("managed"))
    return entities.visible_searches(saved, "user-3").select("id", "title", "managed")


def compact_projection(spark, sf_dir):
    out = search.matching_lines(source(spark, sf_dir), lambda x: contains(x, "registry"))
    return entities.compact(out.withColumn("number", F.col("number").cast("long")))


def _references(spark, sf_dir, word: str) -> DataFrame:
    rows = extract.references(search.lines(source(spark, sf_dir).filter("text is not null")), word)
    return search.once(rows.select("file_id", "repository", "path", F.col("number").cast("long").alias("line"), F.lit("reference").alias("kind"), F.lit(word).alias("target")))


def reference_page(spark, sf_dir):
    refs = entities.distinct_references(_references(spark, sf_dir, "registry").drop("file_id"))
    return refs.orderBy(*entities.reference_order()).limit(search.page_limit(None)).select("repository", "path", "line")


def symbol_page(spark, sf_dir):
    """Definitions by name: a prefix, any kind of evidence, and their ranks as results."""
    d = extract.symbols(source(spark, sf_dir).filter("text is not null")).filter(symbols.name_match(F.col("name"), "merge", "prefix")).distinct()
    rows = d.withColumn("source", F.when(F.col("kind") == "class", "compiler").otherwise("syntax")).withColumn("line", F.length("name").cast("long"))
    return rows.orderBy(*entities.symbol_order(), "kind").limit(search.page_limit(200)).select("source", "name", "repository", "path", "line")


def symbol_rank(spark, sf_dir):
    d = extract.symbols(source(spark, sf_dir).filter("text is not null")).filter(contains(F.col("name"), "index")).distinct()
    m = d.select("repository", "path", F.col("name").alias("symbol"), F.lit(1.0).alias("score"), F.lit(1).alias("line_count"))
    return search.rank(m, parse("IndexShard"), 100, "symbol_definition").select("repository", "path", "symbol", F.col("rank_class").cast("long").alias("rank_class"), "weight")


def cursor_page(spark, sf_dir):
    """The second page of files in order of repository and path, from the cursor of the first."""
    files = source(spark, sf_dir).select("repository", "path").distinct()
    first = entities.after_key(files, ["repository", "path"], None).collect()  # one page
    request = {"query": "(class_declaration)"}
    cursor = entities.encode_cursor("files", request, list(first[min(len(first), entities.FILES_A_PAGE) - 1]))
    return entities.after_key(files, ["repository", "path"], entities.decode_cursor(cursor, "files", request))


def identity_total(spark, sf_dir):
    return entities.page_with_total(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.lower("c_name"), F.asc("c_custkey")], 40, 25)


def repository_discovery(spark, sf_dir):
    """A listing of disks made of the catalogue: working copies, bare ones, and folders that only look like them."""
    r = _t(spark, sf_dir, "repositories")
    p = F.col("path")
    work = F.array(F.concat(p, F.lit("/.git/HEAD")), F.concat(p, F.lit("/.git/refs/heads/x")), F.concat(p, F.lit("/README.md")), F.concat(p, F.lit("/refs/a")))
    bare = F.array(F.concat(p, F.lit(".git/HEAD")), F.concat(p, F.lit(".git/objects/aa/bb")), F.concat(p, F.lit(".git/refs/heads/y")))
    fake = F.array(F.concat(p, F.lit("/HEAD")), F.concat(p, F.lit("/refs/b")))
    return services.discover_repositories(r.select(F.explode(F.when(F.col("id") % 3 == 0, fake).when(F.col("bare"), bare).otherwise(work)).alias("path")))


def repository_inspection(spark, sf_dir):
    r = _t(spark, sf_dir, "repositories").filter("head_commit <> ''")
    branch = F.when(F.col("default_revision") == "", "trunk").otherwise(F.col("default_revision"))
    entry = lambda name, text: F.struct(F.lit(name).alias("file") if isinstance(name, str) else name.alias("file"), text.alias("text"))
    head = entry("HEAD", F.when(F.col("id") % 5 == 0, F.concat("head_commit", F.lit("\n"))).otherwise(F.concat(F.lit("ref: refs/heads/"), branch, F.lit("\n"))))
    packed = entry("packed-refs", F.concat(F.lit("# pack-refs\n"), F.repeat(F.lit("0"), 40), F.lit(" refs/heads/"), branch, F.lit("-old\n"), F.when(F.col("id") % 2 == 0, F.col("head_commit")).otherwise(F.repeat(F.lit("f"), 40)), F.lit(" refs/heads/"), branch, F.lit("\n")))
    loose = entry(F.concat(F.lit("refs/heads/"), branch), F.concat("head_commit", F.lit("\n")))
    conf = entry("config", F.concat(F.lit('[core]\n\tbare = false\n[remote "origin"]\n\turl = https://me:pw@h.example/'), "name", F.lit("\n")))
    files = F.when(F.col("id") % 2 == 0, F.array(head, packed, conf)).otherwise(F.array(head, packed, loose, conf))
    return services.inspect_repositories(r.select("path", F.explode(files).alias("f")).select("path", "f.file", "f.text"))


def catalogue_join(spark, sf_dir):
    """The catalogue with the newest index of each repository, for those one may see."""
    r = _t(spark, sf_dir, "repositories")
    newest = _t(spark, sf_dir, "source_files").filter("content is not null").groupBy(F.col("repository_id").alias("id")).agg(F.max("indexed_at").alias("indexed_at"), F.count_distinct("file_id").alias("documents"))
    grants = _t(spark, sf_dir, "documents").select(F.col("repository_id").alias("id")).distinct()
    return r.join(newest, "id", "left").join(grants, "id", "left_semi").select("id", "name", "path", "indexed_at", F.coalesce("documents", F.lit(0)).alias("documents")).orderBy(F.lower("name"), F.lower("path"))


def file_listing(spark, sf_dir):
    """Files of each repository in order of path, at most twenty, flagged where there are more."""
    f = search.once(source(spark, sf_dir).select("file_id", "repository_id", "path"))
    return symbols.capped(f, ["repository_id"], [F.asc("path"), F.asc("file_id")], 20).select("repository_id", "file_id", "path", "truncated")


def commit_log_bounded(spark, sf_dir):
    """Commits of each customer, newest first, those on one clerk's path only, while they fit in a kilobyte."""
    o = _t(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select("o_custkey", F.col("o_orderkey").alias("revision"), F.octet_length(F.concat(F.col("o_orderkey").cast("string"), "o_orderpriority")).cast("long").alias("size"), "o_orderdate")
    from ..operators.store import bounded_by_size

    return bounded_by_size(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("revision")], F.col("size"), 120).filter("not truncated").select("o_custkey", "revision")


def diff_stat(spark, sf_dir):
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" "), x))
    patches = source(spark, sf_dir).filter("text is not null").select("file_id", F.concat(F.lit("--- a\n+++ b\n"), F.array_join(parts, "\n")).alias("patch"))
    return search.once(history.diff_stat(patches, 500).select("file_id", F.col("insertions").cast("long").alias("insertions"), F.col("deletions").cast("long").alias("deletions"), F.md5("shown").alias("shown"), "truncated"))


# ---------------------------------------------------------------- symbols and structure
def structural_query(spark, sf_dir):
    """Methods of Java classes by a tree pattern."""
    hits = syntax_nodes.structural_search(source(spark, sf_dir).filter("path like '%.java'"), '(class_declaration name: (identifier) @class body: (class_body (method_declaration name: (identifier) @method))) (#match? @method "^(merge|split)")')
    return hits.select("file_id", F.col("nth").cast("long").alias("nth"), "capture", "name", F.col("line").cast("long").alias("line"))


def declarations(spark, sf_dir):
    """Declarations of every language the scanner knows, with their parents."""
    d = syntax_nodes.declarations(source(spark, sf_dir))
    return d.select("file_id", F.col("nth").cast("long").alias("nth"), "kind", "name", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), F.col("parent").cast("long").alias("parent"), F.array_join("modifiers", ",").alias("modifiers"))


def reachability_roots(spark, sf_dir):
    """Declarations made of parts: mains, initializers, annotated ones and plain ones."""
    k = F.col("k")
    p = _packages(spark, sf_dir)
    language = F.element_at(F.array(*[F.lit(x) for x in ("Go", "java", "Python")]), (k % 3 + 1).cast("int"))
    name = F.when(k % 4 == 0, "main").when(k % 4 == 1, "init").otherwise(F.col("package"))
    notes = F.when(k % 5 == 0, F.array(F.lit("Override"), F.lit("Service"))).when(k % 7 == 0, F.array(F.lit("Bean"))).otherwise(F.array().cast("array<string>"))
    return p.select("package", graph.root_kind(language, name, notes).alias("root")).filter("root is not null")


def _relations(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "extends").otherwise("import")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), kind.alias("kind"))


def reachability_edges(spark, sf_dir):
    return graph.reach_edges(_relations(spark, sf_dir)).select("src", "dst", "kind")


def reachability_witness(spark, sf_dir):
    """Everything reached from one supplier over calls and, turned around, bases, with the node before it."""
    edges = graph.reach_edges(_relations(spark, sf_dir))
    return graph.reachable(edges, spark.createDataFrame([("s1",)], "node string"), Scratch(spark, "witness"), witness=True).withColumn("distance", F.col("distance").cast("long"))


def graph_selector(spark, sf_dir):
    """A repository by its id, a nation by its label and another repository by its path, these two in other case than the tables have them."""
    r = _t(spark, sf_dir, "repositories")
    nodes = r.select(F.concat(F.lit("repo:"), "id").alias("id"), F.concat("name", F.lit("-"), "id").alias("label"), "path").unionByName(_t(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("").alias("path")))
    named = {x.id: x for x in nodes.filter(F.col("id").isin("nation:7", "repo:3")).collect()}
    chosen = [graph.resolve_selector(nodes, s) for s in ("repo:17", named["nation:7"].label.replace("NATION", "nation"), (named["repo:3"].path or named["repo:3"].label).replace("/srv/", "/SRV/"))]
    return nodes.filter(F.col("id").isin(chosen)).select("id", "label")


def snapshot_graph(spark, sf_dir):
    """Repository, file and symbol nodes with the edges that contain and define them."""
    f = search.once(source(spark, sf_dir).select("file_id", "repository_id", "repository", "path"))
    s = extract.symbols(source(spark, sf_dir).filter("text is not null")).distinct()
    nodes, edges = graph.snapshot_graph(f, s)
    return nodes.select(F.lit("node").alias("what"), "id", "kind", F.lit("").alias("to")).unionByName(edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), "kind", F.col("dst").alias("to")))


def scip_import(spark, sf_dir):
    """Compiler indexes written from the parts of each brand and read back: definitions and references."""
    return scip.occurrences(_indexes(spark, sf_dir)).select("index_id", "path", "symbol", F.col("start_line").cast("long").alias("line"), F.col("start_char").cast("long").alias("at"), "definition")


def _indexes(spark, sf_dir) -> DataFrame:
    import pyarrow as pa

    p = _packages(spark, sf_dir).join(F.broadcast(brand_ids(spark, sf_dir)), "repository").select("index_id", "folder", "k", "package")
    docs = p.groupBy("index_id", "folder").agg(F.sort_array(F.collect_list(F.struct("k", "package"))).alias("ps"))
    per = docs.groupBy("index_id").agg(F.sort_array(F.collect_list(F.struct("folder", "ps"))).alias("docs"))

    def run(batches):
        for b in batches:
            out = []
            for ds in b.column(1).to_pylist():
                made = []
                for d in ds:
                    spots = [x for p in d["ps"] for x in ((f"scip . {p['package']}#", p["k"], 2, 9, True), (f"scip . base{p['k'] % 3}#", p["k"] + 1, 0, 4, False))]
                    made.append((d["folder"] + "/a.go", "Go", spots, [(f"scip . {p['package']}#", [f"scip . base{p['k'] % 3}#"]) for p in d["ps"]]))
                out.append(scip.write_index(made))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["index_id", "data"])

    return per.mapInArrow(run, "index_id long, data binary")


def brand_ids(spark, sf_dir) -> DataFrame:
    """``repository, index_id``: the brands of the catalogue, a handful, numbered by name."""
    from pyspark.sql import Window as W

    return _packages(spark, sf_dir).select("repository").distinct().select("repository", F.dense_rank().over(W.orderBy("repository")).cast("long").alias("index_id"))


def scip_implementations(spark, sf_dir):
    """Where the symbols stand that implement one base, and the base itself."""
    idx = _indexes(spark, sf_dir)
    s = scip.symbols(idx).select(F.col("symbol").alias("id"), "relationships").distinct()
    hits = symbols.scip_resolve(s, scip.occurrences(idx), spark.createDataFrame([("scip . base1#",)], "symbol string"))
    return hits.select("index_id", "path", "symbol", F.col("line").cast("long").alias("line"))


# ---------------------------------------------------------------- topology
def _connections(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "runtime_observations").filter("source_name is not null and target_name is not null")
    c = o.select(scalars.service_name(F.col("source_name")).alias("source"), scalars.service_name(F.col("target_name")).alias("target"), F.coalesce("protocol", F.lit("")).alias("protocol"), F.coalesce("environment", F.lit("")).alias("environment")).filter("source <> '' and target <> ''").distinct()
    return c.withColumn("state", F.element_at(F.array(*[F.lit(s) for s in ("confirmed", "runtime_only", "static_only")]), (F.length("target") % 3 + 1).cast("int")))


def topology_summary(spark, sf_dir):
    c = _connections(spark, sf_dir).select("source", F.when(F.length("source") % 2 == 0, F.concat(F.lit("runtime:"), "target")).otherwise(F.col("target")).alias("target"), "protocol", "state", (F.length("target") % 5 == 0).alias("resolved"))
    n = c.select(F.col("source").alias("id")).distinct()
    nodes = n.select("id", F.when(F.length("id") % 4 == 0, "database").otherwise("service").alias("kind"), (F.length("id") % 3 == 0).alias("candidate"))
    return topology.summary(nodes, c)


def topology_filter(spark, sf_dir):
    return _connections(spark, sf_dir).filter(topology.connection_predicate("HTTP", "runtime", "production", "agent")).select("source", "target", "protocol", "environment", "state")


def external_peers(spark, sf_dir):
    """Targets as hosts: their names, classes, and the one other component they are."""
    r = _t(spark, sf_dir, "repositories")
    hosts = r.select(F.col("id").alias("repository_id"), F.explode(F.array(F.concat(F.lit("api."), "name", F.lit(".co.uk.")), F.concat(F.upper("name"), F.lit(":8080")), F.concat(F.lit("a.b."), "name", F.lit(".com")), F.concat(F.lit("10.0.0."), F.col("id") % 9))).alias("host"))
    comps = r.filter("id % 2 = 0").select("id", F.col("id").alias("repository_id"), F.array("name").alias("aliases"))
    return config.external_to_components(hosts, comps).select("repository_id", "host", config.peer_name(F.col("host")).alias("peer"), config.peer_class(F.col("host")).alias("class"), "component_id")


def mcp_config(spark, sf_dir):
    p = _packages(spark, sf_dir)
    server = F.concat(F.lit('"'), "package", F.lit('": '), F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"url": "https://'), "package", F.lit('.example/mcp"}'))).otherwise('{"command": "x"}'))
    return config.mcp_servers(_texts(p, "mcp.json", server, '{"a": [{"mcp_Servers": {', "}}]}", ", "))


def backstage_config(spark, sf_dir):
    p = _packages(spark, sf_dir)
    return config.backstage(_texts(p, "catalog-info.yaml", F.concat(F.lit("    - component:default/"), "package"), "apiVersion: v1\nkind: Component\nmetadata:\n  name: 'the one'\nspec:\n  dependsOn:\n", "\n  consumesApis: [api:ns/shared]\n"))


def compose_config(spark, sf_dir):
    """Services that need the next package of their folder's list, or one that isn't there."""
    line = F.concat(F.lit("  "), "package", F.lit(":\n    image: x\n    depends_on:\n"), F.when(F.col("k") % 2 == 0, "      - elsewhere").otherwise("      elsewhere: {condition: started}"))
    services_, edges = config.compose(_texts(_packages(spark, sf_dir), "docker-compose.yml", line, "services:\n", "\n"))
    return services_.select("repository", "path", F.col("name").alias("source"), F.coalesce("alias_of", F.lit("")).alias("target"), F.lit("service").alias("what")).unionByName(edges.select("repository", "path", "source", "target", F.when(F.col("resolved"), "resolved").otherwise("external").alias("what")))


def env_assignments(spark, sf_dir):
    """Assignments in files of several places: what may be kept of a value, how much it counts, and where it holds."""
    k = F.col("k")
    value = F.when(k % 5 == 0, "${SECRET}").when(k % 5 == 1, F.concat(F.lit("https://u:p@"), "package", F.lit(".svc:8443/x"))).when(k % 5 == 2, F.concat("package", F.lit(":9092"))).when(k % 5 == 3, "plain words").otherwise("'7'")
    name = F.when(k % 2 == 0, "API_URL").otherwise("RETRIES")
    lines = search.lines(_texts(_packages(spark, sf_dir), "values-prod.yaml", F.concat(name, F.lit(": "), value)))
    a = extract.assignments(lines.withColumn("path", F.concat(F.when(F.length("repository") % 2 == 0, "deploy/eu-west-1/").otherwise("docs/"), "path")))
    return a.select("repository", "path", F.col("number").cast("long").alias("number"), "variable", config.sanitized_value(F.col("variable"), F.col("value")).alias("kept"), config.assignment_rank(F.col("path")).cast("long").alias("rank"), config.assignment_environment(F.col("path")).alias("environment"))


def message_topics(spark, sf_dir):
    k = F.col("k")
    line = F.when(k % 2 == 0, F.concat(F.lit('  @KafkaListener(topics = "'), "package", F.lit('")'))).otherwise(F.concat(F.lit('  producer.send("'), "package", F.lit('", x);')))
    return resolution.message_edges(search.lines(_texts(_packages(spark, sf_dir), "K.java", line, "import kafka;\n"))).select("source", "target", "path", F.col("number").cast("long").alias("number"))


def effective_roles(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    role = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("viewer", "editor", "admin", "guest")]), (n % 4 + 1).cast("int"))
    people = c.select(k.alias("id"), role(k).alias("role"))
    member = c.filter(k % 3 == 0).select(k.alias("id"), F.col("c_nationkey").alias("group_id"))
    groups = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), role(F.col("n_nationkey")).alias("role"))
    provider = c.select(k.alias("id"), F.lower("c_mktsegment").alias("name"))
    mapping = spark.createDataFrame([("Building", "editor"), ("machinery", "admin")], "name string, role string")
    return resolution.effective_roles(people, member, groups, provider, mapping)


# ---------------------------------------------------------------- sinks and streams
def snapshot_publish(spark, sf_dir):
    """Two snapshots published one after the other, the first removed, the second read; then a partition replaced."""
    root = Scratch(spark, "publish").root
    n = _t(spark, sf_dir, "nation")
    sinks.publish_snapshot(n.filter("n_regionkey = 0"), root)
    sinks.publish_snapshot(n, root, ["n_regionkey"])
    gone = sinks.remove_superseded(spark, root)
    sinks.replace_partitions(n, f"{root}/parts", ["n_regionkey"])
    sinks.replace_partitions(n.filter("n_regionkey = 1 and n_nationkey < 10"), f"{root}/parts", ["n_regionkey"])
    one = sinks.read_snapshot(spark, root).select(F.lit(f"snapshot after {gone} removed").alias("what"), "n_nationkey", "n_regionkey")
    return one.unionByName(spark.read.parquet(f"{root}/parts").select(F.lit("parts").alias("what"), "n_nationkey", "n_regionkey")).withColumn("n_regionkey", F.col("n_regionkey").cast("int"))


def run_append(spark, sf_dir):
    """Observations put away by run, one run twice; a run without its record isn't there."""
    root = Scratch(spark, "runs").root
    o = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("run-"), F.col("l_suppkey") % 7).alias("run_id"), "l_orderkey", "l_linenumber")
    runs = o.select("run_id").distinct().withColumn("state", F.lit("complete"))
    sinks.append_run(runs.filter("run_id <> 'run-3'"), o, root)
    sinks.append_run(runs.filter("run_id = 'run-1'"), o.filter("run_id = 'run-1'"), root)
    return sinks.whole_runs(spark, root).groupBy("run_id").agg(F.count("*").alias("n"))


def stream_pages(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sinks.stream_pages(o, ["o_orderkey"], 20, 110).select(F.col("page").cast("long").alias("page"), F.size(F.from_json("line", "matches array<struct<o_orderkey:long>>")["matches"]).cast("long").alias("matches"), F.get_json_object("line", "$.complete").alias("complete"), F.get_json_object("line", "$.matches[19].o_orderkey").cast("long").alias("twentieth"))


def export_roundtrip(spark, sf_dir):
    root = Scratch(spark, "export").root
    n = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('"a, '), "s_name", F.lit('"\nb')).alias("s_name"))
    sinks.export_table(n, f"{root}/csv")
    sinks.export_table(n, f"{root}/json", "json")
    shape = "s_suppkey long, s_name string"
    plain = spark.read.schema(shape).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{root}/csv")
    return plain.withColumn("form", F.lit("csv")).unionByName(spark.read.schema(shape).json(f"{root}/json").withColumn("form", F.lit("json")))


def table_copy(spark, sf_dir):
    root = Scratch(spark, "copy").root

    def put(df, name):
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    return sinks.copy_tables(spark, lambda n: _t(spark, sf_dir, n), put, ["nation", "region", "supplier", "orders"])


def stream_indexing(spark, sf_dir):
    """Heads that arrive as files: the last of each repository is indexed, failures stay open, derived work is queued once."""
    root = Scratch(spark, "indexing").root
    o = _t(spark, sf_dir, "orders")
    heads = o.select(F.col("o_custkey").cast("long").alias("repository_id"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("head"), F.col("o_orderdate").cast("timestamp").alias("seen_at"))
    heads.repartitionByRange(3, "seen_at", "head").sortWithinPartitions("seen_at", "head").write.mode("overwrite").parquet(f"{root}/heads")
    indexing.watch_heads(spark, f"{root}/heads", f"{root}/out", f"{root}/checkpoint", lambda df: df.withColumn("ok", ~F.endswith("head", F.lit("7"))), ["graph", "symbols"])
    last = f"{root}/out/state"
    state = spark.read.parquet(last)
    epoch = state.agg(F.max("epoch")).first()[0]
    return state.filter(F.col("epoch") == epoch).select("repository_id", "head", "state")


def stream_windows(spark, sf_dir):
    """Requests by connection and hour from a stream, with a watermark; all rows arrive in time here."""
    root = Scratch(spark, "windows").root
    o = _t(spark, sf_dir, "runtime_observations").filter("observed_from is not null").select(F.col("observed_from").cast("timestamp").alias("observed_from"), "source_name", "target_name", "request_count", "error_count")
    o.write.mode("overwrite").parquet(f"{root}/in")
    stream = spark.readStream.schema(o.schema).parquet(f"{root}/in")

    def batch(df, epoch):
        df.write.mode("append" if epoch else "overwrite").parquet(f"{root}/out/epoch={epoch}")

    # Update mode, one batch: every window comes out once.
    monitors.windowed_requests(stream, "400 days").writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "source_name", "target_name", "requests", "errors").filter("requests is not null")


QUERIES = {
    f.__name__: f
    for f in (
        finding_page, finding_facets, finding_latest, finding_gaps, finding_first, snapshot_drift, inventory_page, language_filter, repository_filter, owner_filter, audit_search, file_basename_filter, severity_import, text_bounds, first_filled, version_order,
        repository_search, wiki_search, saved_searches, compact_projection, reference_page, symbol_page, symbol_rank, cursor_page, identity_total, repository_discovery, repository_inspection, catalogue_join, file_listing, commit_log_bounded, diff_stat,
        structural_query, declarations, reachability_roots, reachability_edges, reachability_witness, graph_selector, snapshot_graph, scip_import, scip_implementations, topology_summary, topology_filter, external_peers, mcp_config, backstage_config, compose_config,
        env_assignments, message_topics, effective_roles, snapshot_publish, run_append, stream_pages, export_roundtrip, table_copy, stream_indexing, stream_windows,
    )
}


# ---------------------------------------------------------------- the SQL they are checked against
_FOUND = """f0 as (select distinct l_suppkey as s, l_partkey as k, 'm' || (l_partkey % 9) || '/go.mod' as opath, ['production', 'implementation', 'build', 'development', 'test'][l_linenumber % 5 + 1] as usage, l_returnflag as scope from lineitem),
f as (select 'ADV-' || k as advisory, 'repo-' || s as repository, 'flaw ' || (k % 17) as summary, case when k % 2 = 0 then 'npm' else 'PyPI' end as ecosystem, 'Lib_' || k as package, (k % 4) || '.' || (k % 7) as version, ['critical', 'high', 'medium', 'low', 'unknown'][k % 5 + 1] as severity, k % 5 as sr, k,
  any_value(opath) as opath, list_sort(list_distinct(list(usage))) as usages, list_sort(list((usage, 'required', scope)))[1][1] as usage, string_agg(opath || ' ' || usage || ' required ' || scope, ' ') as places from f0 group by s, k),
g as (select *, substr(sha256(advisory || chr(0) || repository || chr(0) || package || chr(0) || version), 1, 32) as id, list_position(['production', 'implementation', 'build', 'development', 'test'], usage) as ur from f)"""
_CONN = f"""c as (select distinct source, target, protocol, environment, ['confirmed', 'runtime_only', 'static_only'][length(target) % 3 + 1] as state from (select {_SERVICE.format('source_name')} as source, {_SERVICE.format('target_name')} as target, coalesce(protocol, '') as protocol, coalesce(environment, '') as environment
  from runtime_observations where source_name is not null and target_name is not null) where source <> '' and target <> '')"""
_REL = "r as (select distinct case when l_returnflag = 'N' then 'p' || l_partkey else 's' || l_suppkey end as src, case when l_returnflag = 'N' then 's' || l_suppkey else 'p' || l_partkey end as dst, case l_returnflag when 'A' then 'call' else 'extends' end as kind from lineitem where l_returnflag in ('A', 'N'))"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_FLAT = "trim(regexp_replace({0}, '[\\t-\\r\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ')"
_ROLE = "['viewer', 'editor', 'admin', 'guest'][{0} % 4 + 1]"
_RANK = "case {0} when 'viewer' then 1 when 'editor' then 2 when 'admin' then 3 else 0 end"

ORACLES = {
    "finding_page": f"""with {_FOUND} select id, advisory, repository, package, severity, usage from g where ecosystem = 'npm' and list_contains(usages, 'build') and contains(lower(package), 'lib_1')
  and contains(lower(concat_ws(chr(10), advisory, 'CVE-' || k, summary, package, repository, opath, version, places)), 'flaw 3') order by sr, ur, lower(repository), lower(package), advisory, opath, id limit 300 offset 20""",
    "finding_facets": f"with {_FOUND}, h as (select * from g where severity = 'critical' and contains(lower(concat_ws(chr(10), advisory, 'CVE-' || k, summary, package, repository, opath, version, places)), 'm3/go.mod')) " + " union all ".join(f"select '{c}' as field, {c} as value, count(*) as count from h group by {c}" for c in ("severity", "usage", "repository", "package")),
    "finding_latest": f"with {_FOUND} select id, case when k % 2 = 1 then case when k % 3 = 0 then '2.' || (k % 9) else '1.' || (k % 9) end end as latest_stable from g",
    "finding_gaps": f"""with {_PACKAGES} select package, case when k % 8 = 0 then 'uncovered_ecosystem' when k % 4 = 2 then 'no_resolvable_version' when k % 4 = 3 then 'invalid_version' when k % 3 <> 0 then 'not_in_snapshot' end as gap,
  case when k % 4 in (0, 1) then version when k % 4 = 3 then 'main' end as version, case when k % 4 = 0 then 'resolved' when k % 4 in (1, 3) then 'declared' end as basis, case when k % 4 = 0 then 'high' when k % 4 in (1, 3) then 'lower' end as confidence from p""",
    "finding_first": f"with {_O} select id, repository_id, key, path from o where kind = 'finding' qualify row_number() over (partition by repository_id, key, path order by observed_at, id) = 1",
    "snapshot_drift": """with o as (select distinct repository_id, coalesce(path, '') as path, coalesce(key, '') as key, observed_at < timestamp '2025-05-01' as early from insight_observations where kind = 'finding'),
g as (select repository_id, list_sort(list(path || '@' || key) filter (early)) as a, list_sort(list(path || '@' || key) filter (not early)) as b from o group by repository_id)
select repository_id, case when a is null then 'added' when b is null then 'removed' when a = b then 'same' else 'changed' end as state from g""",
    "inventory_page": f"""with {_PACKAGES} select repository, folder || '/go.mod' as path, package, version as declared from p where k % 2 = 0 and usage = 'production' and contains(package, 'lib-1') and contains(lower(concat_ws(chr(10), package, repository, folder || '/go.mod', version, '', usage, 'direct')), 'm1')
  order by lower(repository), folder || '/go.mod', package, version limit 500""",
    "language_filter": f"with {FILES_SQL} select file_id, language, path from f where lower(trim(language)) in ('python', 'py', 'python3', 'go', 'golang', 'cobol')",
    "repository_filter": "select id, name from repositories where id in (7, 12) or starts_with(lower(trim(indexed_commit)), 'ab') or starts_with(lower(trim(indexed_commit)), '0')",
    "owner_filter": f"with {_O} select id, owner, path from o where kind = 'finding' and path is not null and coalesce(owner, '') <> '' and (lower(owner) = 'lib' or lower(regexp_extract(path, '^[^/]+')) = 'lib')",
    "audit_search": "select event_id, event_type, value from events where event_type = 'error' and ts >= timestamp '2024-01-01' and (contains(cast(event_id as varchar), '9.5') or contains(cast(user_id as varchar), '9.5') or contains(cast(value as varchar), '9.5') or contains(lower(event_type), '9.5') or contains(lower(props), '9.5') or contains(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '9.5'))",
    "file_basename_filter": f"with {_O}, n as (select id, path, lower(regexp_extract(path, '[^/]*$')) as b from o where path is not null) select id, path from n where contains(lower(path), 'lib') and (contains(b, 'cache') or contains(b, 'index')) and not contains(b, 'test')",
    "severity_import": f"with {_O} select id, case lower({_TRIM.format('severity')}) when 'critical' then 'error' when 'blocker' then 'error' when 'error' then 'error' when 'warn' then 'warning' when 'warning' then 'warning' when 'major' then 'warning' when 'note' then 'note' when 'info' then 'note' when 'minor' then 'note' when '' then 'none' when 'none' then 'none' else coalesce(lower({_TRIM.format('severity')}), 'none') end as level from o where kind = 'finding'",
    "first_filled": f"with {_O} select id, coalesce(nullif(trim(owner), ''), nullif(trim(language), ''), nullif(trim(tool), ''), '') as label from o where kind = 'finding'",
    "text_bounds": f"with d as (select doc_id, text, {_FLAT.format('text')} as flat from documents where text is not null) select doc_id, md5(case when length(flat) > 200 then left(flat, 200) || '…' else flat end) as digest, cast(len(string_split(left(text, 150), chr(10))) as bigint) as line from d",
    "wiki_search": f"""with d as (select coalesce(source, '') as repository, 'p-' || doc_id as slug, upper(doc_kind) as title, text, doc_kind, doc_id % 10 as n from documents where doc_kind in ('wiki', 'readme') and text is not null and doc_id % 7 <> 0),
m as (select *, {_FLAT.format('text')} as flat from d where n in (3, 5) and contains(lower(concat_ws(chr(10), slug, title, '', text, 'docs/' || doc_kind || '.md', 'src/f' || n || '.go')), 'shard'))
select repository, slug, title, repository || '@01234567:wiki/' || slug as citation, md5(case when length(flat) > 12000 then left(flat, 12000) || '…' else flat end) as digest from m order by lower(repository), slug limit 400""",
    "symbol_page": f"with {FILES_SQL}, s as ({_BY_LANGUAGE}), d as (select distinct * from s where starts_with(lower(name), 'merge')) select case when kind = 'class' then 'compiler' else 'syntax' end as source, name, repository, path, length(name) as line from d order by source, lower(name), lower(repository), path, line, kind limit 200",
    "snapshot_graph": f"""with {FILES_SQL}, s as ({_BY_LANGUAGE}), d as (select distinct *, 'symbol:' || repository || ':' || path || ':' || kind || ':' || name as sid, 'file:' || repository || ':' || path as fid from s)
select distinct 'node' as what, 'repository:' || repository as id, 'repository' as kind, '' as "to" from f union all select distinct 'node', 'file:' || repository || ':' || path, 'file', '' from f union all select distinct 'node', sid, 'symbol', '' from d
union all select distinct 'edge', 'repository:' || repository, 'contains', 'file:' || repository || ':' || path from f union all select distinct 'edge', fid, 'defines', sid from d""",
    "version_order": f"""with a as (select unnest(affected) as f from advisories), v as (select distinct f.ecosystem as ecosystem, f.name as package, unnest(f.versions) as version from a where f.ecosystem is not null and f.name is not null)
select ecosystem, package, version, rank() over (partition by ecosystem, package order by {version_sql('ecosystem', 'version')}) as place, rank() over (partition by ecosystem, package order by list_transform(regexp_extract_all(version, '[0-9]+'), lambda x: cast(x as bigint))) as loose_place from v where version is not null""",
    "repository_search": """with h as (select *, lower(concat_ws(chr(10), name, origin_url, default_revision, head_commit, indexed_commit, scan_state, index_state)) as h, coalesce(nullif(trim(indexed_commit), ''), nullif(trim(head_commit), ''), '') as revision from repositories),
m as (select * from h where contains(h, 'ready') and contains(h, 'main') and not contains(h, 'failed'))
select 'one' as asked, id, name as title, revision, name || '@' || left(revision, 8) || ':repository' as citation from m union all select 'both', id, name, revision, name || '@' || left(revision, 8) || ':repository' from m where contains(h, 'svc')""",
    "saved_searches": "select c_custkey as id, c_name as title, c_custkey % 10 = 0 as managed from customer where c_nationkey = 3 or c_mktsegment = 'BUILDING'",
    "compact_projection": f"with {FILES_SQL}, l as (select file_id, string_split(text, chr(10)) as a from f where text is not null), p as (select file_id, a, unnest(range(1, len(a) + 1)) as number from l) select file_id, cast(number as bigint) as number from p where contains(lower(a[number]), 'registry')",
    "reference_page": f"""with {FILES_SQL}, l as (select repository, path, string_split(text, chr(10)) as a from f where text is not null), p as (select repository, path, a, unnest(range(1, len(a) + 1)) as number from l)
select distinct repository, path, cast(number as bigint) as line from p where list_contains(regexp_split_to_array(a[number], '[^\\p{{L}}\\p{{Nd}}_$]+'), 'registry') order by lower(repository), path, line limit 100""",
    "cursor_page": "with f as (select distinct repository, path from source_files) select repository, path from f order by repository, path limit 33 offset 32",
    "identity_total": "select c_custkey, c_name, (select count(*) from customer) as total from customer order by lower(c_name), c_custkey limit 25 offset 40",
    "repository_discovery": "select path || case when bare then '.git' else '' end as path, regexp_extract(path, '[^/]*$') as name, bare from repositories where id % 3 <> 0 and bare union all select path, regexp_extract(path, '[^/]*$'), false from repositories where id % 3 <> 0 and not bare",
    "repository_inspection": """select path, case when id % 5 = 0 then '' when default_revision = '' then 'trunk' else default_revision end as default_revision, head_commit, 'https://h.example/' || name as origin_url from repositories where head_commit <> ''""",
    "catalogue_join": """with n as (select repository_id as id, max(indexed_at) as indexed_at, count(distinct file_id) as documents from source_files where content is not null group by 1)
select id, name, path, indexed_at, coalesce(documents, 0) as documents from repositories left join n using (id) where id in (select repository_id from documents)""",
    "file_listing": f"with {FILES_SQL} select repository_id, file_id, path, count(*) over (partition by repository_id) > 20 as truncated from f qualify row_number() over (partition by repository_id order by path, file_id) <= 20",
    "commit_log_bounded": "select o_custkey, o_orderkey as revision from orders where o_orderpriority <> '5-LOW' qualify sum(strlen(o_orderkey || o_orderpriority)) over (partition by o_custkey order by o_orderdate desc, o_orderkey desc rows unbounded preceding) <= 120",
    "diff_stat": f"""with {FILES_SQL}, l as (select file_id, list_transform(string_split(text, chr(10)), lambda x, i: (case (i - 1) % 3 when 0 then '+' when 1 then '-' else ' ' end) || x) as a from f where text is not null),
p as (select file_id, a, '--- a' || chr(10) || '+++ b' || chr(10) || array_to_string(a, chr(10)) as t from l)
select file_id, len(list_filter(a, lambda x: starts_with(x, '+') and not starts_with(x, '+++'))) as insertions, len(list_filter(a, lambda x: starts_with(x, '-') and not starts_with(x, '---'))) as deletions, md5(left(t, 500)) as shown, length(t) > 500 as truncated from p""",
    "reachability_roots": f"""with {_PACKAGES}, n as (select package, ['Go', 'java', 'Python'][k % 3 + 1] as language, case k % 4 when 0 then 'main' when 1 then 'init' else package end as name, case when k % 5 = 0 then 'Service' when k % 7 = 0 then 'Bean' end as note from p)
select package, case when name = 'main' and language in ('Go', 'java') then 'main' when name = 'init' and language = 'Go' then 'initializer' else note end as root from n where (name = 'main' and language in ('Go', 'java')) or (name = 'init' and language = 'Go') or note is not null""",
    "reachability_edges": f"with {_REL} select src, dst, kind from r",
    "graph_selector": "select * from (values ('repo:17', (select name || '-17' from repositories where id = 17)), ('nation:7', (select n_name from nation where n_nationkey = 7)), ('repo:3', (select name || '-3' from repositories where id = 3))) t(id, label)",
    "scip_import": f"""with {_PACKAGES}, b as (select *, dense_rank() over (order by repository) as index_id from p)
select index_id, folder || '/a.go' as path, 'scip . ' || package || '#' as symbol, k as line, 2::bigint as at, true as definition from b union all select index_id, folder || '/a.go', 'scip . base' || (k % 3) || '#', k + 1, 0, false from b""",
    "scip_implementations": f"""with {_PACKAGES}, b as (select *, dense_rank() over (order by repository) as index_id from p where true)
select index_id, folder || '/a.go' as path, 'scip . ' || package || '#' as symbol, k + 1 as line from b where k % 3 = 1 union all select index_id, folder || '/a.go', 'scip . base1#', k + 2 from b where k % 3 = 1""",
    "topology_summary": f"""with {_CONN}, d as (select source, case when length(source) % 2 = 0 then 'runtime:' || target else target end as target, protocol, state, length(target) % 5 = 0 as resolved from c), n as (select distinct source as id, length(source) % 4 = 0 as db, length(source) % 3 = 0 as candidate from c),
j as (select d.*, coalesce(candidate, false) as cand, starts_with(target, 'runtime:') and not resolved as loose from d left join n on id = target)
select (select count(*) from n) as components, (select count(*) from n where not db) as services, (select count(*) from n where db) as resources, count(*) as connections, count(*) filter (state = 'confirmed') as confirmed, count(*) filter (state = 'runtime_only') as runtime_only, count(*) filter (state = 'static_only') as static_only,
  count(*) filter (cand) as candidates, count(*) filter (not cand and loose) as unresolved, count(*) filter (not cand and not loose) as resolved, count(distinct protocol) as protocols from j""",
    "topology_filter": f"with {_CONN} select source, target, protocol, environment, state from c where lower(protocol) = 'http' and state <> 'static_only' and lower(environment) = 'production' and contains(lower(concat_ws(' ', source, target, protocol, state, environment)), 'agent')",
    "external_peers": f"""with n as (select {_SERVICE.format('name')} as alias, count(distinct id) as n, min(id) as id from repositories where id % 2 = 0 group by 1),
h as (select id as repository_id, name, 'api.' || name || '.co.uk.' as host, lower(name) || '.co.uk' as peer, 'external' as class, 'api' as alias from repositories union all select id, name, upper(name) || ':8080', {_SERVICE.format('name')}, 'address', {_SERVICE.format('name')} from repositories
  union all select id, name, 'a.b.' || name || '.com', lower(name) || '.com', 'external', 'a' from repositories union all select id, name, '10.0.0.' || (id % 9), '10.0.0.' || (id % 9), 'address', '10' from repositories)
select repository_id, host, peer, class, case when n.n = 1 and n.id <> repository_id then n.id end as component_id from h left join n using (alias)""",
    "mcp_config": f"with {_PACKAGES} select repository, folder || '/mcp.json' as path, repository as source, package as target, 'mcp' as protocol, 'invokes' as interaction, case when k % 2 = 0 then 'streamable_http' else 'stdio' end as transport, 'static' as origin from p",
    "backstage_config": f"with {_PACKAGES}, t as (select repository, folder, package as target from p union select distinct repository, folder, 'shared' from p) select repository, folder || '/catalog-info.yaml' as path, 'the one' as source, target, 'unknown' as protocol, 'depends_on' as interaction, '' as transport, 'declared' as origin from t",
    "compose_config": f"""with {_PACKAGES}, n as (select *, count(*) over (partition by repository, folder) as n from p) select repository, folder || '/docker-compose.yml' as path, package as source, case when n = 1 then repository else '' end as target, 'service' as what from n
union all select repository, folder || '/docker-compose.yml', package, 'elsewhere', 'external' from p""",
    "env_assignments": f"""with {_PACKAGES}, n as (select *, row_number() over (partition by repository, folder order by k) as number from p), v as (select *, case when k % 2 = 0 then 'API_URL' else 'RETRIES' end as variable, case when length(repository) % 2 = 0 then 'deploy/eu-west-1/' else 'docs/' end as d from n)
select repository, d || folder || '/values-prod.yaml' as path, number, variable, case k % 5 when 1 then 'https://' || package || '.svc' when 2 then case when k % 2 = 0 then package else '' end when 4 then case when k % 2 = 0 then '7' else '' end else '' end as kept, 3::bigint as rank, case when length(repository) % 2 = 0 then 'eu-west-1' else 'prod' end as environment from v""",
    "message_topics": f"with {_PACKAGES}, n as (select *, 1 + row_number() over (partition by repository, folder order by k) as number from p) select case when k % 2 = 0 then package else repository end as source, case when k % 2 = 0 then repository else package end as target, folder || '/K.java' as path, number from n",
    "effective_roles": f"""with r as (select c_custkey as id, {_RANK.format(_ROLE.format('c_custkey'))} as r from customer union all select c_custkey, {_RANK.format(_ROLE.format('n_nationkey'))} from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 = 0
  union all select c_custkey, case lower(c_mktsegment) when 'building' then 2 when 'machinery' then 3 else 0 end from customer)
select id, case max(r) when 1 then 'viewer' when 2 then 'editor' when 3 then 'admin' else 'none' end as role from r group by id""",
    "snapshot_publish": "select 'snapshot after 1 removed' as what, n_nationkey, n_regionkey from nation union all select 'parts', n_nationkey, n_regionkey from nation where n_regionkey <> 1 or n_nationkey < 10",
    "run_append": "select 'run-' || (l_suppkey % 7) as run_id, count(*) as n from lineitem where l_suppkey % 7 <> 3 group by 1",
    "stream_pages": "with o as (select o_orderkey, row_number() over (order by o_orderkey) as n from orders qualify n <= 110), g as (select unnest(range(1, 7)) as page) select page, least(page * 20, 110) as matches, case when page = 6 then 'true' else 'false' end as complete, (select o_orderkey from o where n = 20) as twentieth from g",
    "export_roundtrip": """with n as (select s_suppkey, '"a, ' || s_name || '"' || chr(10) || 'b' as s_name from supplier) select *, 'csv' as form from n union all select *, 'json' from n""",
    "table_copy": "select 'nation' as table_name, count(*) as source_rows, count(*) as target_rows from nation union all select 'region', count(*), count(*) from region union all select 'supplier', count(*), count(*) from supplier union all select 'orders', count(*), count(*) from orders",
    "stream_indexing": "with h as (select o_custkey as repository_id, lpad(o_orderkey::varchar, 9, '0') as head, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, lpad(o_orderkey::varchar, 9, '0') desc) = 1) select repository_id, head, case when ends_with(head, '7') then 'error' else 'ready' end as state from h",
    "stream_windows": "select date_trunc('hour', observed_from) as hour, source_name, target_name, cast(sum(request_count) as bigint) as requests, cast(sum(error_count) as bigint) as errors from runtime_observations where observed_from is not null group by all having sum(request_count) is not null",
}
