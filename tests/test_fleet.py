import pytest
from pyspark.sql import functions as F

from conftest import rows
from strataquery.operators import entities, findings, graph, sinks, topology
from strataquery.operators.search import page_limit, rank
from strataquery.plans import filters, queries_fleet
from strataquery.plans.lang import QueryError, parse
from strataquery.sources import config, locks, scip, services, syntax_nodes
from strataquery.streaming import indexing


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def files(spark, *texts):
    return spark.createDataFrame([("r", p, t) for p, t in texts], "repository string, path string, text string")


@pytest.mark.parametrize("resolved,declared,want", [("1.2", "x", ("1.2", "resolved", "high")), (None, "==1.0", ("1.0", "declared", "lower")), ("", "v2", ("2", "declared", "lower")), ("", ">=1", None), ("", "", None), (None, None, None), (" ", "1 - 2", None)])
def test_matchable_version(spark, resolved, declared, want):
    got = one(spark, findings.matchable_version(F.lit(resolved).cast("string"), F.lit(declared).cast("string")))
    assert (tuple(got) if got else None) == want


def test_finding_filters_and_order(spark):
    shape = "advisory string, aliases array<string>, summary string, repository string, ecosystem string, package string, version string, severity string, occurrences array<struct<path:string,usage:string,relationship:string,scope:string>>, id string"
    df = spark.createDataFrame(
        [("A", ["C-1"], None, "r", "npm", "p", "1", "low", [("m", "test", "x", "s"), ("n", "build", "x", "s")], "1"), ("B", [], "flaw", "R", "npm", "P", "1", "critical", [("k", "test", "x", "s")], "2"), ("C", None, None, "q", None, "p", None, None, None, "3")], shape
    )
    pick = lambda **k: [r.advisory for r in findings.finding_page(df, findings.finding_predicate(**k)).collect()]
    assert pick() == ["B", "A", "C"]
    assert pick(usage="BUILD") == ["A"] and pick(text="c-1") == ["A"] and pick(severity="Critical") == ["B"] and pick(package="p", ecosystem="NPM") == ["B", "A"] and pick(text="flaw") == ["B"]
    assert findings.finding_page(df, F.lit(True), 1, 1).first().advisory == "A"
    assert ("usage", "test", 2) in rows(findings.finding_facets(df))


def test_digest_drift(spark):
    df = lambda *r: findings.set_digest(spark.createDataFrame(list(r), "k int, p string"), ["k"], ["p"])
    assert rows(findings.drift(df((1, "a"), (1, "b"), (2, "a"), (3, "a")), df((1, "b"), (1, "a"), (1, "a"), (2, "c"), (4, "a")), ["k"])) == [(1, "same"), (2, "changed"), (3, "removed"), (4, "added")]


def test_filters(spark):
    assert filters.compact_values([" A", "a", "", "b "]) == ["A", "b"]
    assert filters.canonical_languages(["PY", "golang", "python", "cobol"]) == (["Python", "Go", "cobol"], ["unknown language 'cobol' matches no file"])
    r = spark.createDataFrame([(1, "a"), (2, "A"), (3, "c")], "id long, name string")
    assert filters.resolve_repositories(r, ["C", "1"]) == [1, 3]
    for bad in ("a", "9", "nothing"):
        with pytest.raises(QueryError):
            filters.resolve_repositories(r, [bad])
    paths = F.array(F.lit("src/A.go"), F.lit("docs/b.md"))
    assert one(spark, filters.any_path_predicate(parse("path:src file:a.go"), paths)) and not one(spark, filters.any_path_predicate(parse("path:src file:b.md"), paths))
    assert one(spark, filters.any_path_predicate(parse("x"), F.lit(None).cast("array<string>"))) and not one(spark, filters.any_path_predicate(parse("path:x"), F.lit(None).cast("array<string>")))
    with pytest.raises(QueryError):
        filters.declaration_predicate(colour="red")
    kinds = F.array(F.lit("class_declaration"))
    pre = lambda k, roots: one(spark, filters.tree_prefilter(F.lit("src/a"), "src/", k, roots))
    assert pre(kinds, ["class_declaration"]) and not pre(kinds, ["x"]) and pre(F.array().cast("array<string>"), ["x"]) and pre(kinds, [])
    own = lambda q: one(spark, filters.owner_predicate(parse(q), F.array(F.lit("@a"), F.lit("@b")), F.lit("owned")))
    assert own("owner:@A owner:@b") and not own("owner:@a owner:@c") and not own("owner:owned -owner:@b")


def test_cursor():
    c = entities.encode_cursor("i", {"q": 1}, ["a", 2])
    assert entities.decode_cursor(c, "i", {"q": 1}) == ["a", 2]
    for index, request, text in (("j", {"q": 1}, c), ("i", {"q": 2}, c), ("i", {"q": 1}, "nonsense")):
        with pytest.raises(ValueError):
            entities.decode_cursor(text, index, request)
    assert [page_limit(x) for x in (None, 0, 7, 9999)] == [100, 100, 7, 500]


def test_symbol_rank(spark):
    m = spark.createDataFrame([("r", "a/x.go", "Run", 1.0, 1), ("r", "a/y.go", "Runner", 1.0, 1), ("r", "run.go", "Other", 1.0, 1)], "repository string, path string, symbol string, score double, line_count int")
    got = [(r.symbol, r.rank_class) for r in rank(m, parse("run"), 5, "symbol_definition").collect()]
    assert got == [("Run", 3), ("Other", 2), ("Runner", 0)]


def test_yaml():
    assert config.parse_yaml("a: [1, 'x y', {b: c}]\nd:\n- e: 1\n  f: >\n    one\n    two\n- g\n") == {"a": [1, "x y", {"b": "c"}], "d": [{"e": 1, "f": "one two\n"}, "g"]}
    assert config.parse_yaml("") is None and config.parse_yaml("# only\n---\nx: 'it''s # not'\n...\nmore") == {"x": "it's # not"}
    for bad in ("a: *b\n", "a: 1\n   b: 2\nc", "- a\nb: c"):
        with pytest.raises(config.YamlError):
            config.parse_yaml(bad)


def test_peers(spark):
    for host, name, kind in (("API.Shop.co.uk.", "shop.co.uk", "external"), ("a.b.example.com", "example.com", "external"), ("10.1.2.3", "10.1.2.3", "address"), ("orders", "orders", "internal"), ("x.svc.cluster.local", "cluster.local", "internal"), ("localhost", "localhost", "loopback"), ("", "", "internal")):
        assert one(spark, F.struct(config.peer_name(F.lit(host)), config.peer_class(F.lit(host)))) == (name, kind)


def test_config_files(spark):
    assert config.mcp_servers(files(spark, ("a.json", '{"x": [{"mcp-servers": {"s": {"url": "https://h/x"}, "t": 1}}]}'), ("b.json", "mcp {"), ("c.json", "{}"))).count() == 2
    s, e = config.compose(files(spark, ("compose.yaml", "services:\n  a:\n    depends_on: [b, c]\n  b: {}\n"), ("x.yaml", "services:\n  z: {}\n"), ("compose.yml", "services: [\n")))
    assert rows(s.select("name", "alias_of")) == [("a", None), ("b", None)] and rows(e.select("source", "target", "resolved")) == [("a", "b", True), ("a", "c", False)]
    rank_ = lambda p: one(spark, config.assignment_rank(F.lit(p)))
    assert [rank_(p) for p in ("k8s/a.yaml", "src/application-prod.yml", "app/config/x.toml", ".env", "README.md", "k8s/README.md")] == [3, 2, 2, 1, 0, 0]
    assert [one(spark, config.assignment_environment(F.lit(p))) for p in ("a/us-east-1/x", "values-STAGING.yaml", "deploy/x")] == ["us-east-1", "staging", ""]
    kept = lambda k, v: one(spark, config.sanitized_value(F.lit(k), F.lit(v)))
    assert [kept("X", "postgres://u:p@db:5432/x"), kept("DB_HOST", "db:1"), kept("LEVEL", "db"), kept("A_URL", "vault:x"), kept("A_URL", "two words")] == ["postgres://db", "db", "", "", ""]


def test_locks(spark):
    lock = '{"packages": {"": {"version": "1"}, "node_modules/@s/a": {"version": "2"}, "node_modules/a/node_modules/b": {"version": "3"}}, "dependencies": {"@s/a": {"version": "9"}, "c": {"version": "4"}}}'
    assert rows(locks.npm_lock(files(spark, ("package-lock.json", lock), ("x", "no json"), ("y", None))).select("package", "version")) == [("@s/a", "2"), ("c", "4")]
    d = spark.createDataFrame([("r", "l", "pypi", "A_b", "==2"), ("r", "l", "pypi", "one", ">=9"), ("r", "l", "pypi", "gone", "1")], "repository string, lock string, ecosystem string, package string, declared string")
    have = spark.createDataFrame([("r", "l", "a-B", "1"), ("r", "l", "a-B", "v2"), ("r", "l", "one", "7")], "repository string, path string, package string, version string")
    assert rows(locks.locked_versions(d, have).select("package", "resolved")) == [("A_b", "v2"), ("gone", None), ("one", "7")]
    g = "def v = '1.0'\nimplementation \"a.b:c:${v}\"\ntestImplementation('x:y:$z')\napi \"$g:q:1\"\nkapt 'p:r'\nimplementation project(':k:l')\n"
    assert rows(locks.gradle(files(spark, ("build.gradle", g))).select("package", "declared", "usage")) == [("a.b:c", "1.0", "production"), ("p:r", "", "build"), ("project:k/l", "", "production"), ("x:y", "", "test")]
    py = '[project]\ndependencies = ["a>=1", \'b[x]==2 ; python_version<"4"\']\nname = "n"\n[tool.poetry.group.test.dependencies]\npython = "^3"\npytest = {version = "8", extras = ["q"]}\n[other]\nc = "1"\n'
    assert rows(locks.pyproject(files(spark, ("pyproject.toml", py))).select("package", "declared", "usage")) == [("a", ">=1", "production"), ("b", "==2", "production"), ("pytest", "8", "test")]


def test_long_dependency_lists(spark):
    """Lists of thousands, one item a line or all on one: neither is too deep for the matcher's stack."""
    n, item = 20_000, lambda i: f'"lib-{i}[x,y]>=1.{i}"'
    lines = "[project]\ndependencies = [ # all\n" + "\n".join(f"  {item(i)}, # why" for i in range(n)) + "\n]\n[project.optional-dependencies]\ntests = [" + ", ".join(map(item, range(n))) + "] # [z]\n"
    got = locks.pyproject(files(spark, ("pyproject.toml", lines))).groupBy("usage", F.concat("package", "declared").alias("p")).count()
    assert rows(got.groupBy("usage").agg(F.count("*"), F.max("count"), F.count_if(F.col("p").rlike(r"^lib-(\d+)>=1\.\1$")))) == [("production", n, 1, n), ("test", n, 1, n)]


@pytest.mark.parametrize("path", ["/srv/checkouts/0003/other-name", "plain", "", None])
def test_selectors_follow_the_tables(spark, tmp_path, path):
    """Another folder's repositories have other names and paths; the SQL asks for their ids."""
    repositories = [(3, "other-name", path), (17, "other-name", "/srv/checkouts/0017/other-name"), (18, "x", None)]
    spark.createDataFrame(repositories, "id long, name string, path string").write.parquet(f"{tmp_path}/repositories.parquet")
    spark.createDataFrame([(i, f"NATION_{i}") for i in (7, 17)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert rows(queries_fleet.graph_selector(spark, str(tmp_path))) == [("nation:7", "NATION_7"), ("repo:17", "other-name-17"), ("repo:3", "other-name-3")]


def test_scip_rejects_whole_indexes():
    doc = ("a.go", "Go", [("s 1 x#", 3, 0, 4, True), ("local 1", 4, 0, 1, False)], [("s 1 x#", ["s 1 y#"])])
    symbols, spots = scip.read_index(scip.write_index([doc]))
    assert [s["symbol"] for s in symbols] == ["s 1 x#", "local 1"] and symbols[0]["relationships"][0]["implementation"] and spots[0][2:] == ("s 1 x#", 3, 0, 3, 4, True)
    for bad in (scip.write_index([doc, doc]), scip.write_index([("a.go", "Go", [("s", 3, 9, 4, True)], [])]), b"\x12\x7f", b"\x80"):
        with pytest.raises(scip.ScipError):
            scip.read_index(bad)


def test_declarations_and_patterns(spark):
    java = '@Service public class A extends B implements C<D> {\n  // class Not {}\n  @Get("/x")\n  public String run(int a) throws Q { return foo.bar("{"); }\n  private int y() { return 1; }\n}\n'
    language, nodes, rel = syntax_nodes.analyze("A.java", java)
    assert language == "java" and [(n.kind, n.name, n.line, n.end_line, n.parent) for n in nodes] == [("class_declaration", "A", 1, 6, -1), ("method_declaration", "run", 4, 4, 0), ("method_declaration", "y", 5, 5, 0)]
    assert nodes[0].annotations == ["Service"] and nodes[1].annotations == ["Get"] and nodes[2].modifiers == ["private"]
    assert ("extends", "B", 1) in rel and ("implements", "C", 1) in rel and ("call", "foo.bar", 4) in rel
    for path, text, want in (
        ("a.go", "package a\nimport \"fmt\"\nfunc (t *T) M(x int) error {\n}\nfunc F[K any](k K) {}\ntype T struct {\n}\n", ["M", "F", "T"]), ("a.ts", "export class P { go() { x(); } }\nconst f = (a) => { return 1; }\nfunction g() {}\n", ["P", "go", "f", "g"]),
        ("a.kt", "class K : Base() { fun m() {} }\nfun String.ext() = 1\n", ["K", "m", "ext"]), ("a.py", "class X:\n  def y(self): pass\n", ["X", "y"]), ("a.sql", "CREATE TABLE IF NOT EXISTS s.t (x int);", ["s.t"]), ("a.sh", "go() {\n}\nfunction stop {\n}\n", ["go", "stop"]), ("a.java", "class {{{ (", []), ("x.txt", "class A {}", []),
    ):
        assert [n.name for n in syntax_nodes.analyze(path, text)[1]] == want, path
    hits = syntax_nodes.structural_search(files(spark, ("A.java", java), ("B.java", None), ("C.java", "")), '(class_declaration name: (identifier) @c body: (class_body (method_declaration name: (identifier) @m))) (#not-eq? @m "y")')
    assert rows(hits.select("capture", "name", "line")) == [("c", "A", 1), ("m", "run", 4)]
    for bad in ("", "class", "(a"):
        with pytest.raises(ValueError):
            syntax_nodes.parse_pattern(bad)


def test_reach_edges_and_roots(spark):
    df = spark.createDataFrame([("a", "b", "call"), ("a", "b", "call"), ("c", "i", "implements"), ("a", "x", "import"), ("a", "a", "call")], "source string, target string, kind string")
    assert rows(graph.reach_edges(df).select("src", "dst", "kind")) == [("a", "b", "call"), ("i", "c", "implements")]
    state = graph.verdicts(spark.createDataFrame([("a", True, True), ("b", True, True), ("c", True, False), ("d", False, True)], "node string, private boolean, complete boolean"), spark.createDataFrame([("a",)], "node string"))
    assert rows(state.select("node", "state")) == [("a", "reachable"), ("b", "probably_unreachable"), ("c", "unknown"), ("d", "public")]
    assert tuple(graph.summary(state).first()) == (4, 1, 1, 1, 1)


def test_topology_summary_of_nothing(spark):
    none = topology.summary(spark.createDataFrame([], "id string, kind string, candidate boolean"), spark.createDataFrame([], "source string, target string, protocol string, state string, resolved boolean")).first()
    assert set(none) == {0}
    with pytest.raises(ValueError):
        topology.connection_predicate(origin="elsewhere")


def test_services(spark):
    texts = spark.createDataFrame([(1, '{"issues": [{"rule": "r", "severity": "BLOCKER", "component": "p:a.py", "status": "OPEN", "key": "k"}], "projectStatus": {"conditions": [{"metricKey": "c", "status": "ERROR", "actualValue": "3"}]}}'), (2, "no"), (3, None)], "report_id int, text string")
    assert rows(services.sonar(texts).select("kind", "key", "severity", "path", "state")) == [("finding", "r", "error", "a.py", "current"), ("gate", "c", None, None, "error")]
    assert [one(spark, services.backoff_seconds(F.lit(n))) for n in (0, 1, 3, 40)] == [60, 60, 240, 21600]
    listing = spark.createDataFrame([("/a/.git/HEAD",), ("/b.git/HEAD",), ("/b.git/objects/x",), ("/b.git/refs/y",), ("/c/HEAD",)], "path string")
    assert rows(services.discover_repositories(listing)) == [("/a", "a", False), ("/b.git", "b", True)]


def test_states_of_indexing(spark):
    r = spark.createDataFrame([(1, "h2", "h1", "pending"), (2, "h", None, "pending"), (3, "h", "h", "ready"), (4, "h", None, "pending")], "repository_id long, head string, indexed string, state string")
    done = spark.createDataFrame([(1, "h1", True), (2, "h", False), (2, "h", True), (4, "h", False)], "repository_id long, head string, ok boolean")
    assert rows(indexing.next_states(r, done).select("repository_id", "indexed", "state")) == [(1, "h1", "pending"), (2, "h", "ready"), (3, "h", "ready"), (4, None, "error")]
    jobs = spark.createDataFrame([(1, "h", "g"), (1, "h", "g"), (1, "h", "s")], "repository_id long, head string, artifact string")
    assert indexing.queue_jobs(jobs, jobs.filter("artifact = 's'")).count() == 1


def test_snapshots_are_whole(spark, scratch):
    root = scratch.root + "/snaps"
    assert sinks.current_snapshot(spark, scratch.root) is None
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, scratch.root)
    sinks.publish_snapshot(spark.range(3), root)
    half = sinks.current_snapshot(spark, root)
    spark.range(9).write.parquet(f"{root}/snapshot-halfway")
    assert sinks.read_snapshot(spark, root).count() == 3 and sinks.remove_superseded(spark, root) == 1
    sinks.publish_snapshot(spark.range(5), root)
    assert sinks.current_snapshot(spark, root) != half and sinks.read_snapshot(spark, root).count() == 5


def test_packages_and_imports(spark):
    from strataquery.operators import packages

    f = spark.createDataFrame([("r", "main.go"), ("r", "a/x_test.go"), ("r", "cmd/t/m.go"), ("r", "b/y.go")], "repository string, path string")
    assert rows(packages.go_packages(f).select("package", "label", "entrypoint")) == [("", "r", False), ("b", "b", False), ("cmd/t", "t", True)]
    i = spark.createDataFrame([("r", "main.go", "m.x/b"), ("r", "main.go", "m.xy/b"), ("r", "main.go", "m.x/none"), ("r", "b/y.go", "m.x/b"), ("r", "b/y_test.go", "q/z/v2")], "repository string, path string, target string")
    m = spark.createDataFrame([("r", "m.x")], "repository string, module string")
    assert rows(packages.import_edges(i, m, packages.go_packages(f)).select("source", "target")) == [("", "b")]
    d = spark.createDataFrame([("r", "q/z"), ("r", "q"), ("r", "q/zz"), ("s", "q")], "repository string, package string")
    assert rows(packages.dependency_usage(i, d)) == [("r", "q", 1, "test"), ("r", "q/z", 1, "test"), ("r", "q/zz", 0, "unused"), ("s", "q", 0, "unused")]
    t = spark.createDataFrame([("only", "k8s/a.yaml"), ("only", "README.md"), ("both", "k8s/a.yaml"), ("both", "x.py"), ("none", "x.txt")], "repository string, path string")
    assert rows(packages.deployment_only(t)) == [("only",)]


def test_service_lines(spark):
    from strataquery.operators.search import lines
    from strataquery.sources import extract

    text = 'c = grpc.NewClient("orders:443")\nurl: mongodb+srv://u:p@Db.x/y\nplain grpc words\nimport "@modelcontextprotocol/sdk"\n'
    assert rows(extract.service_lines(lines(files(spark, ("a", text)))).select("number", "protocol", "target")) == [(1, "grpc", "orders"), (2, "mongodb+srv", "db.x"), (4, "mcp", "r")]


def test_reachability_report(spark, scratch):
    from strataquery.operators import reachability

    go = "package a\nfunc main() {\n\tstep()\n}\nfunc step() {\n\tother()\n}\nfunc lone() {\n}\nfunc Open() {\n}\n"
    java = "@Service class S extends Base {\n  private void unused() { }\n  void used() { helper(); }\n}\nclass Base {\n  void twice() { }\n}\n"
    data = [("r", "a.go", go, 1), ("r", "a.go", go, 1), ("r", "b.go", "package a\nfunc other() {\n}\n", 2), ("s", "S.java", java, 3), ("t", "c.go", "package c\nfunc lone() {\n}\n", 4), ("t", "d.go", None, 5)]
    got = {(r.repository, r.name): r for r in reachability.report(spark.createDataFrame(data, "repository string, path string, text string, file_id long"), scratch).collect()}
    assert {k: v.state for k, v in got.items() if k[0] == "r"} == {("r", "main"): "reachable", ("r", "step"): "reachable", ("r", "other"): "reachable", ("r", "lone"): "probably_unreachable", ("r", "Open"): "public"}
    assert got["r", "main"].root == "main" and got["r", "other"].distance == 2 and "#step#" in got["r", "other"].parent and got["r", "main"].parent is None
    assert got["s", "S"].state == "reachable" and got["s", "unused"].state == "probably_unreachable" and got["t", "lone"].state == "unknown"
    assert got["s", "Base"].state == "public"  # reaching what extends a base says nothing of the base
