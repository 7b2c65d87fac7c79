import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from strataquery.functions import versions
from strataquery.functions.scalars import branch_points, citation, cvss3_score, cvss4_band, glob_regex, service_name
from strataquery.operators import dependencies, graph, history, insights, ownership, search, store, topology
from strataquery.plans.lang import QueryError, parse
from strataquery.sources import extract, manifests, reports
from strataquery.streaming import monitors


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "eco,ordered",
    [
        ("npm", ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0", "2.0.0"]),
        ("go", ["v0.9.0", "v1.0.0-rc.1", "v1.0.0", "v1.0.1"]),
        ("maven", ["1.0-alpha-1", "1.0-beta-2", "1.0-m3", "1.0-rc1", "1.0-SNAPSHOT", "1.0", "1.0-sp1", "1.1", "1.10"]),
        ("pypi", ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.1", "1!0.1"]),
    ],
)
def test_version_order(spark, eco, ordered):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v string").select("i", versions.version_key(F.lit(eco), F.col("v")).alias("k"))
    assert [r.i for r in df.orderBy("k").collect()] == list(range(len(ordered)))
    assert df.select("k").distinct().count() == len(ordered)


def test_equal_versions(spark):
    assert one(spark, versions.semver_key(F.lit("1.2")) == versions.semver_key(F.lit("v1.2.0")))
    assert one(spark, versions.loose_key(F.lit("1.2")) == versions.loose_key(F.lit("1.2.0.0")))


def test_long_versions_keep_their_order(spark):
    stamps = ["0.0.0-20210315123456", "0.0.0-20210315125959", "0.0.0-120210315125959"]
    for eco, ordered in (
        ("npm", [*stamps, "0.0.0", "0.0.0.0.7", "0.0.1", "1", "1.0.0.0.1-rc", "1.0.0.0.1", "1.0.0.0.2", "1.9", "1.12345678901", "1.12345678902", "1.112345678901"]),
        ("maven", ["1.2.3.4.5-rc1", "1.2.3.4.5", "1.2.3.4.5.6", "1.2.3.4.5.7", "1.2.3.5-alpha-12345678901", "1.2.3.5-alpha-12345678902", "1.2.3.5", "1.20210315123456", "1.20210315125959"]),
        ("pypi", ["1.2.3.4.5rc1", "1.2.3.4.5", "1.2.3.4.5.6", "1.2.3.4.5.7", "1.20210315123456", "1.20210315125959", "1!0"]),
    ):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v string").select("i", versions.version_key(F.lit(eco), F.col("v")).alias("k"))
        assert [r.i for r in df.orderBy("k").collect()] == list(range(len(ordered))), eco
        assert df.select("k").distinct().count() == len(ordered), eco
    assert one(spark, versions.loose_key(F.lit("1.20210315123456")) < versions.loose_key(F.lit("1.20210315125959")))
    assert one(spark, versions.maven_key(F.lit("1.2.3.4.5.6.0.0")) == versions.maven_key(F.lit("1.2.3.4.5.6")))
    assert one(spark, versions.version_key(F.lit("npm"), F.lit(None).cast("string"))) is None


EV = "array<struct<introduced:string,fixed:string,last_affected:string,`limit`:string>>"


@pytest.mark.parametrize(
    "events,inside,outside",
    [
        ([("0", None, None, None), (None, "1.2.0", None, None)], ["0.1.0", "1.1.9", "1.2.0-rc.1"], ["1.2.0", "2.0.0"]),
        ([("1.0.0", "", None, None), (None, None, "1.5.0", None)], ["1.0.0", "1.5.0"], ["0.9.0", "1.5.1"]),
        ([("1.0.0", None, None, None)], ["1.0.0", "9.0.0"], ["0.9.0"]),
        ([(None, "1.2.0", None, None), ("0", None, None, None), ("2.0.0", None, None, None), (None, "2.1.0", None, None)], ["1.0.0", "2.0.5"], ["1.3.0", "2.1.0"]),
        ([("0", None, None, None), (None, None, None, "*")], ["5.0.0"], []),
        ([], [], ["1.0.0"]),
    ],
)
def test_ranges(spark, events, inside, outside):
    df = spark.createDataFrame([(v, events) for v in inside + outside], f"v string, e {EV}")
    got = {r.v for r in df.filter(versions.in_events(F.col("v"), F.col("e"), versions.semver_key)).collect()}
    assert got == set(inside)


def test_advisory_match_and_fix(spark):
    decl = spark.createDataFrame([("PyPI", "My_Pkg", "1.0"), ("pypi", "my-pkg", "3.0"), ("npm", "left", "1.0.0"), ("npm", "none", "1.0.0")], "ecosystem string, package string, version string")
    adv = spark.createDataFrame([(1, [("PyPI", "my.pkg", [([("0", None, None, None), (None, "2.0", None, None)],)], None), None]), (2, [("npm", "left", None, ["1.0.0"])]), (3, None)], f"record_id long, affected array<struct<ecosystem:string,name:string,ranges:array<struct<events:{EV}>>,versions:array<string>>>")
    got = rows(dependencies.match_advisories(decl, adv).select("record_id", "version", "fixed"))
    assert got == [(1, "1.0", "2.0"), (2, "1.0.0", None)]


def test_status_and_distance(spark):
    data = [("v1.2.0", "1.2.0", True), ("1.0", "2.0", True), ("2.1", "2.0", True), ("1.0-rc1", "1.0", True), ("^1", "2.0", False), ("1", None, True), ("1.2.3", "1.2.9", True), ("1.2.3", "1.4.0", True)]
    df = spark.createDataFrame(data, "v string, l string, e boolean").withColumn("s", versions.status(F.col("v"), F.col("l"), F.col("e")))
    got = [(r.s, r.d) for r in df.withColumn("d", versions.distance(F.col("v"), F.col("l"), F.col("s"))).collect()]
    assert got == [("current", "none"), ("behind", "major"), ("ahead", "unknown"), ("prerelease", "unknown"), ("unresolved", "unknown"), ("unavailable", "unknown"), ("behind", "patch"), ("behind", "minor")]


def test_scores(spark):
    assert one(spark, cvss3_score(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"))) == 9.8
    assert one(spark, cvss3_score(F.lit("CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:C/C:H/I:H/A:H"))) == 9.9
    assert one(spark, cvss3_score(F.lit("CVSS:3.1/AV:N"))) is None
    assert one(spark, cvss4_band(F.lit("CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H"))) == "critical"
    sev = spark.createDataFrame([(1, [("CVSS_V3", "9.8")]), (2, [("x", ""), ("y", None)]), (3, None), (4, [("a", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:L/A:N"), ("b", "4.2")])], "i int, s array<struct<type:string,score:string>>")
    assert [r.b for r in sev.select(dependencies.advisory_severity(F.col("s")).alias("b")).collect()] == ["critical", "unknown", "unknown", "high"]


def test_names(spark):
    assert one(spark, service_name(F.lit(" HTTP://My_Svc.ns:80/x "))) == "my-svc"
    assert one(spark, citation(F.lit("r"), F.lit("0123456789"), F.lit("p"), F.lit(3), F.lit(5))) == "r@01234567:p#L3-L5"
    assert one(spark, branch_points(F.lit("if a and b:\n  for x in y:\n"), "Python")) == 3


@pytest.mark.parametrize("pattern,yes,no", [("*.go", ["a.go", "x/y.go"], ["a.gox"]), ("/src/", ["src", "src/a/b"], ["x/src/a"]), ("docs/**/a?.md", ["docs/x/ab.md", "docs/x/y/ac.md"], ["docs/x/a.md"]), ("build", ["build", "x/build"], ["build/x"])])
def test_globs(pattern, yes, no):
    import re

    regex = re.compile(glob_regex(pattern))
    assert all(regex.match(p) for p in yes) and not any(regex.match(p) for p in no)


def test_globs_that_never_match():
    assert [glob_regex(p) for p in ("!x", "[ab]", "", "/")] == [None] * 4


def test_owners(spark):
    text = "# c\n* @all\n\n/a/ @x bad\n/b/ nobody\n*.md docs@example.org\r\n!no @y\n"
    paths = spark.createDataFrame([("r", p) for p in ("z", "a/b", "b/c", "a/x.md")] + [("s", "z")], "repository string, path string")
    got = {r.path + r.repository: (r.state, r.owners, r.rule_line) for r in ownership.resolve(paths, ownership.rule_table(spark, {"r": text})).collect()}
    assert got == {"zr": ("owned", "@all", 2), "a/br": ("unresolved_owner", "@x", 4), "b/cr": ("unresolved_owner", "", 5), "a/x.mdr": ("owned", "docs@example.org", 6), "zs": ("unavailable", "", None)}


def test_search_and_ranking(spark):
    files = spark.createDataFrame([("r", "service.go", "Go", "service\nx Service"), ("r", "service_worker.go", "Go", "service"), ("r", "internal/payment_service.go", "Go", "a service"), ("r", "tests/service.go", "Go", "service"), ("r", "n.py", "Python", None), ("r", "o.py", "Python", "other")], "repository string, path string, language string, text string")
    q = parse("service")
    m = search.search_content(files, q).withColumn("score", F.col("match_count").cast("double"))
    got = [r.path for r in search.rank(m, q, 10).collect()]
    assert got == ["service.go", "service_worker.go", "tests/service.go", "internal/payment_service.go"]
    assert rows(m.select("path", "match_count", "line_count", "first_line"))[1] == ("service.go", 2, 2, 1)
    total = search.totals(m, 3).first()
    assert (total.total_files, total.total_matches, total.truncated) == (4, 5, True)
    assert search.totals(m, 4).first().truncated is False
    assert sum(r["count"] for r in search.facets(m, ["language"]).collect()) == 4
    assert rows(search.search_content(files, parse("service lang:python lang:go -path:tests file:worker")).select("path")) == [("service_worker.go",)]
    assert search.rank(m, q, 2).count() == 2


def test_history(spark):
    q = parse("fix author:ann author:bob after:2025-01-02 before:2025-01-03 -message:wip")
    t = lambda d, h=0: dt.datetime(2025, 1, d, h)
    df = spark.createDataFrame([("Ann", "Fix a", t(2)), ("bob", "fix b", t(3, 23)), ("bob", "fix wip", t(3)), ("eve", "fix", t(3)), ("ann", "fix", t(4))], "a string, m string, t timestamp_ntz")
    assert rows(df.filter(history.commit_predicate(q, F.col("a"), F.col("m"), F.col("t"))).select("m")) == [("Fix a",), ("fix b",)]
    with pytest.raises(QueryError):
        history.commit_predicate(parse("after:2025-01-02 after:2025-01-03"), F.col("a"), F.col("m"), F.col("t"))
    d = history.diff_sides(spark.createDataFrame([("--- a\n+++ b\n+x\n-y\n z\n+",)], "patch string")).first()
    assert (d.added, d.removed) == ("x\n", "y")


EDGES = [("e1", "api", "billing"), ("e2", "billing", "ledger"), ("e3", "ledger", "api"), ("e4", "api", "audit"), ("e5", "audit", "ledger")]


def test_graph(spark, scratch):
    e = spark.createDataFrame(EDGES, "id string, src string, dst string")
    start = spark.createDataFrame([("api",)], "node string")
    assert rows(graph.impact(e, start, 1, scratch)) == [("api", 0), ("audit", 1), ("billing", 1)]
    assert rows(graph.impact(e, start, 0, scratch)) == [("api", 0)]
    assert rows(graph.reachable(e, start, scratch)) == [("api", 0), ("audit", 1), ("billing", 1), ("ledger", 2)]
    assert rows(graph.shortest_path(e, "api", "ledger", scratch)) == [(0, "api"), (1, "audit"), (2, "ledger")]
    assert rows(graph.shortest_path(e, "api", "nowhere", scratch)) == []
    assert rows(graph.shortest_path(e, "api", "api", scratch)) == [(0, "api")]
    with pytest.raises(ValueError):
        graph.impact(e, start, 7, scratch)
    nodes = spark.createDataFrame([("1", "Api", "p"), ("2", "api2", "q"), ("3", "dup", "x"), ("4", "dup", "y")], "id string, label string, path string")
    assert graph.resolve_selector(nodes, "API") == "1" and graph.resolve_selector(nodes, "pi2") == "2"
    for bad in ("dup", "zzz"):
        with pytest.raises(ValueError):
            graph.resolve_selector(nodes, bad)


def test_tightest_container(spark):
    spans = spark.createDataFrame([("f", 1, 500, "outer"), ("f", 60, 70, "inner"), ("f", 64, 64, "line")], "k string, lo long, hi long, name string")
    points = spark.createDataFrame([("f", 64), ("f", 65), ("f", 400), ("f", 900), ("g", 1)], "k string, at long")
    assert rows(graph.tightest_container(points, spans, ["k"], "at")) == [("f", 400, "outer"), ("f", 64, "line"), ("f", 65, "inner")]


def test_runtime_merge(spark):
    key = ["source", "target", "protocol", "environment"]
    static = spark.createDataFrame([("a", "b", "http", "prod"), ("a", "c", "http", ""), ("a", "d", "http", "dev")], ", ".join(f"{k} string" for k in key))
    runtime = spark.createDataFrame([("a", "b", "http", "prod"), ("a", "c", "http", "prod"), ("a", "d", "http", "prod")], ", ".join(f"{k} string" for k in key))
    got = {(r.target, r.environment): r.state for r in topology.merge_static_runtime(static, runtime, key).collect()}
    assert got == {("b", "prod"): "confirmed", ("c", "prod"): "confirmed", ("d", "prod"): "runtime_only", ("d", "dev"): "static_only"}


def test_coverage_importers(spark):
    lcov = "TN:\nSF: a.go\nLF:4\nLH:2\nBRF:x\nend_of_record\nLF:99\nSF:b.go\nSF:c.go\nLF:0\n"
    jacoco = '<report><package name="p"><sourcefile name="A.java"><counter type="LINE" missed="1" covered="3"/><counter type="BRANCH" missed="2" covered="0"/></sourcefile></package></report>'
    cob = '<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="1"/><line number="2" hits="0" branch="true" condition-coverage="50% (1/2)"/></lines></class><class filename="a.py"><lines><line number="2" hits="3"/></lines></class></classes></package></packages></coverage>'
    t = lambda x: spark.createDataFrame([(1, x)], "report_id int, text string")
    cols = ["path", "lines_found", "lines_hit", "branches_found", "branches_hit"]
    assert rows(reports.lcov(t(lcov)).select(cols)) == [("a.go", 4, 2, 0, 0), ("b.go", 0, 0, 0, 0), ("c.go", 0, 0, 0, 0)]
    assert rows(reports.jacoco(t(jacoco)).select(cols)) == [("p/A.java", 4, 3, 2, 0)]
    assert rows(reports.cobertura(t(cob)).select(cols)) == [("a.py", 2, 2, 2, 1)]
    m = reports.coverage_metrics(reports.coverage_total(reports.lcov(t(lcov)), ["report_id"]), ["report_id", "path"])
    got = {r.metric: (r.value, r.state) for r in m.collect()}
    assert got["coverage.line"] == (50.0, "measured") and got["coverage.branch"] == (None, "skipped")


def test_sarif_and_semgrep(spark):
    log = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"t","rules":[{"id":"R0"},{"id":"R1"}]}},"results":[{"ruleIndex":1,"level":"Warning","message":{"text":" m "},"partialFingerprints":{"z":"1","b":" ","c":"2"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"file://a/b.go"},"region":{"startLine":3}}}],"suppressions":[{"kind":"x"}]},{"ruleId":"X","level":"blocker"}]}]}'
    df = spark.createDataFrame([(1, log), (2, log.replace("2.1.0", "2.0.0")), (3, None), (4, "{")], "report_id int, text string")
    got = [(r.key, r.severity, r.message, r.path, r.start_line, r.fingerprint, r.suppressed) for r in reports.sarif(df).orderBy("result_no").collect()]
    assert got == [("R1", "warning", "m", "a/b.go", 3, "2", True), ("X", "error", "", "", None, "", False)]
    sem = '{"results":[{"check_id":"c","path":"a\\\\b.py","start":{"line":1},"end":{"line":2},"extra":{"severity":"INFO","message":"m"}}]}'
    assert [(r.key, r.severity, r.path) for r in reports.semgrep(spark.createDataFrame([(1, sem)], "report_id int, text string")).collect()] == [("c", "note", "a/b.py")]
    out = reports.to_sarif(spark.createDataFrame([(1, "K", "high", "m", "p", 4), (1, "A", "low", "m", "p", 1)], "repository_id int, key string, severity string, message string, path string, start_line int"), ["key"]).first()
    again = reports.sarif(spark.createDataFrame([(1, out.text)], "report_id int, text string"))
    assert [(r.key, r.severity, r.start_line) for r in again.orderBy("result_no").collect()] == [("A", "note", 1), ("K", "error", 4)]


def test_manifests(spark):
    f = lambda p, t: spark.createDataFrame([("r", p, t)], "repository string, path string, text string")
    got = lambda d: rows(d.select("package", "declared", "usage"))
    assert got(manifests.go_mod(f("go.mod", "module m\nrequire x.y/a v1.0.0\nrequire (\n\tx.y/b v2.0.0 // indirect\n)\n"))) == [("x.y/a", "v1.0.0", "production"), ("x.y/b", "v2.0.0", "indirect")]
    assert got(manifests.package_json(f("package.json", '{"dependencies":{"a":"^1"},"devDependencies":{"a":"2","b":"3"},"optionalDependencies":{"c":"1"}}'))) == [("a", "^1", "production"), ("b", "3", "development"), ("c", "1", "optional")]
    assert got(manifests.requirements(f("test/dev.txt", "# x\n-r y\nFlask[async]>=2 ; python_version>'3'\n\nq==1 # c\n"))) == [("Flask", ">=2", "test"), ("q", "==1", "test")]
    assert got(manifests.cargo_toml(f("Cargo.toml", '[dependencies]\na = "1"\nb = { package = "bb", git = "u" }\n[dev-dependencies]\nc = { path = "p" }\n[x]\nd = "1"\n'))) == [("a", "1", "production"), ("bb", "git+u", "production"), ("c", "file:p", "test")]
    pom = "<project><properties><v>1.5</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version><scope>test</scope></dependency></dependencies></project>"
    assert got(manifests.maven_pom(f("pom.xml", pom))) == [("g:a", "1.5", "test")]
    m = spark.createDataFrame([("r", "a/b/package.json"), ("r", "c/package.json"), ("s", "package.json")], "repository string, path string")
    locks = spark.createDataFrame([("r", "a/package-lock.json"), ("r", "package-lock.json")], "repository string, path string")
    assert rows(manifests.nearest_lockfile(m, locks).select("path", "lock")) == [("a/b/package.json", "a/package-lock.json"), ("c/package.json", "package-lock.json"), ("package.json", None)]


def test_extraction(spark):
    f = lambda p, t: spark.createDataFrame([("r", p, t)], "repository string, path string, text string")
    assert rows(extract.symbols(f("a.go", "func (s *S) Run(x int) {}\ntype T struct {}\n")).select("kind", "name")) == [("function", "Run"), ("type", "T")]
    assert rows(extract.symbols(f("a.py", "class A:\n  async def f(x):\n    pass\n")).select("kind", "name")) == [("class", "A"), ("function", "f")]
    assert rows(extract.go_routes(f("a.go", 'mux.HandleFunc("GET /a/{id}", h)\nr.Post("/b", h)')).select("verb", "route")) == [("ANY", "/b"), ("GET", "/a/{id}")]
    assert rows(extract.spring_routes(f("A.java", '@RequestMapping("/api")\nclass A {\n@GetMapping("/x")\nvoid a() {}\n@PostMapping\nvoid b() {}\n}')).select("verb", "route")) == [("GET", "/api/x"), ("POST", "/api")]
    lines = search.lines(f("x.env", "A_B=1\nexport TOKEN='q'\nURL: ${X}\nsee https://u@Host.example:80/p and kafka://k1\n"))
    assert rows(extract.assignments(lines).select("variable", "value", "indirect")) == [("A_B", "1", False), ("TOKEN", "", False), ("URL", "", True)]
    assert rows(extract.endpoints(lines).select("protocol", "host")) == [("https", "host.example"), ("kafka", "k1")]
    assert rows(extract.match_route(spark.createDataFrame([("/a/1",), ("/a/1/2",), ("/b",)], "called string"), spark.createDataFrame([("/a/{x}",), ("/:y",), ("/a/2",)], "route string"))) == [("/a/1", "/a/{x}"), ("/b", "/:y")]
    assert rows(extract.references(spark.createDataFrame([("foo_bar",), ("x.foo(1)",), ("foo",)], "line string"), "foo").select("line")) == [("foo",), ("x.foo(1)",)]


def test_reconcile_and_retention(spark):
    rep = spark.createDataFrame([(1, "/build/w/src/A.go"), (1, "src/b.go"), (1, "x.go"), (1, "none.go"), (1, "a%20b.go")], "repository_id int, raw string")
    idx = spark.createDataFrame([(1, "src/a.go"), (1, "src/b.go"), (1, "p/x.go"), (1, "x.go"), (1, "a b.go"), (2, "none.go")], "repository_id int, path string")
    got = {r.raw: (r.path, r.state) for r in insights.suffix_reconcile(rep, idx).collect()}
    assert got == {"/build/w/src/A.go": ("src/a.go", "suffix"), "src/b.go": ("src/b.go", "exact"), "x.go": ("x.go", "exact"), "none.go": (None, "unresolved"), "a%20b.go": ("a b.go", "exact")}


def test_fail_closed(spark):
    data = spark.createDataFrame([(1, "a"), (2, "b")], "repository_id int, x string")
    assert store.visible(data, spark.createDataFrame([], "repository_id int")).count() == 0
    assert rows(store.visible(data, spark.createDataFrame([(2,), (2,)], "repository_id int"))) == [(2, "b")]


def test_catalogue_sync(spark):
    known = spark.createDataFrame([("a", "1", 0, "ready"), ("b", "1", 2, "ready"), ("c", "1", 0, "ready"), ("d", "1", 1, "error")], "path string, head string, discovery_misses int, state string")
    found = spark.createDataFrame([("a", "1"), ("c", "2"), ("e", "9")], "path string, head string")
    assert rows(store.sync_catalogue(known, found)) == [("a", "1", 0, "ready"), ("c", "2", 0, "pending"), ("d", "1", 2, "error"), ("e", "9", 0, "pending")]


def test_streaming_monitor_resumes(spark, tmp_path):
    schema = monitors.SCHEMA
    t = lambda h: dt.datetime(2025, 1, 1, h)
    src, dst, ck = (f"{tmp_path}/{x}" for x in ("src", "dst", "ck"))
    spark.createDataFrame([(1, "m", "s", ["a"], "complete", t(1)), (2, "m", "s", ["b"], "complete", t(2)), (9, "n", "s", ["q"], "complete", t(1))], schema).write.mode("append").parquet(src)
    monitors.run_monitors(spark, src, dst, ck)
    spark.createDataFrame([(3, "m", "s", ["b", "c"], "complete", t(3)), (4, "m", "other", ["z"], "complete", t(4)), (5, "m", "s", [], "failed", t(5))], schema).write.mode("append").parquet(src)
    monitors.run_monitors(spark, src, dst, ck)
    spark.createDataFrame([(10, "n", "s", [], "complete", t(6))], schema).write.mode("append").parquet(src)
    monitors.run_monitors(spark, src, dst, ck)
    got = rows(spark.read.parquet(f"{dst}/changes").select("id", "added", "removed", "state"))
    assert got == sorted([(2, ["b"], ["a"], "complete"), (3, ["c"], [], "complete"), (4, [], [], "incomplete"), (10, [], ["q"], "complete")], key=repr)
