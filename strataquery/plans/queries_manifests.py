"""Manifests, locks and reports: texts are made of the tables, read back, and compared with what they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import table
from ..sources import extract, locks, manifests, reports, services
from .queries_facts import _counts, _COUNTS


def _packages(spark, sf_dir: str) -> DataFrame:
    """One declared package a part: a repository for each brand, a folder for each size, a usage for every fifth."""
    k = F.col("p_partkey")
    version = F.concat_ws(".", k % 7, k % 11, k % 5)
    usage = F.when(k % 5 == 0, "test").otherwise("production")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.lower("p_brand").alias("repository"), F.concat(F.lit("m"), "p_size").alias("folder"), F.concat(F.lit("lib-"), k).alias("package"), version.alias("version"), usage.alias("usage"))


_PACKAGES = "p as (select p_partkey as k, lower(p_brand) as repository, 'm' || p_size as folder, 'lib-' || p_partkey as package, (p_partkey % 7) || '.' || (p_partkey % 11) || '.' || (p_partkey % 5) as version, case when p_partkey % 5 = 0 then 'test' else 'production' end as usage from part)"


def _texts(rows: DataFrame, name: str, line: Column, head: str = "", foot: str = "", sep: str = "\n", keep: Column | None = None) -> DataFrame:
    """One text for each repository and folder, of a line a package, in order of its key."""
    kept = rows if keep is None else rows.filter(keep)
    per = kept.select("repository", "folder", F.struct("k", line.alias("line")).alias("x")).groupBy("repository", "folder").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), sep).alias("body"))
    return per.select("repository", F.concat(F.col("folder"), F.lit("/" + name)).alias("path"), F.concat(F.lit(head), "body", F.lit(foot)).alias("text"))


def _with_both(a: DataFrame, b: DataFrame, join: str) -> DataFrame:
    return a.join(b.withColumnRenamed("text", "_b"), ["repository", "path"], "full").select("repository", "path", F.concat_ws(join, "text", "_b").alias("text"))


_OUT = ["repository", "path", "ecosystem", "package", "declared", "usage"]


def manifest_go_mod(spark, sf_dir):
    p = _packages(spark, sf_dir)
    line = F.concat(F.lit("\tx.example/"), "package", F.lit(" v"), "version", F.when(F.col("usage") == "test", " // indirect").otherwise(""))
    return manifests.go_mod(_texts(p, "go.mod", line, "module x.example/m\n\ngo 1.22\n\nrequire (\n", "\n)\n")).select(_OUT)


def manifest_package_json(spark, sf_dir):
    """Every package stands in dependencies; every fifth in devDependencies and, each second of these, in optionalDependencies too."""
    p = _packages(spark, sf_dir)
    pair = F.concat(F.lit('"'), "package", F.lit('": "^'), "version", F.lit('"'))
    part = lambda key, cond: _texts(p, "package.json", pair, f'"{key}": {{', "}", ", ", cond)
    both = _with_both(_with_both(part("dependencies", F.lit(True)), part("devDependencies", F.col("k") % 5 == 0), ", "), part("optionalDependencies", F.col("k") % 10 == 0), ", ")
    return manifests.package_json(both.withColumn("text", F.concat(F.lit("{"), "text", F.lit("}")))).select(_OUT)


def manifest_requirements(spark, sf_dir):
    line = F.concat("package", F.when(F.col("k") % 3 == 0, "[x]").otherwise(""), F.lit("=="), "version", F.when(F.col("k") % 2 == 0, ' ; python_version > "3"').otherwise("  # why"))
    return manifests.requirements(_texts(_packages(spark, sf_dir), "requirements-dev.txt", line, "# all\n-r base.txt\n")).select(_OUT)


def manifest_cargo(spark, sf_dir):
    p = _packages(spark, sf_dir)
    line = F.when(F.col("k") % 3 == 0, F.concat(F.lit("x"), "k", F.lit(' = { version = "'), "version", F.lit('", package = "'), "package", F.lit('" }'))).otherwise(F.concat("package", F.lit(' = "'), "version", F.lit('"')))
    part = lambda head, usage: _texts(p, "Cargo.toml", line, head, "", "\n", F.col("usage") == usage)
    return manifests.cargo_toml(_with_both(part("[dependencies]\n", "production"), part("[dev-dependencies]\n", "test"), "\n\n")).select(_OUT)


def manifest_pom(spark, sf_dir):
    line = F.concat(F.lit("<dependency><groupId>g.x</groupId><artifactId>"), "package", F.lit("</artifactId><version>"), F.when(F.col("k") % 2 == 0, "${v.all}").otherwise(F.col("version")), F.lit("</version>"), F.when(F.col("usage") == "test", "<scope>test</scope>").otherwise(""), F.lit("</dependency>"))
    return manifests.maven_pom(_texts(_packages(spark, sf_dir), "pom.xml", line, "<project><properties><v.all>9.9</v.all></properties><dependencies>", "</dependencies></project>")).select(_OUT)


def manifest_gradle(spark, sf_dir):
    """Coordinates, named parts, variables that are or aren't assigned, projects and aliases of a catalog."""
    p, k = _packages(spark, sf_dir), F.col("k")
    conf = F.when(F.col("usage") == "test", "testImplementation").otherwise("implementation")
    line = (
        F.when(k % 6 == 0, F.concat(conf, F.lit(" group: 'g.x', name: '"), "package", F.lit("', version: '"), "version", F.lit("'"))).when(k % 6 == 1, F.concat(conf, F.lit('("g.x:'), "package", F.lit(':${shared}")')))
        .when(k % 6 == 2, F.concat(conf, F.lit(' "g.x:'), "package", F.lit(':$unknown"'))).when(k % 6 == 3, F.concat(conf, F.lit(" project(':apps:"), "package", F.lit("')"))).when(k % 6 == 4, F.concat(conf, F.lit("(libs."), F.regexp_replace("package", "-", "."), F.lit(")"))).otherwise(F.concat(conf, F.lit(" 'g.x:"), "package", F.lit(":"), "version", F.lit("'")))
    )
    catalog = _texts(p, "libs.versions.toml", F.concat("package", F.lit(' = { module = "g.cat:'), "package", F.lit('", version.ref = "one" }')), '[versions]\none = "4.5"\n[libraries]\n', "", "\n", k % 6 == 4)
    return locks.gradle(_texts(p, "build.gradle", line, 'def shared = "1.1"\ndependencies {\n', "\n}\n"), locks.gradle_catalog(catalog)).select(*_OUT, "configuration")


def manifest_pyproject(spark, sf_dir):
    p = _packages(spark, sf_dir)
    item = F.concat(F.lit('  "'), "package", F.when(F.col("k") % 3 == 0, "[x,y]").otherwise(""), F.lit(">="), "version", F.lit('",'))
    part = lambda head, usage: _texts(p, "pyproject.toml", item, head, "\n]", "\n", F.col("usage") == usage)
    return locks.pyproject(_with_both(part("[project]\nname = 'm' # [x]\ndependencies = [\n", "production"), part("[project.optional-dependencies]\ntests = [\n", "test"), "\n")).select(_OUT)


def manifest_nuget(spark, sf_dir):
    line = F.when(F.col("k") % 2 == 0, F.concat(F.lit('<PackageReference Include="'), "package", F.lit('" Version="'), "version", F.lit('" />'))).otherwise(F.concat(F.lit('<PackageReference Update="'), "package", F.lit('"><Version>'), "version", F.lit("</Version></PackageReference>")))
    return locks.nuget_project(_texts(_packages(spark, sf_dir), "a.csproj", line, "<Project><ItemGroup>", "</ItemGroup></Project>")).select(_OUT)


def lock_npm(spark, sf_dir):
    p, k = _packages(spark, sf_dir), F.col("k")
    path = F.when(k % 4 == 0, F.concat(F.lit("node_modules/a/node_modules/"), "package")).otherwise(F.concat(F.lit("node_modules/"), "package"))
    new = _texts(p, "package-lock.json", F.concat(F.lit('"'), path, F.lit('": {"version": "'), "version", F.lit('"}')), '"packages": {', "}", ", ", k % 3 > 0)
    old = _texts(p, "package-lock.json", F.concat(F.lit('"'), "package", F.lit('": {"version": "0.'), k, F.lit('"}')), '"dependencies": {', "}", ", ", k % 2 == 0)
    return locks.npm_lock(_with_both(new, old, ", ").withColumn("text", F.concat(F.lit("{"), "text", F.lit("}"))))


def lock_pnpm(spark, sf_dir):
    value = F.when(F.col("k") % 3 == 0, F.concat(F.lit("{specifier: ^1, version: "), "version", F.lit("(peer@2)}"))).when(F.col("k") % 3 == 1, F.concat(F.lit("link:../"), "package")).otherwise(F.col("version"))
    return locks.pnpm_lock(_texts(_packages(spark, sf_dir), "pnpm-lock.yaml", F.concat(F.lit("      "), "package", F.lit(": "), value), "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies: # here\n", "\n"))


def lock_toml(spark, sf_dir):
    return locks.toml_lock(_texts(_packages(spark, sf_dir), "Cargo.lock", F.concat(F.lit('[[package]]\nname = "'), "package", F.lit('"\nversion = "'), "version", F.lit('"\n')), "version = 3\n\n"))


def lock_nuget(spark, sf_dir):
    return locks.nuget_lock(_texts(_packages(spark, sf_dir), "packages.lock.json", F.concat(F.lit('"'), "package", F.lit('": {"type": "Direct", "resolved": "'), "version", F.lit('"}')), '{"dependencies": {"net8.0": {', "}}}", ", "))


def locked_resolution(spark, sf_dir):
    """Every package once or twice in a lock that spells its name otherwise; declarations are exact or a constraint."""
    p, k = _packages(spark, sf_dir), F.col("k")
    lock = F.concat(F.col("folder"), F.lit("/poetry.lock"))
    have = p.select("repository", lock.alias("path"), F.upper(F.regexp_replace("package", "-", "_")).alias("package"), F.explode(F.when(k % 3 == 0, F.array("version", F.concat("version", F.lit(".1")))).otherwise(F.array("version"))).alias("version"))
    mine = p.select("repository", lock.alias("lock"), F.lit("pypi").alias("ecosystem"), "package", F.when(k % 2 == 0, F.concat(F.lit("=="), "version")).otherwise(">=0").alias("declared"))
    return locks.locked_versions(mine, have).select("repository", "package", "declared", "resolved")


def lockfile_nearest(spark, sf_dir):
    f = table(spark, sf_dir, "source_files").select("repository", "path").distinct()
    m = f.select("repository", F.regexp_replace("path", "[^/]+$", "package.json").alias("path")).distinct()
    top = F.regexp_extract("path", "^[^/]+/", 0)
    lock = f.select("repository", F.concat(top, F.lit("package-lock.json")).alias("path")).filter(F.length(top) % 2 == 0).unionByName(m.filter(F.length("path") % 3 == 0).select("repository", F.regexp_replace("path", "package.json$", "package-lock.json").alias("path"))).distinct()
    return manifests.nearest_lockfile(m, lock)


def version_resolution(spark, sf_dir):
    p, k = _packages(spark, sf_dir), F.col("k")
    declared = F.when(k % 9 == 0, F.concat(F.lit("^"), "version")).when(k % 9 == 1, F.concat(F.lit("v"), "version")).when(k % 9 == 2, "$x").when(k % 9 == 3, F.concat(F.lit(">="), "version", F.lit(", <9"))).when(k % 9 == 4, F.concat("version", F.lit("-rc.1"))).when(k % 9 == 5, "7").when(k % 9 == 6, F.concat(F.lit("=="), "version")).when(k % 9 == 7, "1.*").otherwise("")
    return p.select("package", declared.alias("declared"), locks.version_resolution(declared).alias("general"), locks.version_resolution(declared, True).alias("python"))


def manifest_kinds(spark, sf_dir):
    f = table(spark, sf_dir, "source_files").select("repository", "path").distinct()
    names = ["package.json", "go.mod", "x.csproj", "requirements-test.txt", "README.md", "uv.lock", "build.gradle.kts", "pyproject.toml"]
    many = f.select("repository", F.regexp_replace("path", "[^/]*$", "").alias("d"), F.explode(F.array(*[F.lit(n) for n in names])).alias("n")).select("repository", F.concat("d", "n").alias("path")).distinct()
    return locks.manifest_boundaries(many)


# ---------------------------------------------------------------- reports
def _report(spark, sf_dir, line: Column, head: str, foot: str, sep: str = "") -> DataFrame:
    c = _counts(spark, sf_dir)
    per = c.select(F.col("l_suppkey").alias("report_id"), F.struct("path", line.alias("line")).alias("x")).groupBy("report_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), sep).alias("body"))
    return per.select("report_id", F.concat(F.lit(head), "body", F.lit(foot)).alias("text"))


def _n(c: str) -> Column:
    return F.col(c).cast("long").cast("string")


def jacoco_import(spark, sf_dir):
    counter = lambda kind, found, hit: F.concat(F.lit(f'<counter type="{kind}" missed="'), (F.col(found) - F.col(hit)).cast("long").cast("string"), F.lit('" covered="'), _n(hit), F.lit('"/>'))
    line = F.concat(F.lit('<sourcefile name="'), "path", F.lit('">'), counter("LINE", "lines_found", "lines_hit"), counter("BRANCH", "branches_found", "branches_hit"), F.lit("</sourcefile>"))
    return reports.jacoco(_report(spark, sf_dir, line, '<report name="r"><package name="a/b">', "</package></report>"))


def cobertura_import(spark, sf_dir):
    """A line for each of the first lines found, hit while there are hits; a class reported twice counts once."""
    one = F.transform(F.sequence(F.lit(1), F.least(F.col("lines_found"), F.lit(9)).cast("int")), lambda i: F.concat(F.lit('<line number="'), i.cast("string"), F.lit('" hits="'), F.when(i <= F.col("lines_hit"), "1").otherwise("0"), F.when(i == 1, '" branch="true" condition-coverage="50% (1/2)"/>').otherwise('"/>')))
    cls = F.concat(F.lit('<class filename="'), "path", F.lit('"><lines>'), F.array_join(one, ""), F.lit("</lines></class>"))
    return reports.cobertura(_report(spark, sf_dir, F.concat(cls, cls), "<coverage><packages><package><classes>", "</classes></package></packages></coverage>"))


def semgrep_import(spark, sf_dir):
    line = F.concat(F.lit('{"check_id": "rule-'), "path", F.lit('", "path": "a\\\\'), "path", F.lit('.py", "start": {"line": '), _n("lines_hit"), F.lit('}, "end": {"line": '), _n("lines_found"), F.lit('}, "extra": {"severity": "WARNING", "message": "m", "fingerprint": "f", "is_ignored": '), F.when(F.col("path") == "A", "true").otherwise("false"), F.lit("}}"))
    return reports.semgrep(_report(spark, sf_dir, line, '{"results": [', "]}", ", ")).select("report_id", "key", "severity", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "suppressed")


def sonar_import(spark, sf_dir):
    measure = F.concat(F.lit('{"metric": "coverage-'), "path", F.lit('", "value": "'), _n("lines_hit"), F.lit('.5"}'))
    issue = F.concat(F.lit('{"key": "k", "rule": "r-'), "path", F.lit('", "severity": "MAJOR", "component": "proj:src/'), "path", F.lit('.java", "line": '), _n("lines_found"), F.lit(', "message": "m", "status": "'), F.when(F.col("path") == "A", "CLOSED").otherwise("OPEN"), F.lit('"}'))
    a = _report(spark, sf_dir, measure, '{"component": {"key": "p", "measures": [', "]}}", ", ")
    b = _report(spark, sf_dir, issue, '{"issues": [', "]}", ", ")
    return services.sonar(a.unionByName(b)).select("report_id", "kind", "key", "value", "severity", "path", F.col("start_line").cast("long").alias("start_line"), "state")


def registry_answers(spark, sf_dir):
    """Answers in the forms of six registries, every seventh version taken back."""
    p, k = _packages(spark, sf_dir), F.col("k")
    back = F.when(k % 7 == 0, "true").otherwise("false")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit('{"versions": {"'), "version", F.lit('": {}, "9.9.9-rc.1": {}}}'))).when(k % 6 == 1, F.concat(F.lit('{"releases": {"'), "version", F.lit('": [{"yanked": '), back, F.lit("}]}}")))
        .when(k % 6 == 2, F.concat(F.lit('{"versions": [{"num": "'), "version", F.lit('", "yanked": '), back, F.lit("}]}"))).when(k % 6 == 3, F.concat(F.lit('{"versions": ["'), "version", F.lit('"]}'))).when(k % 6 == 4, F.concat(F.lit("<metadata><versioning><versions><version>"), "version", F.lit("</version></versions></versioning></metadata>")))
        .otherwise(F.concat(F.lit("v"), "version", F.lit("\nv0.0.1-rc.1\n")))
    )
    eco = F.element_at(F.array(*[F.lit(e) for e in ("npm", "pypi", "cargo", "nuget", "maven", "go")]), (k % 6 + 1).cast("int"))
    return services.latest_stable(services.registry_versions(p.select(eco.alias("ecosystem"), "package", text.alias("text"))))


def advisory_feed(spark, sf_dir):
    """The advisories as a feed would deliver them, read back and counted by what they affect."""
    a = table(spark, sf_dir, "advisories").filter("trim(id) <> ''")
    affected = F.transform("affected", lambda x: F.when(x.isNotNull(), F.struct(F.struct(x["ecosystem"].alias("ecosystem"), x["name"].alias("name"), x["purl"].alias("purl")).alias("package"), x["ranges"].alias("ranges"), x["versions"].alias("versions"))))
    d = services.advisory_records(a.select("record_id", F.to_json(F.struct("id", "aliases", affected.alias("affected"))).alias("text")))
    return d.select("record_id", "id", F.explode("affected").alias("f")).filter("f.name is not null").select("record_id", "id", "f.ecosystem", "f.name", F.coalesce(F.size("f.versions"), F.lit(0)).cast("long").alias("versions"))


# ---------------------------------------------------------------- routes
def go_routes(spark, sf_dir):
    line = F.concat(F.lit('\tmux.HandleFunc("'), F.when(F.col("k") % 2 == 0, "GET ").otherwise(""), F.lit("/"), "package", F.lit('", h)'))
    return extract.go_routes(_texts(_packages(spark, sf_dir), "main.go", line, "func main() {\n", "\n}\n"))


def spring_routes(spark, sf_dir):
    """Annotated methods below a class prefix, and functional routes."""
    k = F.col("k")
    line = F.when(k % 3 == 0, F.concat(F.lit('  @GetMapping("/'), "package", F.lit('")\n  String a() {}'))).when(k % 3 == 1, F.concat(F.lit('  @PostMapping(path = "'), "package", F.lit('/", consumes = "x")\n  void b() {}'))).otherwise(F.concat(F.lit('  Object c = route().DELETE("/f/'), "package", F.lit('", this::d);')))
    return extract.spring_routes(_texts(_packages(spark, sf_dir), "A.java", line, '@RequestMapping("/api/")\nclass A {\n', "\n}\n"))


def client_targets(spark, sf_dir):
    """Named clients, and URLs of files that use an HTTP client; comments and documentation hosts name no service."""
    k = F.col("k")
    line = F.when(k % 3 == 0, F.concat(F.lit('@FeignClient(name = "'), "package", F.lit('", path = "/x")'))).when(k % 3 == 1, F.concat(F.lit('  String u = "http://'), "package", F.lit(':8080/a";'))).otherwise(F.concat(F.lit('  // http://'), "package"))
    return extract.client_targets(_texts(_packages(spark, sf_dir), "C.java", line, "import org.x.WebClient;\n", '\n  String w = "http://www.w3.org/x";\n'))


QUERIES = {
    f.__name__: f
    for f in (
        manifest_go_mod, manifest_package_json, manifest_requirements, manifest_cargo, manifest_pom, manifest_gradle, manifest_pyproject, manifest_nuget, lock_npm, lock_pnpm, lock_toml, lock_nuget, locked_resolution, lockfile_nearest, version_resolution,
        manifest_kinds, jacoco_import, cobertura_import, semgrep_import, sonar_import, registry_answers, advisory_feed, go_routes, spring_routes, client_targets,
    )
}


def _manifest_sql(name: str, ecosystem: str, package: str = "package", declared: str = "version", usage: str = "usage") -> str:
    return f"with {_PACKAGES} select repository, folder || '/{name}' as path, '{ecosystem}' as ecosystem, {package} as package, {declared} as declared, {usage} as usage from p"


def _lock_sql(name: str, where: str = "true", version: str = "version", more: str = "") -> str:
    return f"with {_PACKAGES} select repository, folder || '/{name}' as path, {more}package, {version} as version from p where {where}"


_FOLDER = "regexp_replace(path, '/?[^/]*$', '')"
ORACLES = {
    "manifest_go_mod": _manifest_sql("go.mod", "go", "'x.example/' || package", "'v' || version", "case usage when 'test' then 'indirect' else usage end"),
    "manifest_package_json": _manifest_sql("package.json", "npm", declared="'^' || version", usage="case when k % 10 = 0 then 'optional' else 'production' end"),
    "manifest_requirements": _manifest_sql("requirements-dev.txt", "pypi", declared="'==' || version", usage="'development'"),
    "manifest_cargo": _manifest_sql("Cargo.toml", "cargo"),
    "manifest_pom": _manifest_sql("pom.xml", "maven", "'g.x:' || package", "case when k % 2 = 0 then '9.9' else version end"),
    "manifest_gradle": f"""with {_PACKAGES} select repository, folder || '/build.gradle' as path, 'maven' as ecosystem, case k % 6 when 3 then 'project:apps/' || package when 4 then 'g.cat:' || package else 'g.x:' || package end as package,
  case k % 6 when 0 then version when 1 then '1.1' when 2 then '' when 3 then '' when 4 then '4.5' else version end as declared, usage, case usage when 'test' then 'testImplementation' else 'implementation' end as configuration from p""",
    "manifest_pyproject": _manifest_sql("pyproject.toml", "pypi", declared="'>=' || version"),
    "manifest_nuget": _manifest_sql("a.csproj", "nuget", usage="'production'"),
    "lock_npm": f"""with {_PACKAGES}, n as (select *, k % 3 > 0 and k % 4 > 0 as new, k % 2 = 0 as old from p) select repository, folder || '/package-lock.json' as path, package, case when new then version else '0.' || k end as version from n where new or old""",
    "lock_pnpm": _lock_sql("pnpm-lock.yaml", "k % 3 <> 1", more="'.' as importer, "),
    "lock_toml": _lock_sql("Cargo.lock"),
    "lock_nuget": _lock_sql("packages.lock.json"),
    "locked_resolution": f"with {_PACKAGES} select repository, package, case when k % 2 = 0 then '==' || version else '>=0' end as declared, case when k % 3 > 0 or k % 2 = 0 then version end as resolved from p",
    "lockfile_nearest": f"""with f as (select distinct repository, path from source_files), m as (select distinct repository, regexp_replace(path, '[^/]*$', 'package.json') as path from f),
l as (select repository, regexp_extract(path, '^[^/]+/') || 'package-lock.json' as lock from f where length(regexp_extract(path, '^[^/]+/')) % 2 = 0 union select repository, regexp_replace(path, 'package.json$', 'package-lock.json') from m where length(path) % 3 = 0),
d as (select m.*, l.lock, length({_FOLDER.replace('path', 'l.lock')}) as n from m left join l on l.repository = m.repository and ({_FOLDER.replace('path', 'l.lock')} = '' or starts_with({_FOLDER.replace('path', 'm.path')} || '/', {_FOLDER.replace('path', 'l.lock')} || '/')))
select repository, path, lock from d qualify row_number() over (partition by repository, path order by n desc nulls last) = 1""",
    "version_resolution": f"""with {_PACKAGES}, d as (select k, package, case k % 9 when 0 then '^' || version when 1 then 'v' || version when 2 then '$x' when 3 then '>=' || version || ', <9' when 4 then version || '-rc.1' when 5 then '7' when 6 then '==' || version when 7 then '1.*' else '' end as declared from p)
select package, declared, case k % 9 when 1 then 'exact' when 4 then 'exact' when 2 then 'unresolved' when 7 then 'unresolved' when 8 then 'unresolved' else 'constraint' end as general,
  case k % 9 when 1 then 'exact' when 4 then 'exact' when 6 then 'exact' when 2 then 'unresolved' when 7 then 'unresolved' when 8 then 'unresolved' else 'constraint' end as python from d""",
    "manifest_kinds": """with f as (select distinct repository, regexp_replace(path, '[^/]*$', '') as d from source_files),
k(n, kind, ecosystem) as (values ('package.json', 'npm package', 'npm'), ('go.mod', 'Go module', 'go'), ('x.csproj', '.NET project', 'nuget'), ('requirements-test.txt', 'Python requirements', 'pypi'), ('build.gradle.kts', 'Gradle project', 'maven'), ('pyproject.toml', 'Python project', 'pypi'))
select repository, d || n as path, kind, ecosystem, regexp_replace(d, '/$', '') as folder from f, k""",
    "jacoco_import": f"with {_COUNTS} select l_suppkey as report_id, 'a/b/' || path as path, lf as lines_found, lh as lines_hit, bf as branches_found, bh as branches_hit from c",
    "cobertura_import": f"with {_COUNTS} select l_suppkey as report_id, path, least(lf, 9) as lines_found, least(lh, least(lf, 9)) as lines_hit, 2.0::double as branches_found, 1.0::double as branches_hit from c",
    "semgrep_import": f"with {_COUNTS} select l_suppkey as report_id, 'rule-' || path as key, 'warning' as severity, 'a/' || path || '.py' as path, cast(lh as bigint) as start_line, cast(lf as bigint) as end_line, path = 'A' as suppressed from c",
    "sonar_import": f"""with {_COUNTS} select l_suppkey as report_id, 'metric' as kind, 'coverage-' || path as key, lh + 0.5 as value, null::varchar as severity, null::varchar as path, null::bigint as start_line, 'measured' as state from c
union all select l_suppkey, 'finding', 'r-' || path, null, 'warning', 'src/' || path || '.java', cast(lf as bigint), 'current' from c where path <> 'A'""",
    "registry_answers": f"with {_PACKAGES} select ['npm', 'pypi', 'cargo', 'nuget', 'maven', 'go'][k % 6 + 1] as ecosystem, package, case when k % 6 = 5 then 'v' || version else version end as latest from p where not (k % 6 in (1, 2) and k % 7 = 0)",
    "advisory_feed": "with a as (select record_id, id, unnest(affected) as f from advisories where trim(id) <> '') select record_id, id, f.ecosystem as ecosystem, f.name as name, cast(coalesce(len(f.versions), 0) as bigint) as versions from a where f.name is not null",
    "go_routes": f"with {_PACKAGES} select repository, folder || '/main.go' as path, case when k % 2 = 0 then 'GET' else 'ANY' end as verb, '/' || package as route from p",
    "spring_routes": f"with {_PACKAGES} select repository, folder || '/A.java' as path, case k % 3 when 0 then 'GET' when 1 then 'POST' else 'DELETE' end as verb, case when k % 3 = 2 then '/f/' else '/api/' end || package as route from p",
    "client_targets": f"with {_PACKAGES} select repository, folder || '/C.java' as path, package as target from p where k % 3 < 2",
}
