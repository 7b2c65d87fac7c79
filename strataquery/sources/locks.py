"""Lock files and further manifests: what versions are locked, and which one a declaration gets.

``files`` has repository, path and text; a lock gives ``repository, path, package, version``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import trimmed
from .config import yaml_json

_NPM = "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>"
_NUGET = "dependencies map<string,map<string,struct<resolved:string>>>"
_CSPROJ = "ItemGroup array<struct<PackageReference:array<struct<_Include:string,_Update:string,_Version:string,Version:string,PrivateAssets:string>>>>"
#: What kind of manifest a file of this name is.
MANIFEST_KINDS = {
    "pnpm-workspace.yaml": "pnpm workspace", "Cargo.toml": "Cargo package", "pyproject.toml": "Python project", "requirements.txt": "Python requirements", "pom.xml": "Maven project", "build.gradle": "Gradle project", "build.gradle.kts": "Gradle project",
    "settings.gradle": "Gradle settings", "settings.gradle.kts": "Gradle settings", "gradle.properties": "Gradle properties", "libs.versions.toml": "Gradle version catalog", "composer.json": "Composer package", "Gemfile": "Ruby bundle", "Package.swift": "Swift package",
    "go.mod": "Go module", "package.json": "npm package",
}


def npm_lock(files: DataFrame) -> DataFrame:
    """Packages right below ``node_modules``; the older ``dependencies`` map fills what they lack."""
    doc = files.select("repository", "path", F.from_json("text", _NPM).alias("d"))
    entry = "array<struct<order:int,package:string,version:string>>"
    new = F.transform(F.filter(F.map_entries("d.packages"), lambda e: e["key"].rlike("^node_modules/(?!.*/node_modules/)")), lambda e: F.struct(F.lit(0).alias("order"), F.substr(e["key"], F.lit(14)).alias("package"), e["value"]["version"].alias("version")))
    old = F.transform(F.map_entries("d.dependencies"), lambda e: F.struct(F.lit(1).alias("order"), e["key"].alias("package"), e["value"]["version"].alias("version")))
    every = F.concat(F.coalesce(new, F.array().cast(entry)), F.coalesce(old, F.array().cast(entry)))
    rows = doc.select("repository", "path", F.explode(every).alias("e")).filter("e.version <> ''")
    return rows.groupBy("repository", "path", "e.package").agg(F.min("e").alias("m")).select("repository", "path", "package", F.col("m.version").alias("version"))


def pnpm_lock(files: DataFrame) -> DataFrame:
    """Versions by importer (the manifest's folder below the lock); links into the workspace have none."""
    sections = ["dependencies", "devDependencies", "optionalDependencies"]
    docs = yaml_json(files).select("repository", "path", F.from_json("json", "importers map<string,struct<" + ",".join(f"{s}:map<string,string>" for s in sections) + ">>").alias("d"))
    none = "array<struct<package:string,version:string>>"
    imp = docs.select("repository", "path", F.explode("d.importers").alias("importer", "i"))
    # A value is a version, or a map that has one.
    read = lambda v: F.when(F.startswith(v, F.lit("{")), F.get_json_object(v, "$.version")).otherwise(v)
    pick = lambda s: F.coalesce(F.transform(F.map_entries(f"i.{s}"), lambda e: F.struct(e["key"].alias("package"), read(e["value"]).alias("version"))), F.array().cast(none))
    both = imp.select("repository", "path", "importer", F.explode(F.concat(*map(pick, sections))).alias("e")).select("repository", "path", "importer", "e.package", "e.version")
    version = F.trim(F.regexp_replace("version", r"\(.*$", ""))
    return both.withColumn("version", version).filter((F.col("version") != "") & ~F.col("version").rlike("^(?:link:|workspace:)")).distinct()


def toml_lock(files: DataFrame) -> DataFrame:
    """``[[package]]`` tables of Cargo, Poetry and uv locks: name and version of each."""
    tables = F.split(F.regexp_replace("text", "\r\n", "\n"), r"(?m)^\[\[package\]\][ \t]*(?:#.*)?$", -1)
    value = lambda k: F.regexp_extract("t", rf"""(?m)^[ \t]*{k}[ \t]*=[ \t]*["']([^"'\n]*)["']""", 1)
    rows = files.select("repository", "path", F.explode(F.slice(tables, 2, 1 << 30)).alias("t"))
    return rows.select("repository", "path", value("name").alias("package"), value("version").alias("version")).filter("package <> '' and version <> ''").distinct()


def nuget_lock(files: DataFrame) -> DataFrame:
    """Resolved versions of every target framework, each once."""
    doc = files.select("repository", "path", F.explode(F.from_json("text", _NUGET)["dependencies"]).alias("framework", "m"))
    return doc.select("repository", "path", F.explode("m").alias("package", "v")).select("repository", "path", "package", F.col("v.resolved").alias("version")).filter("version <> ''").distinct()


def locked_name(ecosystem: Column, name: Column) -> Column:
    """How a lock is asked: Python folds case, ``_`` and ``.``; NuGet folds case; others as written."""
    return F.when(F.lower(ecosystem) == "pypi", F.translate(F.lower(name), "_.", "--")).when(F.lower(ecosystem) == "nuget", F.lower(name)).otherwise(name)


def locked_versions(declarations: DataFrame, locks: DataFrame) -> DataFrame:
    """``resolved`` of each declaration: the only locked version, else the one declared exactly, else null.

    ``declarations``: repository, lock (its lock file), ecosystem, package, declared; ``locks``: repository,
    path, package, version.  A package has few versions in one lock, so they come as a set.
    """
    own = declarations.withColumn("_n", locked_name(F.col("ecosystem"), F.col("package")))
    ecosystems = declarations.select("repository", F.col("lock").alias("path"), "ecosystem").distinct()
    have = locks.join(ecosystems, ["repository", "path"]).groupBy("repository", F.col("path").alias("lock"), "ecosystem", locked_name(F.col("ecosystem"), F.col("package")).alias("_n")).agg(F.array_sort(F.collect_set("version")).alias("_v"))
    bare = lambda c: F.lower(F.regexp_replace(c, "^v", ""))
    exact = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("declared", F.lit(""))), "^v", ""), r"^\s*={1,3}\s*", ""))
    chosen = F.when(F.size("_v") == 1, F.col("_v")[0]).otherwise(F.try_element_at(F.filter("_v", lambda v: bare(v) == exact), F.lit(1)))
    return own.join(have, ["repository", "lock", "ecosystem", "_n"], "left").withColumn("resolved", chosen).drop("_n", "_v")


def version_resolution(declared: Column, python: bool = False) -> Column:
    """exact, constraint or unresolved, by how a version is written."""
    d = F.trim(F.coalesce(declared, F.lit("")))
    bare = F.regexp_replace(d, "^v", "")
    plain = F.when((d == "") | d.rlike(r"[$*+]"), "unresolved").when(bare.rlike(r"^(?:[\^~<>=]|workspace:|file:|link:|git\+|https?:)|[ |,]"), "constraint").when(bare.rlike(r"^[0-9]+(?:\.[0-9]+)+(?:-|$)"), "exact").otherwise("constraint")
    return F.when(d.rlike(r"^={2,3}\s*[^\s*]+$"), "exact").otherwise(plain) if python else plain


def manifest_kind(path: Column) -> Column:
    """What kind of manifest a path is; null for other files."""
    base = F.element_at(F.split(path, "/"), -1)
    named = F.create_map(*[F.lit(x) for p in MANIFEST_KINDS.items() for x in p])
    return F.coalesce(F.try_element_at(named, base), F.when(F.lower(base).rlike(r"^requirements.*\.txt$"), "Python requirements").when(F.endswith(base, F.lit(".csproj")), ".NET project").when(F.endswith(base, F.lit(".sln")), ".NET solution"))


def kind_ecosystem(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.rlike("npm"), "npm").when(low.rlike("go module"), "go").when(low.rlike("gradle|maven"), "maven").when(low.rlike("cargo"), "cargo").when(low.rlike("python"), "pypi").when(low.rlike(r"\.net|nuget"), "nuget").otherwise("unknown")


def manifest_boundaries(files: DataFrame) -> DataFrame:
    """Every manifest of whatever kind, parsed or not: a boundary of its folder."""
    return files.select("repository", "path", manifest_kind(F.col("path")).alias("kind")).filter("kind is not null").withColumn("ecosystem", kind_ecosystem(F.col("kind"))).withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))


def nuget_project(files: DataFrame) -> DataFrame:
    """``PackageReference`` items; the version is an attribute or an element."""
    doc = files.select("repository", "path", F.explode(F.from_xml("text", T.DataType.fromDDL(_CSPROJ))["ItemGroup"]).alias("g"))
    r = doc.select("repository", "path", F.explode("g.PackageReference").alias("r"))
    filled = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c], F.lit(""))
    usage = F.when(F.contains(F.lower("path"), F.lit("test")), "test").otherwise("production")
    return r.select("repository", "path", F.lit("nuget").alias("ecosystem"), filled("r._Include", "r._Update").alias("package"), filled("r._Version", "r.Version").alias("declared"), usage.alias("usage")).filter("package <> ''")


_REQUIREMENT = r"""["']\s*([A-Za-z0-9][A-Za-z0-9._-]*(?:\[[^\]]*\])?[^"']*)["']"""


def pyproject(files: DataFrame) -> DataFrame:
    """Project, optional and group dependencies and Poetry's tables; extras' groups count as test or development.

    Loops over alternatives are possessive: the matcher runs these as loops, others as a recursion as deep as the text is long.
    """
    tables = F.split(F.concat(F.lit("\n"), F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), r"(?m)^((?:\"[^\"\n]*\"|'[^'\n]*'|[^\"'\n#])*+)#.*$", "$1")), r"\n(?=\[)", -1)
    rows = files.select("repository", "path", F.explode(tables).alias("t")).withColumn("section", F.lower(F.regexp_extract("t", r"^\[+\s*([^\]]+?)\s*\]+", 1)))
    of_array = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    arrays = rows.filter("section in ('project', 'project.optional-dependencies', 'dependency-groups')").select(
        "repository", "path", "section", F.explode(of_array(r"""(?ms)^[ \t]*["']?[\w.-]+["']?[ \t]*=[ \t]*\[(?:[^\]"']|"[^"]*"|'[^']*')*+\]""")).alias("a")
    ).withColumn("key", F.lower(F.regexp_extract("a", r"""^[ \t]*["']?([\w.-]+)""", 1))).filter("section <> 'project' or key = 'dependencies'")
    group = lambda g: F.when(F.contains(g, F.lit("test")), "test").otherwise("development")
    usage = F.when(F.col("section") == "project", "production").otherwise(group(F.col("key")))
    items = arrays.select("repository", "path", usage.alias("usage"), F.explode(F.regexp_extract_all(F.regexp_replace("a", r"^[^\[]*\[", ""), F.lit(_REQUIREMENT), F.lit(1))).alias("r"))
    plain = F.trim(F.regexp_replace("r", r"\s*;.*$", ""))
    first = items.select("repository", "path", "usage", F.regexp_extract(plain, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1).alias("package"), trimmed(F.regexp_extract(plain, r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?(.*)$", 1)).alias("declared"))
    poetry = rows.filter(F.col("section").rlike(r"^tool\.poetry(?:\.group\.[^.]+)?\.(?:dev-)?dependencies$")).select("repository", "path", "section", F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^[\w.-]+[ \t]*=[^\n]*$"), F.lit(0))).alias("l"))
    value = F.regexp_extract("l", r"=\s*(.*)$", 1)
    declared = F.when(value.rlike(r"^\{"), F.regexp_extract(value, r"""version\s*=\s*["']([^"']*)""", 1)).otherwise(F.regexp_extract(value, r"""^["']([^"']*)""", 1))
    where = F.when(F.col("section") == "tool.poetry.dependencies", "production").otherwise(group(F.col("section")))
    second = poetry.select("repository", "path", where.alias("usage"), F.regexp_extract("l", r"^([\w.-]+)", 1).alias("package"), declared.alias("declared")).filter("lower(package) <> 'python'")
    return first.unionByName(second).select("repository", "path", F.lit("pypi").alias("ecosystem"), "package", "declared", "usage")


def gradle_usage(configuration: Column) -> Column:
    low = F.lower(F.trim(configuration))
    return (
        F.when(low.isin("", "versioncatalog"), "unknown").when(low.rlike("test|e2e"), "test").when(low.rlike("annotationprocessor|^kapt|^ksp|^classpath$"), "build").when(low == "developmentonly", "development").otherwise("production")
    )


_CONFIGURATION = r"(?:[A-Za-z0-9]*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly|[aA]nnotationProcessor)|kapt[A-Za-z]*|ksp[A-Za-z]*|classpath|developmentOnly)"


def gradle_catalog(files: DataFrame) -> DataFrame:
    """``repository, alias, coordinate, version`` of version catalogs; references to named versions are followed."""
    body = F.regexp_replace("text", "\r\n", "\n")
    sections = F.split(F.concat(F.lit("\n"), body), r"\n(?=\[)", -1)
    rows = files.select("repository", F.explode(sections).alias("t")).select("repository", F.regexp_extract("t", r"^\[([\w-]+)\]", 1).alias("section"), F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^[\w.-]+[ \t]*=[^\n]*$"), F.lit(0))).alias("l"))
    key, value = F.regexp_extract("l", r"^([\w.-]+)", 1), F.trim(F.regexp_extract("l", r"=(.*)$", 1))
    quoted = lambda k: F.regexp_extract(value, rf"""\b{k}\s*=\s*["']([^"']*)["']""", 1)
    versions = rows.filter("section = 'versions'").select("repository", key.alias("ref"), F.regexp_extract(value, r"""["']([^"']*)["']""", 1).alias("named"))
    module = F.when(value.rlike(r"""^["']"""), F.regexp_extract(value, r"""^["']([^:"']+:[^:"']+)""", 1)).when(quoted("module") != "", quoted("module")).otherwise(F.concat_ws(":", F.nullif(quoted("group"), F.lit("")), F.nullif(quoted("name"), F.lit(""))))
    own = F.when(value.rlike(r"""^["']"""), F.regexp_extract(value, r"""^["'][^:"']+:[^:"']+:([^"']+)""", 1)).otherwise(quoted("version"))
    libs = rows.filter("section = 'libraries'").select("repository", F.regexp_replace(key, "[-_]", ".").alias("alias"), module.alias("coordinate"), own.alias("own"), F.when(quoted(r"version\.ref") != "", quoted(r"version\.ref")).otherwise(F.regexp_extract(value, r"""version\s*=\s*\{\s*ref\s*=\s*["']([^"']*)""", 1)).alias("ref"))
    return libs.join(versions, ["repository", "ref"], "left").select("repository", "alias", "coordinate", F.coalesce(F.nullif("own", F.lit("")), "named", F.lit("")).alias("version")).filter(F.contains("coordinate", F.lit(":")))


def gradle(files: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Dependencies of Gradle scripts: coordinates, named parts, projects and catalog aliases.

    ``$name`` versions are taken from assignments in the script; what stays open loses its version, and
    an open group or artifact is no coordinate.  One row for each coordinate and configuration.
    """
    grab = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    text = rf"""(?m)\b{_CONFIGURATION}\s*\(?\s*(?:platform\s*\(\s*|enforcedPlatform\s*\(\s*)?["'][^"'\n]+:[^"'\n]+["']"""
    named = rf"""\b{_CONFIGURATION}\s*\(?\s*group\s*[:=]\s*["'][^"']+["']\s*,\s*name\s*[:=]\s*["'][^"']+["'](?:\s*,\s*version\s*[:=]\s*["'][^"']+["'])?"""
    project = rf"""\b{_CONFIGURATION}\s*\(?\s*project\s*\(\s*(?:path\s*[:=]\s*)?["'][^"']+["']"""
    alias = rf"""\b{_CONFIGURATION}\s*\(?\s*libs\.[A-Za-z0-9_.]+"""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), grab(p).alias("ms")) for k, p in (("text", text), ("named", named), ("project", project), ("alias", alias))])
    rows = files.select("repository", "path", F.col("text").alias("_t"), F.explode(kinds).alias("x")).select("repository", "path", "_t", "x.kind", F.explode("x.ms").alias("m"))
    conf = F.regexp_extract("m", rf"^({_CONFIGURATION})", 1)
    q = lambda k: F.regexp_extract("m", rf"""\b{k}\s*[:=]\s*["']([^"']+)["']""", 1)
    coordinate = F.when(F.col("kind") == "text", F.regexp_extract("m", r"""["']([^"']+)["']""", 1)).when(F.col("kind") == "named", F.concat_ws(":", q("group"), q("name"), F.nullif(q("version"), F.lit("")))).when(F.col("kind") == "project", F.concat(F.lit("project:"), F.regexp_replace(F.regexp_replace(F.regexp_extract("m", r"""["']([^"']+)["']""", 1), "^:", ""), ":", "/"))).otherwise(F.regexp_extract("m", r"libs\.([A-Za-z0-9_.]+)", 1))
    c = rows.select("repository", "path", "_t", "kind", conf.alias("configuration"), coordinate.alias("c"))
    parts = F.split("c", ":", 3)
    variable = F.regexp_extract(F.try_element_at(parts, F.lit(3)), r"\$\{?([A-Za-z_][\w.]*)\}?", 1)
    looked = F.call_function("regexp_extract", F.col("_t"), F.concat(F.lit(r"(?m)\b"), variable, F.lit(r"""["']?\s*[=,]\s*["']([^"'$\n]+)["']""")), F.lit(1))
    raw = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(""))
    version = F.when(~F.contains(raw, F.lit("$")), raw).when(variable != "", looked).otherwise("")
    plain = c.filter("kind <> 'alias'").select("repository", "path", "configuration", F.when(F.col("kind") == "project", F.col("c")).otherwise(F.concat_ws(":", parts[0], F.try_element_at(parts, F.lit(2)))).alias("package"), F.when(F.col("kind") == "project", "").otherwise(version).alias("declared"), "kind")
    good = plain.filter((F.col("kind") == "project") | (F.col("package").rlike(r"^[^:$\s/]+:[^:$\s/]+$") & ~F.startswith("package", F.lit("libs."))))
    if catalog is not None:
        by_alias = c.filter("kind = 'alias'").select("repository", "path", "configuration", F.regexp_replace("c", "[-_]", ".").alias("alias"), "kind")
        good = good.unionByName(by_alias.join(catalog, ["repository", "alias"]).select("repository", "path", "configuration", F.col("coordinate").alias("package"), F.col("version").alias("declared"), "kind"))
    return good.drop("kind").distinct().select("repository", "path", F.lit("maven").alias("ecosystem"), "package", "declared", "configuration", gradle_usage(F.col("configuration")).alias("usage"))
