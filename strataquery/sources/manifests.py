"""Manifests as dependency declarations: ``file`` (repository, path, text) in, one row a dependency out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_COLUMNS = ["repository", "path", "ecosystem", "package", "declared", "usage", "line"]
_POM = "dependencies struct<dependency:array<struct<groupId:string,artifactId:string,version:string,scope:string>>>"


def _lines(files: DataFrame) -> DataFrame:
    return files.select("repository", "path", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("pos", "raw")).select("repository", "path", (F.col("pos") + 1).alias("line"), F.trim("raw").alias("raw"))


def go_mod(files: DataFrame) -> DataFrame:
    """``require`` lines, single and in blocks; ``// indirect`` is a usage."""
    spec = F.regexp_extract_all("body", F.lit(r"(?m)^[ \t]*(?:require[ \t]+)?([^\s()]+[ \t]+v[^\s]+(?:[ \t]+//.*)?)$"), F.lit(1))
    body = F.concat_ws("\n", F.regexp_extract_all("text", F.lit(r"(?m)^require[ \t]+[^\s(][^\n]*$"), F.lit(0)), F.regexp_extract_all("text", F.lit(r"(?ms)^require[ \t]*\((.*?)^\)"), F.lit(1)))
    rows = files.withColumn("body", body).select("repository", "path", F.explode(spec).alias("s"))
    return rows.select("repository", "path", F.lit("go").alias("ecosystem"), F.regexp_extract("s", r"^(\S+)", 1).alias("package"), F.regexp_extract("s", r"^\S+\s+(\S+)", 1).alias("declared"), F.when(F.contains("s", F.lit("// indirect")), "indirect").otherwise("production").alias("usage"))


def _entry(order: int, usage: str):
    return lambda e: F.struct(F.lit(order).alias("order"), e["key"].alias("package"), e["value"].alias("declared"), F.lit(usage).alias("usage"))


def package_json(files: DataFrame) -> DataFrame:
    """All four maps; a package named in several takes optional, production, peer, development in this order."""
    kinds = [("optionalDependencies", "optional"), ("dependencies", "production"), ("peerDependencies", "peer"), ("devDependencies", "development")]
    schema = ", ".join(f"{k} map<string,string>" for k, _ in kinds)
    doc = files.select("repository", "path", F.from_json("text", schema).alias("d"))
    entries = F.concat(*[F.coalesce(F.transform(F.map_entries(f"d.{k}"), _entry(i, u)), F.array().cast("array<struct<order:int,package:string,declared:string,usage:string>>")) for i, (k, u) in enumerate(kinds)])
    rows = doc.select("repository", "path", F.explode(entries).alias("e")).groupBy("repository", "path", "e.package").agg(F.min("e").alias("e"))
    return rows.select("repository", "path", F.lit("npm").alias("ecosystem"), "e.package", "e.declared", "e.usage")


def requirements(files: DataFrame) -> DataFrame:
    """Requirement lines; comments, options and environment markers are cut."""
    rows = _lines(files).filter("raw <> '' and not startswith(raw, '#') and not startswith(raw, '-')")
    plain = F.trim(F.regexp_replace(F.regexp_replace("raw", r"\s+#.*$", ""), r"\s*;.*$", ""))
    usage = F.when(F.contains(F.lower("path"), F.lit("test")), "test").when(F.contains(F.lower("path"), F.lit("dev")), "development").otherwise("production")
    name = F.regexp_extract(plain, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return rows.select("repository", "path", F.lit("pypi").alias("ecosystem"), name.alias("package"), F.trim(F.regexp_extract(plain, r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?\s*(.*)$", 1)).alias("declared"), usage.alias("usage")).filter("package <> ''")


def cargo_toml(files: DataFrame) -> DataFrame:
    """String and inline-table dependencies of the three sections; ``package`` renames."""
    from pyspark.sql import Window as W

    rows = _lines(files)
    w = W.partitionBy("repository", "path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    section = F.last(F.when(F.col("raw").rlike(r"^\["), F.regexp_extract("raw", r"^\[+([^\]]+)\]+", 1)), ignorenulls=True).over(w)
    kept = rows.withColumn("section", section).filter(F.col("section").rlike(r"(?:^|\.)(?:dev-|build-)?dependencies$") & F.col("raw").rlike(r"^[\w-]+\s*="))
    value = F.regexp_extract("raw", r"=\s*(.*)$", 1)
    grab = lambda k: F.regexp_extract(value, rf'\b{k}\s*=\s*"([^"]*)"', 1)
    renamed = F.coalesce(F.nullif(grab("package"), F.lit("")), F.regexp_extract("raw", r"^([\w-]+)", 1))
    declared = F.when(F.startswith(value, F.lit('"')), F.regexp_extract(value, '^"([^"]*)"', 1)).when(grab("git") != "", F.concat(F.lit("git+"), grab("git"))).when(grab("path") != "", F.concat(F.lit("file:"), grab("path"))).otherwise(grab("version"))
    usage = F.when(F.contains("section", F.lit("dev-")), "test").when(F.contains("section", F.lit("build-")), "build").otherwise("production")
    return kept.select("repository", "path", F.lit("cargo").alias("ecosystem"), renamed.alias("package"), declared.alias("declared"), usage.alias("usage"))


def maven_pom(files: DataFrame) -> DataFrame:
    """Direct dependencies; ``${name}`` is replaced once from the properties."""
    doc = files.select("repository", "path", "text", F.explode(F.from_xml("text", T.DataType.fromDDL(_POM)).getField("dependencies").getField("dependency")).alias("d"))
    name = F.regexp_extract("d.version", r"^\$\{([^}]+)\}$", 1)
    prop = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit("<"), F.regexp_replace(name, r"\.", "\\\\."), F.lit(r">\s*([^<\s]+)\s*</")), F.lit(1))
    declared = F.when(name != "", prop).otherwise(F.coalesce("d.version", F.lit("")))
    usage = F.when(F.col("d.scope") == "test", "test").when(F.col("d.scope") == "import", "build").otherwise("production")
    return doc.select("repository", "path", F.lit("maven").alias("ecosystem"), F.concat_ws(":", "d.groupId", "d.artifactId").alias("package"), declared.alias("declared"), usage.alias("usage"))


def nearest_lockfile(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """For each manifest the lock file in the nearest folder above it; equi-join on exploded ancestors."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct((F.size(parts) - n).alias("up"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))
    above = manifests.select("repository", "path", F.explode(ups).alias("u")).select("repository", "path", "u.up", "u.folder")
    have = locks.select("repository", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.col("path").alias("lock"))
    best = above.join(have, ["repository", "folder"]).groupBy("repository", "path").agg(F.min(F.struct("up", "lock")).alias("b"))
    return manifests.join(best, ["repository", "path"], "left").select("repository", "path", F.col("b.lock").alias("lock"))
