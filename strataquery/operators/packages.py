"""Packages of source trees, imports between them, deployment-only repositories, snapshots put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import citation
from ..sources.config import assignment_rank
from ..sources.syntax_nodes import LANGUAGES
from .search import directory_closure


def go_packages(files: DataFrame) -> DataFrame:
    """``repository, package, label, first_file, entrypoint`` of folders with a Go file that is no test.

    A folder below ``cmd/`` is an entry point; the root is called as the repository.
    """
    own = files.filter(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select("repository", F.regexp_replace("path", "/?[^/]*$", "").alias("package"), "path")
    per = own.groupBy("repository", "package").agg(F.min("path").alias("first_file"))
    label = F.when(F.col("package") == "", F.col("repository")).otherwise(F.element_at(F.split("package", "/"), -1))
    return per.select("repository", "package", label.alias("label"), "first_file", F.col("package").rlike("^cmd/[^/]+").alias("entrypoint"))


def import_edges(imports: DataFrame, modules: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges from a file's package to the package of the same module that it imports.

    ``imports``: repository, path, target; ``modules``: repository, module; ``packages``: repository, package.
    The module's name is cut off the target; what is left names the folder, so this is an equi-join.
    """
    j = imports.join(modules, "repository")
    inside = (F.col("target") == F.col("module")) | F.startswith("target", F.concat("module", F.lit("/")))
    e = j.filter(inside).select("repository", F.regexp_replace("path", "/?[^/]*$", "").alias("source"), F.expr("substring(target, length(module) + 2)").alias("package")).distinct()
    return e.join(packages.select("repository", "package"), ["repository", "package"], "left_semi").filter("source <> package").withColumnRenamed("package", "target")


def dependency_usage(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Declared packages with the files that import them or a path below them; test when only tests do, unused without any.

    ``imports``: repository, path, target; ``dependencies``: repository, package.
    """
    parts = F.split("target", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    test = F.endswith("path", F.lit("_test.go"))
    used = imports.select("repository", "path", test.alias("test"), F.explode(ups).alias("package")).distinct().groupBy("repository", "package").agg(F.count("*").alias("files"), F.min("test").alias("only_tests"))
    usage = F.when(F.col("files").isNull(), "unused").when(F.col("only_tests"), "test").otherwise("production")
    return dependencies.join(used, ["repository", "package"], "left").select("repository", "package", F.coalesce("files", F.lit(0)).alias("files"), usage.alias("usage"))


def deployment_only(files: DataFrame) -> DataFrame:
    """Repositories that hold infrastructure files and no source to deploy: their edges only count as suppressed."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    source = extension.isin(sorted(LANGUAGES))
    infra = assignment_rank(F.col("path")) == 3
    per = files.groupBy("repository").agg(F.max(infra).alias("_i"), F.max(source & ~infra).alias("_d"))
    return per.filter("_i and not _d").select("repository")


def suppress(connections: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connections without those of the repositories, and how many each of these had."""
    gone = connections.join(repositories, "repository", "left_semi").groupBy("repository").agg(F.count("*").alias("suppressed"))
    return connections.join(repositories, "repository", "left_anti"), gone


def compose_snapshot(requested: DataFrame, parts: DataFrame, key: str = "repository_id") -> tuple[DataFrame, DataFrame]:
    """Rows of the requested keys' parts, and the keys with ``ready``: a key without any part isn't."""
    want = requested.select(key).distinct()
    have = parts.select(key).distinct().withColumn("ready", F.lit(True))
    return parts.join(want, key, "left_semi"), want.join(have, key, "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def suggest_paths(files: DataFrame, typed: str, limit: int = 20) -> DataFrame:
    """Folders and files whose path holds what was typed, folders and those that start with it first."""
    low = typed.lower()
    every = directory_closure(files).select(F.col("directory").alias("path"), F.lit("directory").alias("kind")).unionByName(files.select("path", F.lit("file").alias("kind")).distinct())
    rank = F.when(F.startswith(F.lower("path"), F.lit(low)), 0).otherwise(1)
    return every.filter(F.contains(F.lower("path"), F.lit(low))).orderBy(rank, "kind", F.length("path"), "path").limit(limit)


def route_snapshot(routes: DataFrame, repositories: DataFrame) -> DataFrame:
    """Routes of the fleet as nodes with their citation, each once, for repositories one may see.

    ``routes``: repository, path, verb, route; ``repositories``: repository, revision.
    """
    r = routes.join(repositories, "repository").distinct()
    return r.select(F.concat_ws(":", F.lit("route"), "repository", "verb", "route").alias("id"), F.concat_ws(" ", "verb", "route").alias("label"), "repository", "path", citation(F.col("repository"), F.col("revision"), F.col("path"), F.lit(1), F.lit(1)).alias("citation"))
