"""Declared dependencies against registries and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import versions
from ..functions.scalars import cvss3_score, cvss4_band, package_name, score_band


def longest_prefix(rows: DataFrame, name: str, routes: DataFrame) -> DataFrame:
    """The registry of the longest prefix of ``name``; ``routes`` has prefix and registry.

    Prefixes are found by equality: a name is exploded into its own prefixes of the lengths that the
    routes have, so a long route table costs a hash join and not a nested loop.
    """
    sized = rows.select(name).distinct()
    cuts = F.sequence(F.lit(0), F.length(name))
    candidates = sized.select(name, F.explode(F.transform(cuts, lambda n: F.substring(F.col(name), F.lit(1), n))).alias("prefix"))
    best = candidates.join(routes, "prefix").groupBy(name).agg(F.max(F.struct(F.length("prefix").alias("n"), F.col("registry"))).alias("b")).select(name, F.col("b.registry").alias("registry"))
    return rows.join(best, name, "left")


def inventory(declarations: DataFrame, registry: DataFrame) -> DataFrame:
    """Declarations with the latest stable version, their status and distance.

    ``declarations``: repository, ecosystem, package, version, exact; ``registry``: ecosystem, package, latest.
    """
    both = declarations.join(registry, ["ecosystem", "package"], "left")
    state = versions.status(F.col("version"), F.col("latest"), F.col("exact"))
    return both.withColumn("status", state).withColumn("distance", versions.distance(F.col("version"), F.col("latest"), F.col("status")))


def status_counts(inv: DataFrame) -> DataFrame:
    names = ["current", "behind", "ahead", "prerelease", "unresolved", "unavailable"]
    return inv.groupBy("ecosystem").agg(F.count("*").alias("declarations"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def advisory_severity(severity: Column) -> Column:
    """Band of the worst score of an ``array<struct<type,score,...>>``."""
    scores = F.transform(
        severity,
        lambda s: F.when(F.startswith(F.coalesce(s["score"], F.lit("")), F.lit("CVSS:4.0/")), F.element_at(F.create_map(*[F.lit(x) for p in {"critical": 9.0, "high": 7.0, "medium": 4.0, "low": 0.1, "unknown": 0.0}.items() for x in p]), cvss4_band(s["score"])))
        .when(F.startswith(F.coalesce(s["score"], F.lit("")), F.lit("CVSS:3.")), cvss3_score(s["score"]))
        .otherwise(F.when(F.trim(s["score"]).rlike(r"^[0-9]+(?:\.[0-9]+)?$"), F.trim(s["score"]).try_cast("double"))),
    )
    return score_band(F.coalesce(F.array_max(scores), F.lit(0.0)))


def match_advisories(declarations: DataFrame, advisories: DataFrame) -> DataFrame:
    """Declarations in an affected range or list of versions.

    The join is an equi-join on ecosystem and normalized package; the version range is a residual on
    its rows.  An affected entry is one row, its ranges stay an array.
    """
    entries = advisories.select("record_id", F.explode("affected").alias("f")).filter("f is not null and f.ecosystem is not null and f.name is not null").select(
        "record_id", F.lower("f.ecosystem").alias("eco"), package_name(F.col("f.ecosystem"), F.col("f.name")).alias("pkg"), F.col("f.ranges").alias("ranges"), F.col("f.versions").alias("versions")
    )
    mine = declarations.withColumn("eco", F.lower("ecosystem")).withColumn("pkg", package_name(F.col("ecosystem"), F.col("package")))
    key = lambda v: versions.version_key(F.col("eco"), v)
    listed = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False))
    ranged = F.coalesce(F.exists(F.filter("ranges", lambda r: r["events"].isNotNull()), lambda r: versions.in_events(F.col("version"), r["events"], key)), F.lit(False))
    return mine.join(entries, ["eco", "pkg"]).filter(listed | ranged).withColumn("fixed", versions.nearest_fixed(F.col("version"), F.col("ranges"), key)).drop("eco", "pkg", "ranges", "versions")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding for each advisory, repository, package and version, with its primary occurrence."""
    place = F.struct(F.col("usage_rank"), F.col("path"), F.col("line"), F.col("relationship"))
    return findings.groupBy("advisory", "repository", F.lower("package").alias("package"), "version").agg(F.min(place).alias("p"), F.count_distinct(place).alias("occurrences")).select(
        "advisory", "repository", "package", "version", "occurrences", F.col("p.path").alias("primary_path"), F.col("p.line").alias("primary_line")
    )
