"""Findings: declared packages an advisory hits, filtered, counted, ordered and paged.

``findings`` has advisory, aliases, summary, repository, ecosystem, package, version, severity and
``occurrences``, an array of (path, usage, relationship, scope), primary first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import package_name
from .search import facets

#: Orders of severities and usages, the gravest first.
SEVERITIES = ["critical", "high", "medium", "low"]
USAGES = ["production", "implementation", "build", "development", "test"]
DEFAULT_PAGE, LARGEST_PAGE = 100, 500


def place(value: Column, order: list[str]) -> Column:
    """The place of a value in an order, that of the end for all others."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.lower(F.coalesce(value, F.lit(""))))
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def matchable_version(resolved: Column, declared: Column) -> Column:
    """``version, basis, confidence`` to match advisories by: what a lock resolved, else an exact declaration; null without."""
    lock = F.trim(F.coalesce(resolved, F.lit("")))
    plain = F.regexp_replace(F.trim(F.coalesce(declared, F.lit(""))), r"^(?:={1,3}|v(?=[0-9]))\s*", "")
    row = lambda v, b, c: F.struct(v.alias("version"), F.lit(b).alias("basis"), F.lit(c).alias("confidence"))
    return F.when(lock != "", row(lock, "resolved", "high")).when((plain != "") & ~plain.rlike(r"[<>^~*|,\[\]()\s]"), row(plain, "declared", "lower"))


def finding_id(advisory: Column, repository: Column, package: Column, version: Column) -> Column:
    """The first half of a digest over what makes a finding."""
    return F.substring(F.sha2(F.concat_ws("\0", advisory, repository.cast("string"), package, version), 256), 1, 32)


def coverage_gap(declarations: DataFrame, covered: DataFrame, ecosystems: list[str]) -> DataFrame:
    """``gap`` of declarations that can't be checked, null for those that can.

    ``declarations``: ecosystem, package, resolved, declared; ``covered``: ecosystem and package of the snapshot.
    """
    known = covered.select(F.lower("ecosystem").alias("_e"), package_name(F.col("ecosystem"), F.col("package")).alias("_p")).distinct().withColumn("_in", F.lit(True))
    own = declarations.withColumn("_e", F.lower("ecosystem")).withColumn("_p", package_name(F.col("ecosystem"), F.col("package"))).withColumn("_m", matchable_version(F.col("resolved"), F.col("declared")))
    gap = F.when(~F.col("_e").isin([e.lower() for e in ecosystems]), "uncovered_ecosystem").when(F.col("_m").isNull(), "no_resolvable_version").when(~F.col("_m.version").rlike("^[vV]?[0-9]"), "invalid_version").when(F.col("_in").isNull(), "not_in_snapshot")
    return own.join(known, ["_e", "_p"], "left").withColumn("gap", gap).drop("_e", "_p", "_m", "_in")


def with_latest(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """``latest_stable`` of the package; of several good answers the one fetched last counts.

    ``registry``: ecosystem, package, status, latest, fetched_at.
    """
    key = lambda e, p: (F.lower(e).alias("_e"), package_name(F.col(e), F.col(p)).alias("_p"))
    last = registry.filter("status = 'ok'").select(*key("ecosystem", "package"), "latest", "fetched_at").groupBy("_e", "_p").agg(F.max(F.struct("fetched_at", "latest")).alias("m")).select("_e", "_p", F.col("m.latest").alias("latest_stable"))
    own = findings.select("*", *key("ecosystem", "package"))
    return own.join(last, ["_e", "_p"], "left").drop("_e", "_p")


def finding_predicate(ecosystem: str = "", severity: str = "", usage: str = "", package: str = "", text: str = "") -> Column:
    """Filters of findings: a usage holds if any occurrence has it; ``text`` may stand in any of eight places."""
    same = lambda c, v: F.lower(F.coalesce(c, F.lit(""))) == v.strip().lower()
    parts = []
    if ecosystem.strip():
        parts.append(same(F.col("ecosystem"), ecosystem))
    if severity.strip():
        parts.append(same(F.col("severity"), severity))
    if usage.strip():
        parts.append(F.exists("occurrences", lambda o: same(o["usage"], usage)))
    if package.strip():
        parts.append(F.contains(F.lower("package"), F.lit(package.strip().lower())))
    if text.strip():
        where = F.array_join(F.transform("occurrences", lambda o: F.concat_ws(" ", o["path"], o["usage"], o["relationship"], o["scope"])), " ")
        hay = F.concat_ws("\n", "advisory", F.array_join("aliases", " "), "summary", "package", "repository", F.try_element_at("occurrences", F.lit(1))["path"], "version", where)
        parts.append(F.contains(F.lower(hay), F.lit(text.strip().lower())))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def primary_usage() -> Column:
    return F.coalesce(F.try_element_at("occurrences", F.lit(1))["usage"], F.lit(""))


def finding_order() -> list[Column]:
    return [place(F.col("severity"), SEVERITIES), place(primary_usage(), USAGES), F.lower("repository"), F.lower("package"), F.col("advisory"), F.try_element_at("occurrences", F.lit(1))["path"], F.col("id")]


def finding_page(findings: DataFrame, predicate: Column, offset: int = 0, limit: int | None = None) -> DataFrame:
    """One page of the findings that pass the filters, in order."""
    size = DEFAULT_PAGE if limit is None or limit <= 0 else min(limit, LARGEST_PAGE)
    return findings.filter(predicate).orderBy(*finding_order()).offset(max(offset, 0)).limit(size)


def finding_facets(findings: DataFrame) -> DataFrame:
    """Counts by severity, usage, repository and package."""
    return facets(findings.select("severity", primary_usage().alias("usage"), F.col("repository").cast("string").alias("repository"), "package"), ["severity", "usage", "repository", "package"])


def headlines(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings and the repositories they touch, counted apart."""
    return findings.groupBy(*by).agg(F.count("*").alias("findings"), F.count_distinct("repository").alias("repositories"))


def grouped(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("findings"))


def finding_set(observations: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """Each identity once: its first row in ``order``; the rank is a limit in each group before the shuffle."""
    return observations.withColumn("_n", F.row_number().over(W.partitionBy(*identity).orderBy(*order))).filter(F.col("_n") == 1).drop("_n")


def set_digest(rows: DataFrame, key: list[str], parts: list[str]) -> DataFrame:
    """A digest of each key's set of rows, the same for the same set in any order.

    Lanes of the rows' hashes are combined by exclusive or: mergeable, so no set is ever in one task.
    """
    h = rows.select(*key, F.md5(F.concat_ws("@", *parts)).alias("h")).distinct()
    lane = lambda k: F.bit_xor(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"lane{k}")
    return h.groupBy(*key).agg(F.count("*").alias("n"), *[lane(k) for k in range(4)])


def drift(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """How the digests of two snapshots differ, key by key: same, changed, added or removed."""
    a, b = before.alias("a"), after.alias("b")
    j = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")
    cols = ["n", *[f"lane{k}" for k in range(4)]]
    equal = F.lit(True)
    for c in cols:
        equal = equal & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    state = F.when(F.col("a.n").isNull(), "added").when(F.col("b.n").isNull(), "removed").when(equal, "same").otherwise("changed")
    return j.select(*[F.coalesce(F.col(f"b.{k}"), F.col(f"a.{k}")).alias(k) for k in key], state.alias("state"))
