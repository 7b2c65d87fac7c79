"""Owners of paths: ordered glob rules of which the last match wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import glob_regex


def parse_owners(text: str) -> list[tuple[int, str, list[str], list[str]]]:
    """Line, pattern, owners and unresolved owners of every rule of an ownership file."""
    out = []
    for number, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        fields = line.split()
        if len(fields) < 2 or fields[0].startswith("#"):
            continue
        known = [o for o in fields[1:] if (o.startswith("@") and len(o) > 1) or (not o.startswith("@") and o.partition("@")[0] and "." in o.partition("@")[2])]
        out.append((number, fields[0], known, [o for o in fields[1:] if o not in known]))
    return out


def rule_table(spark, files: dict[str, str]) -> DataFrame:
    """Rules of each repository's ownership file, with their regular expressions."""
    rows = [(repo, n, p, o, u, r) for repo, text in files.items() for n, p, o, u in parse_owners(text) if (r := glob_regex(p))]
    return spark.createDataFrame(rows, "repository string, line int, pattern string, owners array<string>, unresolved array<string>, regex string")


def resolve(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths`` (repository, path) with state, owners and rule line.

    States: owned, unresolved_owner, unowned, and unavailable for a repository without rules.  A
    repository's rules are folded into one sorted array, so the join is an equi-join on the
    repository and a path never multiplies; the last matching rule is found in the array.
    """
    packed = rules.groupBy("repository").agg(F.sort_array(F.collect_list(F.struct("line", "regex", "owners", "unresolved")), asc=False).alias("rules"))
    clean = F.regexp_replace(F.regexp_replace(F.trim("path"), r"\\", "/"), "^/", "")
    hit = F.try_element_at(F.filter("rules", lambda r: F.regexp_like(clean, r["regex"])), F.lit(1))
    out = paths.join(packed, "repository", "left").withColumn("_hit", hit)
    state = F.when(F.col("rules").isNull(), "unavailable").when(F.col("_hit").isNull(), "unowned").when((F.size("_hit.owners") == 0) | (F.size("_hit.unresolved") > 0), "unresolved_owner").otherwise("owned")
    return out.select(*paths.columns, state.alias("state"), F.array_join(F.coalesce("_hit.owners", F.array().cast("array<string>")), ",").alias("owners"), F.col("_hit.line").alias("rule_line"))
