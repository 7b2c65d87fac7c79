"""Commits and diffs: searching, sides of a patch, differences of sets of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lang import Query, QueryError
from ..plans.predicates import all_of, any_of, contains


#: Fixed value: diffs of one answer.
MOST_DIFFS = 25


def day_bound(value: str, end: bool) -> Column:
    """A time, or a bare date: its start, or for ``end`` the start of the next day."""
    if len(value) == 10:
        start = F.to_timestamp_ntz(F.lit(value), F.lit("yyyy-MM-dd"))
        return start + F.expr("INTERVAL 1 DAY") if end else start
    return F.lit(value).cast("timestamp_ntz")


def commit_predicate(query: Query, author: Column, message: Column, at: Column) -> Column:
    parts = []
    if query.text:
        parts.append(contains(message, query.text))
    # Entities need every included text, unlike evidence, which needs any.
    parts += [contains(message, v) for v in query.values("content")]
    parts += [~contains(message, v) for v in query.values("content", negative=True)]
    for name, column in (("author", author), ("message", message)):
        if wanted := [contains(column, v) for v in query.values(name)]:
            parts.append(any_of(wanted))
        parts += [~contains(column, v) for v in query.values(name, negative=True)]
    for name in ("after", "before"):
        values = query.values(name)
        if len(values) > 1:
            raise QueryError(f"only one {name} filter makes sense")
        for v in values:
            bound = day_bound(v, name == "before")
            parts.append(at >= bound if name == "after" else at < bound if len(v) == 10 else at <= bound)
    return all_of(parts)


def diff_sides(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """Added and removed text of a patch: its + and - lines without the file headers."""
    lines = F.split(F.col(patch), "\n", -1)
    side = lambda sign: F.array_join(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3))), lambda x: F.substr(x, F.lit(2))), "\n")
    return patches.select("*", side("+").alias("added"), side("-").alias("removed"))


def line_difference(left: DataFrame, right: DataFrame, key: list[str], line: str) -> DataFrame:
    """Lines of either side that the other lacks, counted as bags."""
    gone = left.select(*key, line).exceptAll(right.select(*key, line)).withColumn("side", F.lit("-"))
    come = right.select(*key, line).exceptAll(left.select(*key, line)).withColumn("side", F.lit("+"))
    return gone.unionByName(come)


def diff_stat(patches: DataFrame, most: int, patch: str = "patch") -> DataFrame:
    """Lines that came and went, and the patch cut at ``most`` code points, flagged where it was longer."""
    lines = F.split(F.col(patch), "\n", -1)
    count = lambda sign: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3))))
    return patches.select("*", count("+").alias("insertions"), count("-").alias("deletions"), F.substring(F.col(patch), 1, most).alias("shown"), (F.length(patch) > most).alias("truncated"))
