"""Scopes and contexts: what a request may look at, and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Scope:
    """A repository, or a folder, a file, or lines of a file in it."""

    repository_id: int
    path: str = ""
    directory: bool = True
    lines: tuple[int, int] | None = None


def covers(a: Scope, b: Scope) -> bool:
    if a.repository_id != b.repository_id:
        return False
    if a.lines is not None and (not a.path or a.directory):
        return a == b  # some lines of every file cover no other scope
    if not a.path:
        return True
    if a.directory:
        return b.path == a.path or b.path.startswith(a.path.rstrip("/") + "/")
    return a.path == b.path and not b.directory and (a.lines is None or (b.lines is not None and a.lines[0] <= b.lines[0] and b.lines[1] <= a.lines[1]))


def compact(scopes: list[Scope]) -> list[Scope]:
    """Scopes without those that others cover; of equal ones the first stays."""
    unique = list(dict.fromkeys(scopes))
    return [s for s in unique if not any(o is not s and covers(o, s) for o in unique)]


def scope_predicate(scopes: list[Scope], repository: Column, path: Column, number: Column | None = None) -> Column:
    """Rows inside any scope; none without scopes.  Line ranges apply where ``number`` is given."""
    out = F.lit(False)
    for s in compact(scopes):
        cond = repository == s.repository_id
        if s.path:
            cond = cond & (F.startswith(path, F.lit(s.path.rstrip("/") + "/")) | (path == s.path) if s.directory else path == s.path)
        if s.lines and number is not None:
            cond = cond & number.between(*s.lines)
        out = out | cond
    return out


def allowed_ids(allow: list[set[int]], deny: set[int]) -> set[int] | None:
    """Intersection of the given allow sets without the denied ids; None means no limit.

    A set that is given but empty limits to nothing.
    """
    out: set[int] | None = None
    for s in allow:
        out = set(s) if out is None else out & s
    return None if out is None else out - deny


def effective(*named: tuple[str, DataFrame]) -> DataFrame:
    """Contexts of several origins as one list; each row tells its origins."""
    rows = None
    for origin, df in named:
        part = df.withColumn("origin", F.lit(origin))
        rows = part if rows is None else rows.unionByName(part)
    key = [c for c in rows.columns if c != "origin"]
    return rows.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))
