"""Filters that look at the fleet or at several columns, and what a request's values mean.

Driver-side values are a request's own (a handful); anything that grows is a column expression or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lang import Query, QueryError
from .predicates import all_of, any_of, contains

#: Languages of the filter, with the other names they go by.
LANGUAGE_NAMES = {
    "Bash": ["bash", "sh", "shell", "zsh"], "C": ["c"], "C#": ["c#", "csharp", "cs"], "C++": ["c++", "cpp"], "Go": ["go", "golang"], "Groovy": ["groovy"], "Java": ["java"], "JavaScript": ["javascript", "js", "node"], "JSON": ["json"],
    "Kotlin": ["kotlin", "kt"], "PHP": ["php"], "Python": ["python", "py", "python3"], "Ruby": ["ruby", "rb"], "Rust": ["rust", "rs"], "SQL": ["sql"], "Swift": ["swift"], "TSX": ["tsx"], "TypeScript": ["typescript", "ts"], "YAML": ["yaml", "yml"],
}


def compact_values(values: list[str]) -> list[str]:
    """Values trimmed, without empty ones, each once whatever its case; the first spelling stays."""
    seen: dict[str, str] = {}
    for v in values:
        if v.strip():
            seen.setdefault(v.strip().lower(), v.strip())
    return list(seen.values())


def canonical_languages(values: list[str]) -> tuple[list[str], list[str]]:
    """Names of the languages asked for, and a warning for each that is unknown - it matches nothing."""
    known = {alias: name for name, aliases in LANGUAGE_NAMES.items() for alias in [name.lower(), *aliases]}
    names, warnings = [], []
    for v in compact_values(values):
        if v.lower() not in known:
            warnings.append(f"unknown language {v!r} matches no file")
        names.append(known.get(v.lower(), v.lower()))
    return compact_values(names), warnings


def language_predicate(column: Column, values: list[str]) -> Column:
    """Rows of any of the languages asked for, whichever of its names the column has; no values, no limit."""
    names, _ = canonical_languages(values)
    if not names:
        return F.lit(True)
    spelled = {a for n in names for a in [n.lower(), *LANGUAGE_NAMES.get(n, [])]}
    return F.lower(F.trim(column)).isin(sorted(spelled))


def resolve_repositories(repositories: DataFrame, values: list[str]) -> list[int]:
    """The ids that values name, each exactly one repository by number or by name, case apart.

    Three rows a value are asked for at most, however large the catalogue is.
    """
    out = []
    for v in compact_values(values):
        cond = F.col("id") == int(v) if v.isdigit() else F.lower("name") == v.lower()
        hits = [r[0] for r in repositories.filter(cond).select("id").distinct().limit(2).collect()]
        if len(hits) != 1:
            raise QueryError(f"repository {v!r} is not one visible repository")
        out.append(hits[0])
    return sorted(set(out))


def revision_predicate(column: Column, values: list[str]) -> Column:
    """Rows whose revision starts with any of the values, case apart."""
    wanted = [F.startswith(F.lower(F.trim(column)), F.lit(v.lower())) for v in compact_values(values)]
    return any_of(wanted) if wanted else F.lit(True)


def any_path_predicate(query: Query, paths: Column) -> Column:
    """Path and file filters over an array of paths: one path must pass all of them."""

    def one(path: Column) -> Column:
        parts = []
        for name, col in (("path", path), ("file", F.element_at(F.split(path, "/"), -1))):
            if wanted := [contains(col, v) for v in query.values(name)]:
                parts.append(any_of(wanted))
            parts += [~contains(col, v) for v in query.values(name, negative=True)]
        return all_of(parts)

    if not any(f.field in ("path", "file") for f in query.filters):
        return F.lit(True)
    return F.coalesce(F.exists(paths, one), F.lit(False))


def owner_predicate(query: Query, owners: Column, state: Column) -> Column:
    """Every owner asked for must own; none that is excluded may.  States are values too.

    ``owners`` is an array, ``state`` one of owned, unowned, unresolved_owner, unavailable.
    """
    states = {"owned", "unowned", "unresolved", "unresolved_owner", "unavailable"}

    def holds(v: str) -> Column:
        if v.lower() in states:
            return state == ("unresolved_owner" if v.lower() == "unresolved" else v.lower())
        return F.coalesce(F.exists(owners, lambda o: F.lower(o) == v.lower()), F.lit(False))

    return all_of([*(holds(v) for v in query.values("owner")), *(~holds(v) for v in query.values("owner", negative=True))])


def columns_contain(columns: list[str], text: str) -> Column:
    """Text that stands in any of the columns, case apart; null columns hold nothing."""
    return any_of([F.coalesce(contains(F.col(c), text), F.lit(False)) for c in columns]) if text.strip() else F.lit(True)


def tree_prefilter(path: Column, prefix: str, node_kinds: Column, roots: list[str]) -> Column:
    """Files a tree pattern may match: below the prefix, and with a node of a kind it starts from, where kinds are known."""
    under = F.startswith(path, F.lit(prefix)) if prefix else F.lit(True)
    if not roots:
        return under
    known = F.coalesce(F.size(node_kinds), F.lit(0)) > 0
    return under & (~known | F.arrays_overlap(node_kinds, F.array(*[F.lit(r) for r in roots])))


def declaration_predicate(package: str = "", text: str = "", **equal: str) -> Column:
    """Filters of an inventory: part of a package name, fold-equal columns, and text in any of seven columns."""
    allowed = {"ecosystem", "resolution", "usage", "relationship", "check_status", "distance"}
    if unknown := set(equal) - allowed:
        raise QueryError(f"an inventory has no {sorted(unknown)[0]} filter")
    parts = [F.lower(F.coalesce(F.col(k), F.lit(""))) == v.strip().lower() for k, v in equal.items() if v.strip()]
    if package.strip():
        parts.append(contains(F.col("package"), package.strip()))
    if text.strip():
        parts.append(F.contains(F.lower(F.concat_ws("\n", "package", "repository", "path", "declared", "resolved", "usage", "scope")), F.lit(text.strip().lower())))
    return all_of(parts)
