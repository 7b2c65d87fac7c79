"""Filters of a query as column predicates.

Values of one field are alternatives, fields are conjoined, negatives exclude.  A filter that a
result type doesn't have is an error, never ignored.  Regular expressions stay inside the subset that
all common engines read alike.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from .lang import Query, QueryError

#: Fields each result type understands besides result_type.
ALLOWED = {
    "content": {"content", "repository", "revision", "language", "path", "file", "owner"},
    "file_path": {"content", "repository", "revision", "language", "path", "file", "owner"},
    "symbol_definition": {"content", "repository", "revision", "language", "path", "file", "symbol_kind", "package", "type_name", "method", "member", "full_name", "match", "case", "owner"},
    "reference": {"content", "repository", "revision", "language", "path", "file", "match", "case"},
    "implementation": {"content", "repository", "revision", "language", "path", "file", "match", "case"},
    "repository": {"content", "repository", "revision"},
    "commit": {"content", "repository", "revision", "path", "author", "message", "after", "before", "branch", "from", "to"},
    "diff": {"content", "repository", "revision", "path", "author", "message", "added", "removed", "after", "before", "branch", "from", "to"},
    "dependency": {"content", "repository", "revision", "path", "file", "language"},
    "route": {"content", "repository", "revision", "path", "file"},
    "wiki_page": {"content", "repository", "path", "file"},
    "code_insight": {"content", "repository", "revision", "language", "path", "file", "owner"},
    "mixed": {"content", "repository", "revision", "language", "path", "file"},
}
_UNSAFE = re.compile(r"\(\?<?[=!]|\\[1-9]|\(\?>|[*+?}]\+")


def validate(query: Query, kind: str) -> None:
    for f in query.filters:
        if f.field != "result_type" and f.field not in ALLOWED[kind]:
            raise QueryError(f"{kind} results have no {f.field} filter")


def safe_regex(pattern: str) -> str:
    """The pattern, if it has no look-around, back-reference or possessive part."""
    if _UNSAFE.search(pattern):
        raise QueryError("look-around, back-references and possessive quantifiers aren't supported")
    re.compile(pattern)
    return pattern


def contains(column: Column, value: str) -> Column:
    return F.contains(F.lower(column), F.lit(value.lower()))


def any_of(parts: list[Column]) -> Column | None:
    return reduce(lambda a, b: a | b, parts) if parts else None


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def text_predicate(query: Query, column: Column, mode: str = "substring", include: str = "any") -> Column:
    """Free text and content filters; ``include`` says whether any or all positive ones must hold."""
    match = (lambda v: column.rlike("(?i)" + safe_regex(v))) if mode == "regex" else (lambda v: contains(column, v))
    parts = [match(query.text)] if query.text else []
    wanted = [match(v) for v in query.values("content")]
    if wanted:
        parts.append(any_of(wanted) if include == "any" else all_of(wanted))
    parts += [~match(v) for v in query.values("content", negative=True)]
    return all_of(parts)


def field_predicate(query: Query, name: str, column: Column, how=contains) -> Column:
    parts = []
    wanted = [how(column, v) for v in query.values(name)]
    if wanted:
        parts.append(any_of(wanted))
    parts += [~how(column, v) for v in query.values(name, negative=True)]
    return all_of(parts)


def folded_equal(column: Column, value: str) -> Column:
    return F.lower(column) == value.lower()


def starts(column: Column, value: str) -> Column:
    return F.startswith(F.lower(column), F.lit(value.lower()))


def file_predicate(query: Query, files: dict[str, Column], mode: str = "substring", file_on_basename: bool = False) -> Column:
    """Everything but owner filters, over columns named repository, revision, language, path, text."""
    return all_of(
        [
            text_predicate(query, files["text"], mode),
            field_predicate(query, "repository", files["repository"], folded_equal),
            field_predicate(query, "revision", files["revision"], starts) if "revision" in files else F.lit(True),
            field_predicate(query, "language", files["language"], folded_equal),
            field_predicate(query, "path", files["path"]),
            field_predicate(query, "file", basename(files["path"]) if file_on_basename else files["path"]),
        ]
    )
