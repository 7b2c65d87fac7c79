"""The fielded search language: tokens, parsing, completion.

A query is free text mixed with ``field:value`` filters; ``-`` negates, quotes group, a backslash
escapes inside quotes.  Colons after anything but a known field are ordinary text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Field names and aliases of the language.
ALIASES = {
    "content": "content", "repo": "repository", "repository": "repository", "rev": "revision", "revision": "revision",
    "lang": "language", "language": "language", "path": "path", "file": "file", "filename": "file",
    "kind": "symbol_kind", "symbol-kind": "symbol_kind", "symbol_kind": "symbol_kind",
    "type": "result_type", "result-type": "result_type", "result_type": "result_type",
    "owner": "owner", "package": "package", "pkg": "package", "type-name": "type_name", "type_name": "type_name",
    "method": "method", "member": "member", "full-name": "full_name", "full_name": "full_name", "match": "match", "case": "case",
    "author": "author", "message": "message", "added": "added", "removed": "removed",
    "after": "after", "date-from": "after", "date_from": "after", "before": "before", "date-to": "before", "date_to": "before",
    "branch": "branch", "from": "from", "to": "to",
}
#: Closed value sets offered by completion.
VALUES = {
    "language": ["Bash", "Go", "Groovy", "Java", "JavaScript", "Kotlin", "Python", "SQL", "TSX", "TypeScript"],
    "symbol_kind": ["class", "constant", "field", "function", "interface", "method", "module", "package", "type", "variable"],
    "result_type": ["code_insight", "commit", "content", "dependency", "diff", "file_path", "implementation", "reference", "repository", "route", "symbol_definition", "wiki_page"],
    "owner": ["owned", "unavailable", "unowned", "unresolved"],
    "match": ["exact", "prefix", "contains"],
    "case": ["insensitive", "sensitive"],
}
FIELDS = ["repository", "revision", "language", "path", "file", "symbol_kind", "result_type", "owner", "package", "type_name", "method", "member", "full_name", "match", "case", "author", "message", "added", "removed", "after", "before", "branch", "from", "to"]
RESULT_TYPES = [*VALUES["result_type"], "mixed"]
MOST_COMPLETIONS = 20
_BLANK = " \t\r\n"


class QueryError(ValueError):
    """A query that can't be meant as written."""


@dataclass(frozen=True)
class Filter:
    field: str
    value: str
    negative: bool = False


@dataclass(frozen=True)
class Query:
    raw: str
    text: str
    filters: tuple[Filter, ...] = field(default=())

    def values(self, name: str, negative: bool = False) -> list[str]:
        """Values of one field, trimmed, each once whatever its case."""
        seen: dict[str, str] = {}
        for f in self.filters:
            if f.field == name and f.negative == negative and f.value.strip():
                seen.setdefault(f.value.strip().lower(), f.value.strip())
        return list(seen.values())


def tokenize(raw: str) -> list[str]:
    out: list[str] = []
    for part in re.findall(r'(?:[^ \t\r\n"]|"(?:[^"\\]|\\.)*(?:"|\\?$))+', raw, re.S):
        token = []
        for plain, quoted in re.findall(r'([^"]+)|("(?:[^"\\]|\\.)*(?:"|\\?$))', part, re.S):
            if plain:
                token.append(plain)
                continue
            body = re.fullmatch(r'"((?:[^"\\]|\\.)*)"', quoted, re.S)
            if body is None:
                raise QueryError("the query ends within an escape" if quoted.endswith("\\") else "a quote isn't closed")
            token.append(re.sub(r"\\(.)", r"\1", body.group(1), flags=re.S))
        if any(token):
            out.append("".join(token))
    return out


def parse(raw: str) -> Query:
    free: list[str] = []
    filters: list[Filter] = []
    for token in tokenize(raw):
        sign = token[0] if len(token) > 1 and token[0] in "+-" else ""
        body = token[1:] if sign else token
        key, colon, value = body.partition(":")
        name = ALIASES.get(key.strip().lower()) if colon else None
        if name:
            if not value.strip():
                raise QueryError(f"the {name} filter has no value")
            filters.append(Filter(name, value.strip(), sign == "-"))
        elif sign == "-":
            if not body.strip():
                raise QueryError("a negative text has no value")
            filters.append(Filter("content", body, True))
        else:
            free.append(token)
    return Query(raw, " ".join(free).strip(), tuple(filters))


def result_type(query: Query) -> str:
    """The one result type asked for; content by default."""
    if query.values("result_type", negative=True):
        raise QueryError("a result type can't be negated")
    asked = [v.lower() for v in query.values("result_type")]
    if len(asked) > 1:
        raise QueryError("only one result type can be asked for")
    if asked and asked[0] not in RESULT_TYPES:
        raise QueryError(f"unknown result type {asked[0]}")
    return asked[0] if asked else "content"


def _utf16(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def complete(raw: str, cursor: int, dynamic: dict[str, list[str]] | None = None) -> list[dict]:
    """Fields or values that fit the token at ``cursor`` (offsets count UTF-16 units), at most 20."""
    at = len(raw.encode("utf-16-le")[: cursor * 2].decode("utf-16-le", "ignore"))
    start = at
    while start and raw[start - 1] not in _BLANK:
        start -= 1
    end = at
    while end < len(raw) and raw[end] not in _BLANK:
        end += 1
    typed = raw[start:at]
    sign = "-" if typed.startswith("-") else ""
    key, colon, prefix = typed.lstrip("-+").partition(":") if typed[:1] in ("-", "+") else typed.partition(":")
    span = {"replace_start": _utf16(raw[:start]), "replace_end": _utf16(raw[:end])}
    if not colon:
        offers = [f"{sign}{name}:" for name in FIELDS]
        return [{"insert_text": o, **span} for o in offers if o.startswith(typed.lower())][:MOST_COMPLETIONS]
    name = ALIASES.get(key.lower())
    if not name:
        return []
    offers = sorted(f'{sign}{name}:"{v}"' if any(c in _BLANK for c in v) else f"{sign}{name}:{v}" for v in [*VALUES.get(name, []), *(dynamic or {}).get(name, [])] if v.lower().startswith(prefix.lower()))
    return [{"insert_text": o, **span} for o in offers][:MOST_COMPLETIONS]
