"""Declarations, relations and structural queries over source text of ten languages.

A scanner drops comments and literals, pairs the brackets and recognises declarations by the tokens
around a name; so every declaration has a span, a parent, annotations and modifiers, and every call,
import or base a line.  It works on one file at a time in an Arrow map; it judges no syntax, so broken
files give what can still be recognised.  ``files`` has repository, path and text, and may have file_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .python_syntax import facts

#: Languages of the scanner by extension.
LANGUAGES = {"go": "go", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "kt": "kotlin", "kts": "kotlin", "groovy": "groovy", "gradle": "groovy", "py": "python", "sql": "sql", "sh": "bash", "bash": "bash"}
_C_LIKE = {"go", "java", "javascript", "typescript", "tsx", "kotlin", "groovy"}
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<text>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|`[^`]*`?|"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?)|(?P<word>@?[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|:=|[^\s\w])"""
)
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "sealed", "open", "override", "internal", "export", "async", "readonly", "suspend", "data", "inline", "transient", "volatile"}
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "func", "function", "fun", "new", "else", "do", "try", "throw", "when", "case", "typeof", "await", "yield", "super", "this", "synchronized", "assert", "def", "in", "instanceof", "delete"}
_GO_WORDS = {"go", "defer", "select", "range"}
_TYPES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration", "object": "object_declaration", "trait": "interface_declaration"}


@dataclass
class Node:
    kind: str
    name: str
    line: int
    end_line: int = 0
    parent: int = -1
    annotations: list[str] = field(default_factory=list)
    modifiers: list[str] = field(default_factory=list)


def _scan(text: str) -> list[tuple[str, str, int]]:
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind != "skip":
            out.append((kind, s, line))
        line += s.count("\n")
    return out


def _pairs(tokens) -> dict[int, int]:
    close, stack, opener = {}, [], {")": "(", "]": "[", "}": "{"}
    for i, (kind, s, _) in enumerate(tokens):
        if kind == "sign" and s in "([{":
            stack.append(i)
        elif kind == "sign" and s in opener:
            while stack and tokens[stack[-1]][1] != opener[s]:
                stack.pop()
            if stack:
                close[stack.pop()] = i
    return close


def _c_like(text: str, language: str) -> tuple[list[Node], list[tuple[str, str, int]]]:
    t = _scan(text)
    close = _pairs(t)
    opened_by = {c: o for o, c in close.items()}
    n = len(t)
    s = lambda i: t[i][1] if 0 <= i < n else ""
    word = lambda i: 0 <= i < n and t[i][0] == "word"
    nodes: list[Node] = []
    spans: list[tuple[int, int]] = []
    relations: list[tuple[str, str, int]] = []

    def body(i: int) -> int:
        """The brace that opens the body of a declaration whose header goes on at i, or -1."""
        while i < n and s(i) not in ("{", ";", "}", "=>"):
            i = close.get(i, i) + 1
        return i if s(i) == "{" else -1

    def add(kind: str, at: int, name: str, open_: int, first: int) -> None:
        last = close.get(open_, n - 1) if open_ >= 0 else at
        node = Node(kind, name, t[first][2], t[last][2])
        i = first - 1
        while i >= 0 and (word(i) and (s(i) in _MODIFIERS or s(i)[0] == "@") or (s(i) == ")" and i in opened_by)):
            if s(i) == ")":
                opened = opened_by[i]
                if not (word(opened - 1) and s(opened - 1)[0] == "@"):
                    break
                i = opened
            elif s(i)[0] == "@":
                node.annotations.append(s(i)[1:])
            else:
                node.modifiers.append(s(i))
            i -= 1
        node.annotations = sorted(set(node.annotations))
        node.modifiers = sorted(set(node.modifiers))
        nodes.append(node)
        spans.append((first, last))

    for i in range(n):
        if not word(i):
            continue
        w, nxt = s(i), s(i + 1)
        if w == "import":
            if language == "go":
                stop = close.get(i + 1, i + 2) if nxt == "(" else i + 2
                relations += [("import", s(k).strip("\"`"), t[k][2]) for k in range(i + 1, min(stop + 1, n)) if t[k][0] == "text"]
            elif language in ("javascript", "typescript", "tsx"):
                k = i + 1
                while k < n and t[k][0] != "text" and s(k) != ";":
                    k = close.get(k, k) + 1
                if k < n and t[k][0] == "text":
                    relations.append(("import", s(k).strip("\"'`"), t[i][2]))
            else:
                k, parts = i + 1, []
                while k < n and (word(k) or s(k) in ".*") and t[k][2] == t[i][2]:
                    parts.append("" if s(k) == "static" else s(k))
                    k += 1
                relations.append(("import", "".join(parts), t[i][2]))
        elif w in _TYPES and language != "go" and word(i + 1) and s(i - 1) != ".":
            open_ = body(i + 2)
            add(_TYPES[w], i + 1, nxt, open_, i)
            k, mode = i + 2, "extends" if language == "kotlin" else ""
            while k < (open_ if open_ >= 0 else i + 2):
                if s(k) in ("extends", "implements"):
                    mode = s(k)
                elif s(k) in ("<", "("):
                    depth = 0
                    while k < open_:
                        depth += (s(k) in "<(") - (s(k) in ">)")
                        if not depth:
                            break
                        k += 1
                elif word(k) and mode and s(k) not in _MODIFIERS:
                    relations.append((mode, s(k), t[k][2]))
                k += 1
        elif language == "go" and w == "type" and word(i + 1):
            add("type_declaration", i + 1, nxt, i + 3 if s(i + 3) == "{" else -1, i)
        elif language == "go" and w == "func" and (nxt == "(" or word(i + 1)):
            at = close.get(i + 1, i) + 1 if nxt == "(" else i + 1
            if word(at) and s(at + 1) in "([":
                k = close.get(at + 1, at) + 1
                k = close.get(k, k) + 1 if s(at + 1) == "[" else k
                while k < n and s(k) != "{" and t[k][2] == t[k - 1][2]:
                    k = close.get(k, k) + 1
                add("method_declaration" if nxt == "(" else "function_declaration", at, s(at), k if s(k) == "{" else -1, i)
        elif w in ("function", "fun") and language != "java" and word(i + 1):
            at = i + 1
            while s(at + 1) == "." and word(at + 2):
                at += 2
            if s(at + 1) in "(<":
                add("function_declaration", at, s(at), body(close.get(at + 1, at) + 1), i)
        elif language == "groovy" and w == "def" and word(i + 1) and s(i + 2) == "(":
            add("function_declaration", i + 1, nxt, body(close.get(i + 2, i) + 1), i)
        elif w in ("const", "let", "var") and language in ("javascript", "typescript", "tsx") and word(i + 1) and s(i + 2) in ("=", ":"):
            k = i + 3
            k = k + 1 if s(k) == "async" else k
            k = close.get(k, k) + 1
            add("function_declaration" if s(i + 3) == "function" or s(k) == "=>" else "variable_declaration", i + 1, nxt, body(k) if s(k) == "=>" and s(k + 1) != "{" else (k + 1 if s(k) == "=>" else body(k) if s(i + 3) == "function" else -1), i)
        elif nxt == "(" and w not in _NO_CALL and w[0] != "@" and not (language == "go" and w in _GO_WORDS):
            after = close.get(i + 1, n) + 1
            typed = word(i - 1) and s(i - 1) not in ("new", "return", "throw", "else", "case", "await", "yield") or s(i - 1) in (">", "]")
            k = after
            while s(k) == "throws" or (word(k) and s(k - 1) in ("throws", ",")) or s(k) == "," and word(k + 1):
                k += 1
            if s(k) == "{" and language == "java" and typed and s(i - 1) != ".":
                first = i - 1
                while first > 0 and s(first - 1) not in (";", "{", "}", ")") and not (word(first - 1) and (s(first - 1) in _MODIFIERS or s(first - 1)[0] == "@")):
                    first -= 1
                add("method_declaration", i, w, k, first)
            elif s(k) == "{" and language == "java" and (s(i - 1) in ("{", "}", ";") or s(i - 1) in _MODIFIERS):
                add("constructor_declaration", i, w, k, i)
            elif language in ("javascript", "typescript", "tsx") and s(body(after)) == "{" and s(i - 1) in ("{", "}", ";", "async", "static", "get", "set", "public", "private", "protected") and body(after) == after:
                add("method_declaration", i, w, after, i)
            elif s(i - 1) not in ("func", "function", "fun", "def"):
                k, parts = i, [w]
                while s(k - 1) == "." and word(k - 2):
                    k -= 2
                    parts.insert(0, s(k))
                relations.append(("call", ".".join(parts), t[i][2]))
    order = sorted(range(len(nodes)), key=lambda k: (spans[k][0], -spans[k][1]))
    out, stack = [], []
    for k in order:
        while stack and spans[stack[-1][0]][1] < spans[k][0]:
            stack.pop()
        nodes[k].parent = stack[-1][1] if stack else -1
        stack.append((k, len(out)))
        out.append(nodes[k])
    return out, relations


_SQL = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view|function|procedure|index|type)\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)", re.I)
_SHELL = re.compile(r"^[ \t]*(?:function[ \t]+([\w:-]+)|([\w:-]+)[ \t]*\(\))", re.M)


def analyze(path: str, text: str) -> tuple[str, list[Node], list[tuple[str, str, int]]]:
    """Language, declarations in order of place, and relations (kind, target, line) of one file."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "", "")
    if language in _C_LIKE:
        return language, *_c_like(text, language)
    nodes: list[Node] = []
    if language == "python":
        found = facts(text)
        nodes = sorted((Node(f"{k}_definition", name, lo, hi) for what, k, name, lo, hi in found if what == "symbol"), key=lambda x: (x.line, -x.end_line))
        for i, x in enumerate(nodes):
            x.parent = next((j for j in range(i - 1, -1, -1) if nodes[j].end_line >= x.end_line and nodes[j].line <= x.line), -1)
        return language, nodes, [(k, name, lo) for what, k, name, lo, _ in found if what == "relation"]
    pattern = _SQL if language == "sql" else _SHELL if language == "bash" else None
    for m in pattern.finditer(text) if pattern else ():
        line = text.count("\n", 0, m.start()) + 1
        kind, name = (f"create_{m.group(1).lower()}", m.group(2)) if language == "sql" else ("function_definition", m.group(1) or m.group(2))
        nodes.append(Node(kind, name, line, line))
    return language, nodes, []


# ---------------------------------------------------------------- tables
_NODES = "file_id long, repository string, path string, language string, nth int, kind string, name string, line int, end_line int, parent int, annotations array<string>, modifiers array<string>"
_RELATIONS = "file_id long, repository string, path string, language string, nth int, kind string, target string, line int"


def _mapped(files: DataFrame, schema: str, each) -> DataFrame:
    """``each(path, text)`` of every file as rows behind file_id, repository and path; copies of a file merge by their id."""
    known = "file_id" in files.columns
    types = files.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cols: list[list] = [[] for _ in arrow]
            for file_id, repo, path, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                for row in each(path, text):
                    for c, v in zip(cols, (file_id, repo, path, *row)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    picked = files.filter("text is not null and path is not null").select((F.col("file_id").cast("long") if known else F.lit(None).cast("long")).alias("file_id"), F.col("repository").cast("string"), "path", "text")
    out = picked.mapInArrow(run, schema)
    return out.distinct() if known else out


def declarations(files: DataFrame) -> DataFrame:
    """One row a declaration: kind, name, span, parent (number of the declaration around it), annotations, modifiers."""

    def each(path: str, text: str):
        language, nodes, _ = analyze(path, text)
        for i, x in enumerate(nodes):
            yield language, i, x.kind, x.name, x.line, x.end_line, x.parent, x.annotations, x.modifiers

    return _mapped(files, _NODES, each)


def relations(files: DataFrame) -> DataFrame:
    """One row a call, import, extends or implements, with the line it stands in."""

    def each(path: str, text: str):
        language, _, found = analyze(path, text)
        for i, (kind, target, line) in enumerate(found):
            yield language, i, kind, target, line

    return _mapped(files, _RELATIONS, each)


# ---------------------------------------------------------------- structural queries
@dataclass
class Pattern:
    kind: str
    capture: str = ""
    name_capture: str = ""
    children: list[Pattern] = field(default_factory=list)


def parse_pattern(text: str) -> tuple[Pattern, list[tuple[str, str, str]]]:
    """A pattern such as ``(class_declaration name: (identifier) @c (method_declaration name: (identifier) @m)) (#eq? @m "run")``.

    ``_`` is any kind; ``body`` nodes are transparent; predicates are ``#eq?``, ``#not-eq?`` and ``#match?``.
    """
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|[()]|#[\w-]+\?|@[\w.]+|[\w-]+:|[\w-]+', text)
    at = 0
    tests: list[tuple[str, str, str]] = []

    def node() -> Pattern | None:
        nonlocal at
        if at >= len(tokens) or tokens[at] != "(":
            raise ValueError("a pattern starts with a parenthesis")
        at += 1
        if tokens[at].startswith("#"):
            tests.append((tokens[at], tokens[at + 1].lstrip("@"), re.sub(r"\\(.)", r"\1", tokens[at + 2].strip('"'))))
            at += 4
            return None
        out = Pattern(tokens[at])
        at += 1
        label = ""
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at].endswith(":"):
                label = tokens[at][:-1]
                at += 1
                continue
            child = node()
            if child is None:
                continue
            if label == "name":
                out.name_capture = child.capture
            elif child.kind.endswith("body") or child.kind == "block":
                out.children += child.children
            else:
                out.children.append(child)
            label = ""
        if at >= len(tokens):
            raise ValueError("a parenthesis isn't closed")
        at += 1
        if at < len(tokens) and tokens[at].startswith("@"):
            out.capture = tokens[at][1:]
            at += 1
        return out

    root = None
    while at < len(tokens):
        got = node()
        root = root or got
    if root is None:
        raise ValueError("the pattern has no node")
    return root, tests


def root_kinds(pattern: Pattern) -> list[str]:
    """Kinds a match starts from: what a prefilter may ask for; none if any kind will do."""
    return [] if pattern.kind == "_" else [pattern.kind]


def match(nodes: list[Node], pattern: Pattern, tests: list[tuple[str, str, str]]) -> list[dict[str, tuple[str, int]]]:
    """Captures (name and line) of every match in a file's declarations."""
    below: dict[int, list[int]] = {}
    for i, x in enumerate(nodes):
        below.setdefault(x.parent, []).append(i)

    def at(i: int, p: Pattern) -> list[dict]:
        x = nodes[i]
        if p.kind not in ("_", x.kind):
            return []
        found: list[dict] = [{}]
        for c in (p.capture, p.name_capture):
            if c:
                found[0][c] = (x.name, x.line)
        for child in p.children:
            hits = [h for k in below.get(i, []) for h in at(k, child)]
            found = [{**f, **h} for f in found for h in hits]
        return found

    def holds(hit: dict) -> bool:
        for op, capture, value in tests:
            name = hit.get(capture, ("", 0))[0]
            ok = bool(re.search(value, name)) if op == "#match?" else name == value
            if ok == (op == "#not-eq?"):
                return False
        return True

    return [h for i in range(len(nodes)) for h in at(i, pattern) if holds(h)]


def structural_search(files: DataFrame, query: str) -> DataFrame:
    """``file_id, repository, path, nth, capture, name, line`` of every match of a tree pattern.

    Files come to the scanner only if they hold the words that the kinds it starts from need.
    """
    pattern, tests = parse_pattern(query)
    words = {"class_declaration": ["class"], "interface_declaration": ["interface", "trait"], "enum_declaration": ["enum"], "record_declaration": ["record"], "type_declaration": ["type"], "class_definition": ["class"], "function_definition": ["def", "function", "("], "function_declaration": ["func", "fun", "function", "def", "=>"]}
    need = words.get(pattern.kind)
    kept = files
    if need:
        cond = F.lit(False)
        for w in need:
            cond = cond | F.contains("text", F.lit(w))
        kept = files.filter(cond)

    def each(path: str, text: str):
        _, nodes, _ = analyze(path, text)
        for nth, hit in enumerate(match(nodes, pattern, tests)):
            for capture, (name, line) in sorted(hit.items()):
                yield nth, capture, name, line

    return _mapped(kept, "file_id long, repository string, path string, nth int, capture string, name string, line int", each)
