"""Paths, names, severities and scores as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Languages of file extensions.
LANGUAGES = {
    "go": "Go", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "java": "Java", "kt": "Kotlin", "kts": "Kotlin",
    "py": "Python", "cs": "C#", "rs": "Rust", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "rb": "Ruby", "php": "PHP", "swift": "Swift",
}
#: Further labels of the source map, and the labels of the scanner.
MAP_LANGUAGES = {
    "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS", "sass": "CSS", "sql": "SQL", "md": "Markdown", "markdown": "Markdown", "yaml": "YAML", "yml": "YAML", "json": "JSON", "sh": "Shell", "bash": "Shell", "zsh": "Shell",
}
SCANNED_LANGUAGES = {
    "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "gradle": "groovy", "groovy": "groovy", "gvy": "groovy", "tsx": "tsx", "ts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "sql": "sql", "sh": "bash", "bash": "bash",
}
#: Tokens that count as branches.
BRANCHES = {
    "Python": ["if ", "elif ", "for ", "while ", " except ", " and ", " or "],
    "Go": ["if ", "for ", "case ", "&&", "||"],
    "": ["if ", "if(", "for ", "for(", "while ", "while(", "case ", "catch ", "&&", "||", " when "],
}
#: Severities that mean the same.
SEVERITIES = {"error": ["error", "critical", "blocker"], "warning": ["warning", "warn", "major"], "note": ["note", "info", "minor"], "none": ["none", ""]}


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]+)$", 1))


def language_of(path: Column, which: str = "metrics") -> Column:
    """Language by extension, '' where it is unknown; ``which`` of three sets of labels: metrics, map or scanner."""
    labels = {"metrics": LANGUAGES, "map": {**LANGUAGES, **MAP_LANGUAGES}, "scanner": SCANNED_LANGUAGES}[which]
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))


def severity(c: Column) -> Column:
    low = F.lower(trimmed(F.coalesce(c, F.lit(""))))
    out = None
    for name, same in SEVERITIES.items():
        out = F.when(low.isin(same), name) if out is None else out.when(low.isin(same), name)
    return out.otherwise(low)


def branch_points(text: Column, language: str) -> Column:
    """Occurrences of branch tokens over the trimmed lines of a text."""
    lines = F.transform(F.split(F.lower(text), "\r\n|\n"), trimmed)
    joined = F.array_join(lines, "\n")
    count = lambda t: ((F.length(joined) - F.length(F.replace(joined, F.lit(t), F.lit("")))) / len(t)).cast("long")
    tokens = BRANCHES.get(language, BRANCHES[""])
    return sum((count(t) for t in tokens[1:]), count(tokens[0]))


def service_name(c: Column) -> Column:
    """Host-like names reduced to what two sources would share."""
    out = F.regexp_replace(F.lower(trimmed(c)), r"^http://", "")
    out = F.regexp_replace(F.regexp_replace(out, r"^https://", ""), r"^lb://", "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "/.*$", ""), ":.*$", ""), r"\..*$", "")
    return F.regexp_replace(F.regexp_replace(out, "[_ ]", "-"), "^-+|-+$", "")


def package_name(ecosystem: Column, name: Column) -> Column:
    low = F.lower(ecosystem)
    return F.when(low == "pypi", F.regexp_replace(F.lower(trimmed(name)), "[-_.]+", "-")).when(low.isin("npm", "nuget"), F.lower(trimmed(name))).otherwise(trimmed(name))


def citation(repository: Column, revision: Column, path: Column, first: Column, last: Column) -> Column:
    """``repository@revision:path#Lx-Ly``."""
    return F.concat(repository, F.lit("@"), F.substring(revision, 1, 8), F.lit(":"), path, F.lit("#L"), first.cast("string"), F.when(last > first, F.concat(F.lit("-L"), last.cast("string"))).otherwise(""))


def source_window(line: Column, total: Column, before: int = 80, size: int = 200) -> Column:
    """First and last line of a window around a line."""
    first = F.greatest(F.lit(1), line - before)
    return F.struct(first.alias("first"), F.least(total, first + size - 1).alias("last"))


def glob_regex(pattern: str) -> str | None:
    """An ownership glob as a regular expression; None if it is of a kind that never matches."""
    pattern = pattern.replace("\\ ", " ").strip()
    if not pattern or pattern.startswith("!") or "[" in pattern or "]" in pattern or not pattern.strip("/"):
        return None
    body = pattern.removeprefix("/")
    folder = body.endswith("/")
    body = body.removesuffix("/")
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    middle = "".join(parts.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|[^*?]+", body))
    lead = "^" if pattern.startswith("/") or "/" in body else "(?:^|.*/)"
    return lead + middle + ("(?:/.*)?$" if folder else "$")


def vector(text: Column) -> Column:
    """Metrics of a CVSS vector as a map."""
    return F.str_to_map(text, F.lit("/"), F.lit(":"))


def _metric(m: Column, name: str, values: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), F.try_element_at(m, F.lit(name))), F.lit(0.0))


def cvss3_score(text: Column) -> Column:
    """Base score of a CVSS 3 vector, rounded up to a tenth; null if a metric is missing."""
    m = vector(text)
    changed = F.coalesce(F.try_element_at(m, F.lit("S")), F.lit("")) == "C"
    av, ac = _metric(m, "AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}), _metric(m, "AC", {"L": 0.77, "H": 0.44})
    ui = _metric(m, "UI", {"N": 0.85, "R": 0.62})
    pr = F.when(changed, _metric(m, "PR", {"N": 0.85, "L": 0.68, "H": 0.5})).otherwise(_metric(m, "PR", {"N": 0.85, "L": 0.62, "H": 0.27}))
    weight = {"H": 0.56, "L": 0.22, "N": 0.0}
    iss = 1 - (1 - _metric(m, "C", weight)) * (1 - _metric(m, "I", weight)) * (1 - _metric(m, "A", weight))
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, 15)).otherwise(6.42 * iss)
    base = F.least(F.when(changed, 1.08).otherwise(1.0) * (impact + 8.22 * av * ac * pr * ui), F.lit(10.0))
    return F.when((av == 0) | (ac == 0) | (ui == 0) | (pr == 0), None).when(impact <= 0, 0.0).otherwise(F.ceil(base * 10) / 10)


def cvss4_band(text: Column) -> Column:
    """A coarse band of a CVSS 4 vector: six impact points and plain exploitability, no official score."""
    m = vector(text)
    points = sum((_metric(m, k, {"H": 2.0, "L": 1.0}) for k in ("VI", "VA", "SC", "SI", "SA")), _metric(m, "VC", {"H": 2.0, "L": 1.0}))
    is_ = lambda k, v: F.coalesce(F.try_element_at(m, F.lit(k)) == v, F.lit(False))
    easy = is_("AV", "N") & is_("AC", "L") & is_("AT", "N") & is_("PR", "N") & is_("UI", "N")
    return F.when(easy & (points >= 6), "critical").when(points >= 4, "high").when(points >= 2, "medium").when(points > 0, "low").otherwise("unknown")


def score_band(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("unknown")


def test_path(path: Column) -> Column:
    """Whether a path is a test by its folders or its name."""
    low = F.lower(path)
    return F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(x) for x in ("test", "tests", "__tests__", "spec", "testing")])) | F.element_at(F.split(low, "/"), -1).rlike(r"^test_|\.(?:test|spec)\.|_(?:test|spec)\.[a-z]+$|tests?\.(?:java|kt|cs|swift)$")


def without_comments(text: Column) -> Column:
    """Line and block comments of C-like languages removed, literals kept."""
    return F.regexp_replace(text, r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|//[^\n]*|/\*[\s\S]*?\*/""", "$1")


def identifier_parts(name: Column) -> Column:
    """Lower-case words of an identifier: camel case, acronyms and digits apart."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([\p{Ll}\d])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"([\p{L}])(\d)", "$1 $2")), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def bounded(text: Column, most: int) -> Column:
    """White space compacted, cut at ``most`` code points with an ellipsis."""
    flat = trimmed(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) that a code-point offset stands in."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def ttl_state(status: Column, expires: Column, now: Column) -> Column:
    """Cached registry answers: usable, failed, or past their time."""
    return F.when(expires <= now, "stale").when(status == "ok", "fresh").otherwise("failed")


def private_package(package: Column, owned: list[str]) -> Column:
    """Whether any part of a package name is one of the names we own."""
    return F.arrays_overlap(F.split(F.lower(package), r"[@/:._-]+"), F.array(*[F.lit(x.lower()) for x in owned]))


def keyset_cursor(*parts: Column) -> Column:
    """An opaque cursor bound to everything that defines a page."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)
