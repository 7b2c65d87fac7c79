"""Content, path and mixed search with explainable ranking, facets and honest totals.

Predicates are plain column expressions over the scan, so pruning and pushdown are the optimizer's;
line explosion happens after filtering; bodies are dropped before anything is sorted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.lang import Query
from ..plans.predicates import basename, contains, file_predicate, safe_regex

#: Signals that rank a match, and the words of a query that cancel a penalty.
WEIGHTS = {
    "exact_path": 100, "filename_prefix": 60, "path_contains": 30, "filename_only_match": 10, "exact_symbol": 90, "exact_ast_target": 90, "identifier_path": 40,
    "test_path": -30, "compat_path": -20, "example_path": -20, "stub_path": -10,
}
ASKED = {
    "test_path": ["test", "tests", "testing", "spec"], "compat_path": ["compat", "compatibility", "legacy"], "example_path": ["example", "examples", "documentation", "docs"],
    "stub_path": ["declaration", "declarations", "types", "typing", "init", "package", "metadata"],
}
COMPAT_PARTS, EXAMPLE_PARTS, STUB_NAMES = ["compat", "_compat", "legacy"], ["example", "examples", "_example", "_examples", "doc_src", "docs_src"], ["__init__.py", "package-info.java"]
SOURCE_WEIGHT, COHERENCE_STEP, COHERENCE_MOST = 40.0, 10, 30
#: Path parts, names and endings that say test.
TEST_PARTS = ["test", "tests", "__tests__", "spec", "testing"]
TEST_ENDINGS = ["_test.go", "_test.py", "_test.rb", "_spec.rb", "_test.cpp", "_test.c", "_test.dart", "_test.lua", "_spec.lua", "test.java", "tests.java", "test.kt", "tests.kt", "spec.kt", "test.swift", "tests.swift", "spec.swift", "test.cs", "tests.cs", "spec.scala", "suite.scala", "test.scala"]
#: Results of a page by default and at most, and matches counted at most.
DEFAULT_LIMIT, MOST, MOST_MATCHES = 100, 500, 5000


def page_limit(asked: int | None) -> int:
    """The size of a page: the default where none is asked for, never more than the most."""
    return DEFAULT_LIMIT if asked is None or asked <= 0 else min(asked, MOST)


def once(slim: DataFrame) -> DataFrame:
    """Rows of files delivered twice, once; what carries a text must be projected away before."""
    return slim.distinct() if "file_id" in slim.columns else slim


def lines(files: DataFrame, text: str = "text", first: int = 1, last: int | None = None) -> DataFrame:
    """One row for each line, numbered from 1; carriage returns stay with the line.

    Lines outside ``first`` to ``last`` are cut from the array before it is exploded.
    """
    parts = F.split(F.col(text), "\n", -1)
    if first > 1 or last is not None:
        parts = F.slice(parts, first, (1 << 30) if last is None else last - first + 1)
    return files.select("*", F.posexplode(parts).alias("pos", "line")).withColumn("number", F.col("pos") + first).drop("pos", text)


def occurrences(column: Column, literal: str) -> Column:
    """Non-overlapping occurrences, case apart."""
    return F.size(F.split(F.lower(column), re.escape(literal.lower()), -1)) - 1


def search_content(files: DataFrame, query: Query, mode: str = "substring") -> DataFrame:
    """Files that match, with match count, matching lines and the first of them.

    ``files`` has repository, language, path and text (null texts match nothing).
    """
    cols = {c: F.col(c) for c in files.columns}
    kept = files.filter(F.col("text").isNotNull() & file_predicate(query, cols, mode))
    same = [c for c in ("file_id", "repository", "path", "language") if c in files.columns]
    if not query.text:
        return once(kept.select(*same, F.lit(0).alias("match_count"), F.lit(0).alias("line_count"), F.lit(None).cast("int").alias("first_line")))
    if mode == "regex":
        hit = lambda line: line.rlike("(?i)" + safe_regex(query.text))
        count = F.size(F.regexp_extract_all(F.col("text"), F.lit("(?i)" + query.text), F.lit(0)))
    else:
        hit = lambda line: contains(line, query.text)
        count = occurrences(F.col("text"), query.text)
    per_line = F.split(F.col("text"), "\n", -1)
    numbers = F.filter(F.transform(per_line, lambda line, i: F.when(hit(line), i + 1)), lambda n: n.isNotNull())
    slim = kept.select(*same, count.alias("match_count"), numbers.alias("n")).select(*same, "match_count", F.size("n").alias("line_count"), F.try_element_at("n", F.lit(1)).cast("int").alias("first_line"))
    return once(slim)


def with_identity(matches: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches with the name and revision of their repository, and one row that says how many had none.

    ``matches``: repository_id; ``repositories``: id, name, indexed_commit.  A match of a repository that
    is gone or not visible is dropped, never shown without its identity.
    """
    who = repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("repository_name"), F.col("indexed_commit").alias("indexed_revision"))
    return matches.join(who, "repository_id"), matches.join(who.select("repository_id"), "repository_id", "left_anti").agg(F.count("*").alias("dropped"))


def matching_lines(files: DataFrame, keep) -> DataFrame:
    """Lines for which ``keep(line)`` holds, with the line before and after ('' at the ends).

    Neighbours are read from the split array by index, so only matching lines leave the scan and nothing
    is sorted; files delivered twice are told by ``file_id``.
    """
    parts = F.split(F.col("text"), "\n", -1)
    at = lambda i: F.coalesce(F.when(i >= 0, F.get("_a", i)), F.lit(""))
    hits = F.filter(F.transform("_a", lambda x, i: F.when(keep(x), F.struct((i + 1).alias("number"), x.alias("line"), at(i - 1).alias("before"), at(i + 1).alias("after")))), lambda m: m.isNotNull())
    rows = files.filter(F.col("text").isNotNull() & keep(F.col("text"))).withColumn("_a", parts)
    return once(rows.select("file_id", F.explode(hits).alias("m")).select("file_id", "m.number", "m.line", "m.before", "m.after"))


def query_terms(text: str) -> list[str]:
    """Words of a query as identifiers are split: camel case, acronyms and digits apart."""
    return [t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", text)]


def _overlap(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)))


def _meets(term: str):
    return lambda w: (w == term) | ((F.length(w) >= 3) & (F.lit(len(term)) >= 3) & (F.startswith(w, F.lit(term)) | F.startswith(F.lit(term), w)))


def ranking_signals(query: Query, path: Column, line_count: Column, kind: str = "content", symbol: Column | None = None) -> dict[str, Column]:
    """Weight of every signal for a match, 0 where it doesn't apply.

    ``symbol`` is the name a definition (kind ``symbol_definition``) or a tree match (``ast``) captured.
    """
    needle = query.text.strip().lower()
    low, name = F.lower(path), F.lower(basename(path))
    terms = query_terms(query.text)
    asked = [*terms, *(t for f in query.filters if not f.negative and f.field in ("path", "file") for t in query_terms(f.value))]
    exact = (low == needle) | (name == needle) if needle else F.lit(False)
    prefix = F.startswith(name, F.lit(needle)) if needle else F.lit(False)
    inside = F.contains(low, F.lit(needle)) if needle else F.lit(False)
    parts = F.split(low, "/")
    has = lambda words: F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))
    test = has(TEST_PARTS) | F.startswith(name, F.lit("test_")) | name.rlike(r"\.test\.|\.spec\.") | name.rlike("(?:" + "|".join(re.escape(e) for e in TEST_ENDINGS) + ")$")
    words = F.filter(F.split(F.lower(F.regexp_replace(path, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")
    met = [F.exists(words, _meets(t)).cast("int") for t in terms]
    named = F.lower(symbol) == needle if symbol is not None and needle else F.lit(False)
    holds = {
        "exact_path": exact, "filename_prefix": ~exact & prefix, "path_contains": ~exact & ~prefix & inside, "filename_only_match": F.lit(kind == "file_path" and bool(needle)),
        "exact_symbol": named & F.lit(kind == "symbol_definition"), "exact_ast_target": named & F.lit(kind == "ast"),
        "test_path": test, "compat_path": has(COMPAT_PARTS), "example_path": has(EXAMPLE_PARTS), "stub_path": F.endswith(name, F.lit(".d.ts")) | name.isin(STUB_NAMES),
    }
    cancelled = {k for k, wanted in ASKED.items() if any(_overlap(t, w) for t in asked for w in wanted)}
    out = {k: F.lit(0.0) if k in cancelled else F.when(cond, float(WEIGHTS[k])).otherwise(0.0) for k, cond in holds.items()}
    out["identifier_path"] = sum(met[1:], met[0]) * float(WEIGHTS["identifier_path"]) / len(terms) if terms else F.lit(0.0)
    out["coherence"] = F.when(line_count > 1, F.least((line_count - 1) * COHERENCE_STEP, F.lit(COHERENCE_MOST)).cast("double")).otherwise(0.0)
    return out


def score_places(scores: DataFrame) -> DataFrame:
    """``score, place``: the rank, with ties and gaps, of every distinct positive score; ``scores`` has one row a match.

    A window over all scores would be one task.  Rows are counted by score and the counts are summed
    from the top in three steps, over a thousand whole numbers, over a thousand of such blocks, and over
    the blocks of blocks, of which counts below 2**31 have at most 2,048.
    """
    above = lambda key, order: F.coalesce(F.sum("_n").over((W.partitionBy(*key) if key else W).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = scores.filter("score > 0").groupBy("score").agg(F.count("*").alias("_n")).withColumn("_g1", F.floor(F.col("score") / 1024)).withColumn("_g0", F.floor(F.col("score") / (1 << 20)))
    mid = per.groupBy("_g0", "_g1").agg(F.sum("_n").alias("_n"))
    top = mid.groupBy("_g0").agg(F.sum("_n").alias("_n"))
    top = top.select("_g0", above([], "_g0").alias("_a0"))
    mid = mid.select("_g0", "_g1", above(["_g0"], "_g1").alias("_a1")).join(top, "_g0")
    return per.select("score", "_g1", above(["_g1"], "score").alias("_a2")).join(mid, "_g1").select("score", (F.col("_a0") + F.col("_a1") + F.col("_a2") + 1).alias("place"))


def rank(matches: DataFrame, query: Query, limit: int, kind: str = "content") -> DataFrame:
    """The best ``limit`` matches by class, typed priority, weight, score and identity.

    ``matches`` has repository, path, score, line_count, and may have symbol.  Scores enter by their rank
    with ties: the distinct scores are ranked, not the rows.
    """
    signals = ranking_signals(query, F.col("path"), F.col("line_count"), kind, F.col("symbol") if "symbol" in matches.columns else None)
    typed = 1 if query.text and kind in ("file_path", "symbol_definition", "ast") else 0
    named = matches.select("*", *[c.alias(f"_{n}") for n, c in signals.items()])
    joined = named.join(score_places(named), "score", "left").withColumn("_source", F.when(F.col("place").isNotNull(), SOURCE_WEIGHT / F.col("place")).otherwise(0.0))
    weight = F.round(sum((F.col(f"_{n}") for n in signals), F.lit(0.0)) + F.col("_source"), 6)
    klass = F.when((F.col("_exact_path") > 0) | (F.col("_exact_symbol") > 0) | (F.col("_exact_ast_target") > 0), 3).when(F.col("_filename_prefix") > 0, 2).when(F.col("_path_contains") > 0, 1).otherwise(0)
    out = joined.select("repository", "path", "score", "line_count", *(["symbol"] if "symbol" in matches.columns else []), klass.alias("rank_class"), F.lit(typed).alias("typed"), weight.alias("weight"))
    return out.orderBy(F.desc("rank_class"), F.desc("typed"), F.desc("weight"), F.desc("score"), "repository", "path").limit(limit)


def facets(matches: DataFrame, fields: list[str]) -> DataFrame:
    """Counts by field and value; null or empty values have none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return matches.select(pairs.alias("p")).select("p.field", "p.value").filter("value is not null and value <> ''").groupBy("field", "value").agg(F.count("*").alias("count"))


def totals(matches: DataFrame, limit: int) -> DataFrame:
    """One row that says how much there is and whether a page of ``limit`` shows all of it."""
    return matches.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("match_count"), F.lit(0)).cast("long").alias("total_matches")).select("*", (F.col("total_files") > limit).alias("truncated"))


def mixed(content: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """Content and path results in one list, a bag; the heavier first."""
    cols = ["result_type", "repository", "path", "weight"]
    return content.select(cols).unionByName(paths.select(cols)).orderBy(F.desc("weight"), "result_type", "repository", "path").limit(limit)


def directory_closure(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every directory above any path, each once, with the files below it."""
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return paths.filter(F.size(parts) > 1).select(F.explode(ups).alias("directory")).groupBy("directory").agg(F.count("*").alias("files"))


def fragments(column: Column, literal: str) -> Column:
    """Half-open code-point ranges of the non-overlapping occurrences, case apart."""
    parts = F.split(F.lower(column), re.escape(literal.lower()), -1)
    size = len(literal)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + size).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p)).alias("start"), (acc["at"] + F.length(p) + size).alias("end")))).alias("out"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), empty, step, lambda acc: acc["out"])
