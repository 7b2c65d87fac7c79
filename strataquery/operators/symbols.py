"""Definitions and references: compiler evidence over syntax, containment, resolution by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .graph import tightest_container


def merge_definitions(syntax: DataFrame, compiler: DataFrame, key: list[str]) -> DataFrame:
    """All compiler definitions, and syntax ones whose key no compiler definition has."""
    rest = syntax.join(compiler.select(key).distinct(), key, "left_anti")
    return compiler.withColumn("source", F.lit("compiler")).unionByName(rest.withColumn("source", F.lit("syntax")))


def name_match(name: Column, wanted: str, how: str = "exact", sensitive: bool = False) -> Column:
    """Match a qualified name, or its last part, exactly, by prefix or by part."""
    a, b = (name, wanted) if sensitive else (F.lower(name), wanted.lower())
    last = F.element_at(F.split(a, r"[.#/:]+"), -1)
    if how == "exact":
        return (a == b) | (last == b)
    if how == "prefix":
        return F.startswith(a, F.lit(b)) | F.startswith(last, F.lit(b))
    if how == "contains":
        return F.contains(a, F.lit(b))
    raise ValueError(f"unknown match mode {how}")


def target_name(target: Column) -> Column:
    """What a relation's target would be declared as: no generics, no punctuation, the last part."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(target), r"<.*$|\[.*$|\(.*$", ""), r"^[*&@\s]+|[?!;,\s]+$", "")
    return F.element_at(F.split(plain, r"::|->|[./#$]"), -1)


def resolve_targets(relations: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each relation with the definitions of its target's simple name; several make it ambiguous.

    ``relations``: repository_id, path, line, target; ``definitions``: repository_id, name, def_path.
    """
    named = relations.withColumn("name", target_name(F.col("target")))
    many = definitions.groupBy("repository_id", "name").agg(F.count("*").alias("candidates"))
    out = named.join(many, ["repository_id", "name"], "left")
    one = definitions.join(many.filter("candidates = 1"), ["repository_id", "name"], "left_semi").select("repository_id", "name", "def_path")
    state = F.when(F.col("candidates").isNull(), "external").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return out.join(one, ["repository_id", "name"], "left").select("repository_id", "path", "line", "target", state.alias("state"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "def_path")


def containing(relations: DataFrame, spans: DataFrame) -> DataFrame:
    """The tightest declaration around each relation."""
    return tightest_container(relations.select("repository_id", "path", "line").distinct(), spans, ["repository_id", "path"], "line")


def capped(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, flagged where the group has more."""
    w = W.partitionBy(*group).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most + 1)
    more = kept.filter(F.col("_n") == most + 1).select(*group).withColumn("truncated", F.lit(True))
    return kept.filter(F.col("_n") <= most).drop("_n").join(more, group, "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def packages_used(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Declared packages an import path lies in: the package itself or a path below it.

    Import paths are exploded into their leading parts, so this is an equi-join.
    """
    parts = F.split("import_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return imports.withColumn("package", F.explode(ups)).join(packages, ["repository_id", "package"]).groupBy("repository_id", "package").agg(F.count("*").alias("imports"))


def scip_resolve(symbols: DataFrame, occurrences: DataFrame, wanted: DataFrame, kind: str = "implementation") -> DataFrame:
    """Occurrences of symbols related to ``wanted`` (``symbol``): itself, or what declares the relationship.

    ``symbols``: id, relationships array<struct<symbol, reference, implementation, ...>>.
    """
    related = symbols.select(F.col("id").alias("symbol"), F.explode("relationships").alias("r")).filter(F.col(f"r.{kind}")).select("symbol", F.col("r.symbol").alias("to"))
    via = related.join(wanted.select(F.col("symbol").alias("to")), "to", "left_semi").select("symbol")
    return occurrences.join(wanted.select("symbol").unionByName(via).distinct(), "symbol", "left_semi").withColumn("line", F.col("start_line") + 1)
