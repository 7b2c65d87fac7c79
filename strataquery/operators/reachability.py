"""What of a repository's declarations is reached from outside, with a witness: source text in, verdicts out.

Plan: declarations and relations come from one scan each; a relation belongs to the tightest declaration
around its line (an equi-join on file and block of lines) and leads to the declarations of its target's
simple name in the repository.  Pairs of a declaration and a name are made distinct before that join, so a
name that is called over and over fans out once.  Edges of bases turn around; the closure starts from
mains, initializers and what frameworks enter; every node reached keeps the node before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from ..sources import syntax_nodes
from .graph import reach_edges, reachable, root_kind, tightest_container, verdicts
from .symbols import target_name


def report(files: DataFrame, scratch: Scratch) -> DataFrame:
    """``repository, path, kind, name, line, root, state, distance, parent, ambiguous`` of every declaration.

    ``files``: repository, path, text, and file_id where files may be delivered twice.  A repository with a
    file whose text is missing is incomplete, so nothing of it is called unreachable.  ``ambiguous``: some
    relation that leads here could also lead elsewhere.
    """
    node = F.concat_ws("#", "repository", "path", "kind", "name", F.col("line").cast("string"))
    d = scratch.save(syntax_nodes.declarations(files).filter("kind <> 'variable_declaration'").withColumn("node", node).dropDuplicates(["node"]), "declarations")
    r = scratch.save(syntax_nodes.relations(files).select("repository", "path", F.col("line").cast("long").alias("line"), "kind", target_name(F.col("target")).alias("simple")).distinct(), "relations")
    spans = d.select("repository", "path", F.col("line").cast("long").alias("lo"), F.col("end_line").cast("long").alias("hi"), F.col("node").alias("name"))
    around = tightest_container(r.select("repository", "path", "line").distinct(), spans, ["repository", "path"], "line")
    calls = r.join(around, ["repository", "path", "line"]).select("repository", F.col("name").alias("source"), "simple", F.col("kind").alias("relation")).distinct()
    named = d.select("repository", F.col("name").alias("simple"), F.col("node").alias("target"))
    many = named.groupBy("repository", "simple").agg(F.count("*").alias("candidates"))
    hits = scratch.save(calls.join(named, ["repository", "simple"]).join(many, ["repository", "simple"]).select("source", "target", F.col("relation").alias("kind"), "candidates"), "hits")
    root = root_kind(F.col("language"), F.col("name"), F.col("annotations"))
    roots = d.select("node", root.alias("root")).filter("root is not null")
    reached = reachable(reach_edges(hits), roots, scratch, witness=True)
    partial = files.filter("text is null").select("repository").distinct().withColumn("_partial", F.lit(True))
    private = F.array_contains("modifiers", "private") | (F.lower("language").isin("go", "python") & F.col("name").rlike("^[a-z_]"))
    symbols = d.join(partial, "repository", "left").select("node", "repository", "path", "kind", "name", "line", private.alias("private"), F.col("_partial").isNull().alias("complete"))
    loose = hits.groupBy(F.col("target").alias("node")).agg(F.max(F.col("candidates") > 1).alias("ambiguous"))
    out = verdicts(symbols, reached).join(reached.select("node", "distance", "parent"), "node", "left").join(roots, "node", "left").join(loose, "node", "left")
    return out.select("repository", "path", "kind", "name", "line", "root", "state", "distance", "parent", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
