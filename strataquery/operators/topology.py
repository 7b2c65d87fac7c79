"""Services and their connections: static and observed evidence merged, names resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import service_name


def merge_runtime(obs: DataFrame, key: list[str]) -> DataFrame:
    """Observations of one connection: sums of counts, the worst latency, the span seen."""
    one = lambda c: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise("multiple")
    return obs.groupBy(*key).agg(
        F.coalesce(F.sum("request_count"), F.lit(0)).alias("requests"), F.coalesce(F.sum("error_count"), F.lit(0)).alias("errors"), F.max("latency_p95_ms").alias("p95_ms"),
        F.min("observed_from").alias("first_seen"), F.max("observed_to").alias("last_seen"), one("provider").alias("provider"), one("environment").alias("environment"),
    ).withColumn("error_rate", F.when(F.col("requests") > 0, F.round(F.col("errors") / F.col("requests"), 9)))


def merge_static_runtime(static: DataFrame, runtime: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge on a key that ends with environment; a second chance without one.

    States: confirmed (both), static_only, runtime_only.  A runtime row that finds no static row of its
    environment takes the static row without environment, if there is one.
    """
    plain = [k for k in key if k != "environment"]
    marked = static.select(*key, F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(runtime.select(*key, F.lit(0).alias("s"), F.lit(1).alias("r")))
    per = marked.groupBy(*key).agg(F.max("s").alias("s"), F.max("r").alias("r"))
    # The environments of one connection are few, so a window over it is small whatever the data.
    w = W.partitionBy(*plain)
    lone = (F.col("r") == 1) & (F.col("s") == 0)
    seen = per.withColumn("loose", F.max(F.when((F.col("s") == 1) & (F.col("environment") == ""), 1).otherwise(0)).over(w)).withColumn("wanted", F.max(F.when(lone, 1).otherwise(0)).over(w))
    taken = (F.col("r") == 0) & (F.col("environment") == "") & (F.col("wanted") == 1)
    state = F.when(lone & (F.col("loose") == 0), "runtime_only").when(F.col("r") == 1, "confirmed").otherwise("static_only")
    env = F.when(lone, F.when(F.col("loose") == 1, "")).otherwise(F.col("environment"))
    return seen.filter(~taken).select(*key, state.alias("state"), env.alias("static_environment"))


def unique_aliases(names: DataFrame, components: DataFrame) -> DataFrame:
    """Names resolved to the one component that has the alias; ambiguous ones stay open.

    ``components`` has id and aliases; ``names`` has name.
    """
    known = components.select("id", F.explode("aliases").alias("a")).select("id", service_name(F.col("a")).alias("alias")).filter("alias <> ''").groupBy("alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    own = names.withColumn("alias", service_name(F.col("name")))
    return own.join(known, "alias", "left").select("name", "alias", F.when(F.col("n") == 1, F.col("id")).alias("component_id"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unknown").alias("resolution"))


def top_ranked(rows: DataFrame, key: list[str], rank: str) -> DataFrame:
    """All rows of the best rank of each key, ties kept: a partial maximum and a semi join."""
    best = rows.groupBy(*key).agg(F.max(rank).alias(rank))
    return rows.join(best, [*key, rank], "left_semi")


def cap_neighbours(edges: DataFrame, node: str, order: list[Column], most: int, weight: str) -> DataFrame:
    """The ``most`` useful edges of a node, and one row that sums up the rest.

    Only the top rows are ranked: the window filter becomes a group limit before the shuffle; the
    remainder is the difference of two aggregates, so a hub is never sorted whole in one task.
    """
    top = edges.withColumn("_n", F.row_number().over(W.partitionBy(node).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
    all_ = edges.groupBy(node).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    shown = top.groupBy(node).agg(F.count("*").alias("n2"), F.sum(weight).alias("w2"))
    rest = all_.join(shown, node).filter("n > n2").select(node, F.lit(None).cast(edges.schema["neighbour"].dataType).alias("neighbour"), (F.col("w") - F.col("w2")).alias(weight), (F.col("n") - F.col("n2")).alias("summarised"))
    return top.select(node, "neighbour", weight, F.lit(0).cast("long").alias("summarised")).unionByName(rest)


def overlapping(obs: DataFrame, low: str, high: str) -> DataFrame:
    """Observations whose window meets [low, high]; plain comparisons, so they reach the scan."""
    return obs.filter((F.col("observed_from") <= F.lit(high).cast("timestamp_ntz")) & (F.col("observed_to") >= F.lit(low).cast("timestamp_ntz")))


def longest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The components whose root is the longest prefix of a file's path; ties kept.

    A path is exploded into its ancestors and equi-joined with the roots.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("root")))
    above = files.select("repository_id", "path", F.explode(ups).alias("u")).select("repository_id", "path", "u.depth", "u.root")
    return top_ranked(above.join(roots, ["repository_id", "root"]), ["repository_id", "path"], "depth")


def import_verdicts(obs: DataFrame, most_days: int = 31) -> DataFrame:
    """``verdict`` of runtime observations: accepted, or the first reason to refuse them."""
    none = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    lo, hi = F.col("observed_from"), F.col("observed_to")
    counts = (F.coalesce("request_count", F.lit(0)) < 0) | (F.coalesce("error_count", F.lit(0)) > F.coalesce("request_count", F.lit(0)))
    return obs.withColumn("verdict", F.when(none("source_name"), "no source").when(none("target_name"), "no target").when(lo.isNull() | hi.isNull(), "no window").when(lo > hi, "window ends first").when(hi > lo + F.expr(f"INTERVAL {most_days} DAYS"), "window too long").when(counts, "bad counts").otherwise("accepted"))


def assemble(components: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connections whose both ends are components, and components without the external ones that none of them touches.

    ``components``: id, external; ``connections``: source, target.
    """
    ids = components.select("id")
    kept = connections.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    touched = kept.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_t", F.lit(True))
    return kept, components.join(touched, "id", "left").filter(F.col("_t") | ~F.col("external")).drop("_t")


def neighborhood(connections: DataFrame, focus: DataFrame) -> DataFrame:
    """``id, role`` of callers and callees of ``focus`` (``id``), and of what else these touch (context).

    ``connections``: distinct source and target, no loops.
    """
    me = focus.select("id").distinct()
    out = connections.join(me.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"), F.lit("callee").alias("role"))
    into = connections.join(me.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"), F.lit("caller").alias("role"))
    near = out.unionByName(into)
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"))))
    around = connections.select(ends.alias("e")).select("e.id", "e.other").join(near.select("id").distinct(), "id", "left_semi").select(F.col("other").alias("id")).distinct()
    return near.unionByName(around.join(near, "id", "left_anti").join(me, "id", "left_anti").withColumn("role", F.lit("context")))


def summary(components: DataFrame, connections: DataFrame) -> DataFrame:
    """One row of counts over components (``id``, ``kind``, ``candidate``) and connections (``target``, ``state``, ``resolved``)."""
    c = components.agg(F.count("*").alias("components"), F.count_if(F.col("kind") == "service").alias("services"), F.count_if(F.col("kind") != "service").alias("resources"))
    known = components.select(F.col("id").alias("target"), F.coalesce("candidate", F.lit(False)).alias("_candidate"))
    j = connections.join(known, "target", "left")
    candidate = F.coalesce(F.col("_candidate"), F.lit(False))
    loose = ~candidate & F.startswith("target", F.lit("runtime:")) & ~F.col("resolved")
    n = j.agg(
        F.count("*").alias("connections"), *[F.count_if(F.col("state") == s).alias(s) for s in ("confirmed", "runtime_only", "static_only")],
        F.count_if(candidate).alias("candidates"), F.count_if(loose).alias("unresolved"), F.count_if(~candidate & ~loose).alias("resolved"), F.count_distinct("protocol").alias("protocols"),
    )
    return c.join(n)  # one row each


def connection_predicate(protocol: str = "", origin: str = "", environment: str = "", text: str = "") -> Column:
    """Filters of connections; ``origin`` is static, runtime or confirmed, ``text`` stands anywhere in what a connection shows."""
    same = lambda c, v: F.lower(F.coalesce(F.col(c), F.lit(""))) == v.lower() if v else F.lit(True)
    if origin not in ("", "static", "runtime", "confirmed"):
        raise ValueError(f"unknown origin {origin}")
    by_origin = {"": F.lit(True), "static": F.col("state") != "runtime_only", "runtime": F.col("state") != "static_only", "confirmed": F.col("state") == "confirmed"}[origin]
    shown = F.lower(F.concat_ws(" ", "source", "target", "protocol", "state", "environment"))
    return same("protocol", protocol) & by_origin & same("environment", environment) & (F.contains(shown, F.lit(text.strip().lower())) if text.strip() else F.lit(True))
