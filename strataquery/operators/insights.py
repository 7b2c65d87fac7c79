"""Quality observations: current and past, facets, comparison, thresholds, derived metrics, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import BRANCHES, branch_points, language_of


def current_and_history(obs: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """Each identity's first row in ``order`` is current, the rest is history."""
    w = W.partitionBy(*identity).orderBy(*order)
    return obs.withColumn("place", F.when(F.row_number().over(w) == 1, "current").otherwise("history"))


def latest(obs: DataFrame, identity: list[str], order: str, tie: str, values: list[str]) -> DataFrame:
    """The last row of each identity, as a partial aggregate: one row leaves each task."""
    top = F.max(F.struct(F.col(order).alias("_o"), F.col(tie).alias("_t"), *[F.col(v) for v in values]))
    return obs.groupBy(*identity).agg(top.alias("_m")).select(*identity, *[F.col(f"_m.{v}").alias(v) for v in values])


def compare_metrics(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Full outer comparison of metric values of two revisions."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")
    state = F.when(F.col("a.value").isNull() & F.col("b.value").isNotNull(), "added").when(F.col("b.value").isNull() & F.col("a.value").isNotNull(), "removed").when(F.col("a.value") == F.col("b.value"), "same").otherwise("changed")
    return both.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key], F.col("a.value").alias("from_value"), F.col("b.value").alias("to_value"), F.round(F.col("b.value") - F.col("a.value"), 6).alias("delta"), state.alias("state"))


def introduced_resolved(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys only in ``after`` are introduced, only in ``before`` resolved."""
    came = after.select(key).distinct().join(before.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("introduced"))
    went = before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("resolved"))
    return came.unionByName(went)


def evaluate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Latest metrics against thresholds (``metric``, ``operator`` lt, lte, gt or gte, ``bound``, ``severity``).

    A threshold table is read whole, as it may differ by row; the join is an equi-join on the metric.
    """
    v, b = F.col("value"), F.col("bound")
    breached = F.when(F.col("operator") == "lt", v < b).when(F.col("operator") == "lte", v <= b).when(F.col("operator") == "gt", v > b).when(F.col("operator") == "gte", v >= b)
    return metrics.join(thresholds, "metric").withColumn("breached", F.coalesce(breached, F.lit(False)))


def file_metrics(files: DataFrame) -> DataFrame:
    """Lines, non-blank lines and branch points of every file with a known language."""
    lang = language_of(F.col("path"))
    text = F.regexp_replace(F.col("content"), "\r\n", "\n")
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    lines = F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(body, "\n", -1)))
    blank = F.size(F.filter(F.split(body, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""))
    branches = F.when(lang == "Python", branch_points(text, "Python")).when(lang == "Go", branch_points(text, "Go")).otherwise(branch_points(text, ""))
    kept = files.filter(F.col("content").isNotNull() & (lang != ""))
    known = ["file_id"] if "file_id" in files.columns else []
    out = kept.select(*known, "repository_id", "path", lang.alias("language"), lines.cast("long").alias("lines"), blank.cast("long").alias("nonblank"), branches.alias("branches"))
    # A file delivered twice counts once; its text is gone before anything is shuffled.
    return out.distinct().drop("file_id") if known else out


def metric_rollup(per_file: DataFrame) -> DataFrame:
    """The same metrics by file, by language and by repository, in one pass over grouping sets."""
    g = per_file.groupingSets([["repository_id", "language", "path"], ["repository_id", "language"], ["repository_id"]], "repository_id", "language", "path")
    level = F.when(F.grouping("path") == 0, "file").when(F.grouping("language") == 0, "language").otherwise("repository")
    return g.agg(F.sum("lines").alias("lines"), F.sum("nonblank").alias("nonblank"), F.sum("branches").alias("branches"), F.count("*").alias("files"), level.alias("level"))


def keep_newest(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """Retention: the newest ``n`` rows of every key; the plan limits each group before its shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def suffix_reconcile(reported: DataFrame, indexed: DataFrame) -> DataFrame:
    """Match reported paths to indexed ones: exactly, else by ever shorter suffixes, case apart.

    ``reported`` has repository_id and raw; ``indexed`` repository_id and path.  Each reported path is
    decoded and exploded into its suffixes (as many as it has parts), which is an equi-join on the
    repository and the folded path; the longest suffix wins, an ambiguous one is unresolved.
    """
    plain = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("raw", r"\+", "%2B")), r"\\", "/"), r"^(?:file://)?/*(?:\./)*", "")
    parts = F.split(plain, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct((n - 1).alias("cut"), F.lower(F.array_join(F.slice(parts, n, F.size(parts)), "/")).alias("tail")))
    wanted = reported.select("repository_id", "raw").distinct().withColumn("t", F.explode(tails)).select("repository_id", "raw", "t.cut", "t.tail")
    have = indexed.select("repository_id", F.lower("path").alias("tail"), "path").distinct()
    hits = wanted.join(have, ["repository_id", "tail"]).groupBy("repository_id", "raw", "cut").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    best = hits.groupBy("repository_id", "raw").agg(F.min(F.struct("cut", "n", "path")).alias("b"))
    return reported.select("repository_id", "raw").distinct().join(best, ["repository_id", "raw"], "left").select("repository_id", "raw", F.when(F.col("b.n") == 1, F.col("b.path")).alias("path"), F.when(F.col("b.n") == 1, F.when(F.col("b.cut") == 0, "exact").otherwise("suffix")).otherwise("unresolved").alias("state"))


def quarantine(observations: DataFrame, repositories: DataFrame, indexed: DataFrame) -> DataFrame:
    """``verdict`` of imported rows: measured, or why they can't be placed.

    ``observations``: repository_id, revision, path; ``repositories``: repository_id, indexed_commit;
    ``indexed``: repository_id and path of the files known.  A row of another revision than the indexed
    one is quarantined whole; a path the index doesn't have leaves its row unresolved.
    """
    known = indexed.select("repository_id", "path").distinct().withColumn("_known", F.lit(True))
    j = observations.join(repositories, "repository_id", "left").join(known, ["repository_id", "path"], "left")
    placed = F.when(F.coalesce("path", F.lit("")) == "", "measured").when(F.col("_known"), "measured").otherwise("unresolved_path")
    verdict = F.when(F.col("indexed_commit").isNull(), "unknown_repository").when(F.coalesce("revision", F.lit("")) != F.col("indexed_commit"), "quarantined").otherwise(placed)
    return j.withColumn("verdict", verdict).drop("_known", "indexed_commit")
