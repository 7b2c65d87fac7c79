"""Table maintenance without a merge statement: upserts, pages, access, closure of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import Scratch
from .ordering import ordered_index


def visible(rows: DataFrame, grants: DataFrame, key: str = "repository_id") -> DataFrame:
    """Rows of the granted repositories; no grants, no rows."""
    return rows.join(grants.select(key).distinct(), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old rows replaced by the newest delivered row of their key, new keys added.

    The last row of a key is a partial maximum; the merged table is written elsewhere and swapped in.
    """
    cols = [c for c in old.columns if c not in key]
    last = new.groupBy(*key).agg(F.max(F.struct(F.col(order).alias("_o"), *cols)).alias("n")).select(*key, *[F.col(f"n.{c}").alias(c) for c in cols])
    return old.join(last, key, "left_anti").unionByName(last)


def sync_catalogue(known: DataFrame, found: DataFrame, misses: int = 3) -> DataFrame:
    """Discovered repositories merged into the catalogue; what was missed ``misses`` times goes.

    Both have path and head; ``known`` also discovery_misses and state.
    """
    a, b = known.alias("a"), found.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    seen, was = F.col("b.path").isNotNull(), F.col("a.path").isNotNull()
    missed = F.when(seen, 0).otherwise(F.coalesce("a.discovery_misses", F.lit(0)) + 1)
    state = F.when(seen & was & (F.col("a.head") == F.col("b.head")), F.col("a.state")).when(seen, "pending").otherwise(F.col("a.state"))
    return both.select(F.coalesce("b.path", "a.path").alias("path"), F.coalesce("b.head", "a.head").alias("head"), missed.cast("int").alias("discovery_misses"), state.alias("state")).filter(F.col("discovery_misses") < misses)


def keyset_page(rows: DataFrame, key: str, before: int | None, limit: int) -> DataFrame:
    """One page, newest first, with a row more than shown to tell whether there is a next one."""
    page = rows if before is None else rows.filter(F.col(key) < before)
    return page.orderBy(F.col(key).desc()).limit(limit + 1)


def offset_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def bounded_by_size(rows: DataFrame, group: list[str], order: list[Column], size: Column, most: int) -> DataFrame:
    """The leading rows of each group whose sizes add up to ``most`` at the utmost, with a flag on what is cut."""
    total = F.sum(size).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_sum", total).withColumn("truncated", F.col("_sum") > most).drop("_sum")


def greedy_budget(rows: DataFrame, group: str, order: list[str], size: str, most_size: int, most_rows: int, scratch: Scratch) -> DataFrame:
    """Rows taken in order while a group's budget lasts; one too large is skipped and the next tried.

    What is taken depends on what was skipped, but no group is folded in one task: rows are numbered once
    over all groups; a round takes every row up to the first that overflows, by running sums over blocks
    of a thousand numbers and over the blocks, and the rows behind it that are no larger than what is left
    go on.  A row that has been too large once stays too large, so nothing is asked twice.  Null sizes
    count as 0.  Gives the rows taken, with ``used`` before each.
    """
    cols = rows.columns
    slim = rows.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0))).filter(F.col("_size") <= most_size)
    left = scratch.save(ordered_index(slim, [group, *order], scratch, "budget").withColumn("_used", F.lit(0).cast("long")).withColumn("_taken", F.lit(0).cast("long")), "left0")
    out, turn = None, 0
    while not left.isEmpty():
        block = left.withColumn("_b", F.floor(F.col("idx") / 1000))
        inner = W.partitionBy(group, "_b").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
        per = block.groupBy(group, "_b").agg(F.sum("_size").alias("_s"), F.count("*").alias("_c"))
        outer = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        before = per.select(group, "_b", F.coalesce(F.sum("_s").over(outer), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_c").over(outer), F.lit(0)).alias("_c0"))
        run = block.withColumn("_s", F.sum("_size").over(inner)).withColumn("_c", F.count("*").over(inner)).join(before, [group, "_b"])
        run = run.withColumn("_sum", F.col("_s") + F.col("_s0") + F.col("_used")).withColumn("_nth", F.col("_c") + F.col("_c0") + F.col("_taken"))
        run = scratch.save(run.withColumn("_fits", (F.col("_sum") <= most_size) & (F.col("_nth") <= most_rows)).drop("_b", "_s", "_c", "_s0", "_c0"), f"run{turn}")
        good = run.filter("_fits").select(*cols, group, (F.col("_sum") - F.col("_size")).alias("used")) if group not in cols else run.filter("_fits").select(*cols, (F.col("_sum") - F.col("_size")).alias("used"))
        out = good if out is None else out.unionByName(good)
        spent = run.groupBy(group).agg(F.max(F.when(F.col("_fits"), F.col("_sum"))).alias("_u"), F.max(F.when(F.col("_fits"), F.col("_nth"))).alias("_t"), F.max("_used").alias("_u0"), F.max("_taken").alias("_t0"))
        spent = spent.select(group, F.coalesce("_u", "_u0").alias("_used"), F.coalesce("_t", "_t0").alias("_taken"))
        turn += 1
        rest = run.filter("not _fits").drop("_used", "_taken", "_sum", "_nth", "_fits").join(spent, group).filter((F.col("_size") <= most_size - F.col("_used")) & (F.col("_taken") < most_rows))
        left = scratch.save(rest, f"left{turn}")
    return slim.select(*cols, F.lit(0).cast("long").alias("used")).limit(0) if out is None else out


def ancestors(commits: DataFrame, heads: DataFrame, scratch: Scratch) -> DataFrame:
    """Every commit reachable over ``parents`` (``revision``, ``parents``), heads included."""
    from .graph import reachable

    edges = commits.select(F.col("revision").alias("src"), F.explode("parents").alias("dst")).withColumn("id", F.concat("src", F.lit(">"), "dst"))
    return reachable(edges, heads, scratch).select(F.col("node").alias("revision"), "distance")
