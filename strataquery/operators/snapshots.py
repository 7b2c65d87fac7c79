"""What changed between consecutive full snapshots of a table.

Plan: snapshots are numbered once in (series, order) sequence, so that consecutive snapshots of
a series carry consecutive numbers.  Each key of a snapshot is one slim row (series, key,
number, 64-bit content hash).  A window over (series, key) - fine-grained, so a hot series is
spread over its keys - lags number and hash: a gap before a row is an addition, a gap after it
a removal in the snapshot that follows, and two neighbouring rows with unequal hashes a change.
Equality is only asked of neighbours, hence a 64-bit hash suffices at any size.

Defined results: the first snapshot of a series gives no rows; an empty snapshot removes every
key; a key that returns is added again; repeated rows of one key in one snapshot count once (the
one with the greatest ``pick`` value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import Scratch, table
from .ordering import ordered_index


def number_snapshots(snaps: DataFrame, series: list[str], order: list[str], snapshot_id: str, scratch: Scratch, name: str) -> DataFrame:
    """Add ``idx`` (global, consecutive within a series), ``is_first``, ``next_id``.

    ``snaps`` has one row for each snapshot.  The series' neighbours are found by joining the
    numbers with themselves shifted by one: unique keys, so no series can skew the join.
    """
    numbered = ordered_index(snaps, [*series, *order], scratch, name)
    tag = F.xxhash64(*series)
    me = numbered.withColumn("_tag", tag)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in series]
    cond = (F.col("a.idx") + 1 == F.col("b.idx")) & _all(same)
    after = me.alias("a").join(me.select("idx", *series, F.col(snapshot_id).alias("_id")).alias("b"), cond, "left").select("a.*", F.col("b._id").alias("next_id"))
    prev = me.select((F.col("idx") + 1).alias("idx"), *[F.col(c).alias(f"_s_{c}") for c in series], F.lit(False).alias("_not_first"))
    cond2 = (F.col("c.idx") == F.col("d.idx")) & _all([F.col(f"c.{c}").eqNullSafe(F.col(f"d._s_{c}")) for c in series])
    return after.alias("c").join(prev.alias("d"), cond2, "left").select("c.*", F.col("d._not_first").isNull().alias("is_first")).drop("_tag")


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def snapshot_changes(members: DataFrame, key: str, content: Column | None, pick: Column | None) -> DataFrame:
    """Changes of ``members``: rows (``sid`` series, ``idx``, ``is_first``, ``snapshot_id``, ``next_id``, key).

    Returns ``snapshot_id, record_key, change``.
    """
    rows = members.select("sid", "idx", "is_first", "snapshot_id", "next_id", F.col(key).alias("record_key"), (content if content is not None else F.lit(0)).cast("long").alias("h"), (pick if pick is not None else F.lit(0)).cast("long").alias("pick"))
    w = W.partitionBy("sid", "record_key").orderBy("idx", "pick")
    last = rows.withColumn("_follow", F.lead("idx").over(w)).filter(F.col("_follow").isNull() | (F.col("_follow") != F.col("idx")))
    seen = last.withColumn("_pi", F.lag("idx").over(w)).withColumn("_ph", F.lag("h").over(w)).withColumn("_ni", F.lead("idx").over(w))
    here = F.coalesce(F.col("_pi") == F.col("idx") - 1, F.lit(False))
    gone = F.coalesce(F.col("_ni") != F.col("idx") + 1, F.lit(True)) & F.col("next_id").isNotNull()
    events = F.array(
        F.when(~here & ~F.col("is_first"), F.struct(F.col("snapshot_id").alias("snapshot_id"), F.lit("added").alias("change"))).when(here & (F.col("_ph") != F.col("h")), F.struct(F.col("snapshot_id").alias("snapshot_id"), F.lit("changed").alias("change"))),
        F.when(gone, F.struct(F.col("next_id").alias("snapshot_id"), F.lit("removed").alias("change"))),
    )
    return seen.select("record_key", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.snapshot_id", "record_key", "e.change")


def monitor_changes(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """Added and removed keys of the runs of each monitor."""
    text = F.col("result_keys_json")
    good = runs.filter(F.col("status") == "complete").select("id", "monitor_id", "created_at", F.when(text.rlike(r"^\s*\[") & text.rlike(r"\]\s*$"), F.from_json(text, "array<string>")).alias("keys")).filter(F.col("keys").isNotNull())
    # One row for each run; a run delivered twice has equal keys, its copies merge below.
    snaps = good.select("monitor_id", "created_at", "id").distinct()
    numbered = number_snapshots(snaps, ["monitor_id"], ["created_at", "id"], "id", scratch, "runs")
    members = (
        good.join(numbered, ["monitor_id", "created_at", "id"])
        .select(F.col("monitor_id").alias("sid"), "idx", "is_first", F.col("id").cast("string").alias("snapshot_id"), F.col("next_id").cast("string").alias("next_id"), F.explode(F.array_distinct("keys")).alias("k"))
        .filter(F.col("k").isNotNull())
    )
    return snapshot_changes(members, "k", None, None).select(F.lit("monitor_runs").alias("table_name"), "snapshot_id", "record_key", "change")


def finding_changes(observations: DataFrame, scratch: Scratch) -> DataFrame:
    """Introduced, resolved and changed findings of the runs of each repository, tool and branch."""
    state = F.coalesce(F.col("state"), F.lit(""))
    rows = observations.filter((F.col("kind") == "finding") & (F.col("suppressed") == F.lit(False)) & (state != "quarantined"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fingerprint = F.regexp_replace(blank("fingerprint"), r"(?U)^\s+|\s+$", "")
    found = rows.select(
        "repository_id", "tool", "branch", "run_id", "observed_at", "id",
        F.when(fingerprint != "", fingerprint).otherwise(F.concat_ws("|", blank("key"), blank("path"), blank("start_line"), blank("message"))).alias("k"),
        F.xxhash64(F.lower(blank("severity")), blank("message"), blank("path"), blank("start_line")).alias("h"),
    )
    # A run has one time: the earliest of its rows, should they ever differ.
    snaps = found.groupBy("repository_id", "tool", "branch", "run_id").agg(F.min("observed_at").alias("at"))
    numbered = number_snapshots(snaps, ["repository_id", "tool", "branch"], ["at", "run_id"], "run_id", scratch, "findings")
    series = ["repository_id", "tool", "branch"]
    cond = (F.col("f.run_id") == F.col("n.run_id")) & _all([F.col(f"f.{c}").eqNullSafe(F.col(f"n.{c}")) for c in series])
    members = found.alias("f").join(numbered.alias("n"), cond).select(
        F.struct(*[F.col(f"f.{c}") for c in series]).alias("sid"), "n.idx", "n.is_first", F.col("f.run_id").alias("snapshot_id"), "n.next_id", "f.k", "f.h", "f.id"
    )
    return snapshot_changes(members, "k", F.col("h"), F.col("id")).select(F.lit("insight_observations").alias("table_name"), "snapshot_id", "record_key", "change")


def p2_found(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "snapshots")
    return monitor_changes(table(spark, sf_dir, "monitor_runs"), scratch).unionByName(finding_changes(table(spark, sf_dir, "insight_observations"), scratch))
