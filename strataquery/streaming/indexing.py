"""Repositories indexed as their heads move: a stream of head changes, a queue of derived work, states.

States go pending, indexing, ready or error.  A change of the head makes a repository pending again; a
finished job counts only if it was for the head that is still wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Scratch

HEADS = "repository_id long, head string, seen_at timestamp"


def next_states(repositories: DataFrame, results: DataFrame) -> DataFrame:
    """Repositories (``repository_id, head, indexed, state``) after the results of jobs (``repository_id, head, ok``).

    A result for an older head leaves the repository pending; of several results for the wanted head a
    success wins.
    """
    mine = results.groupBy("repository_id", "head").agg(F.max("ok").alias("ok"))
    j = repositories.join(mine, ["repository_id", "head"], "left")
    state = F.when(F.col("ok"), "ready").when(~F.col("ok"), "error").when(F.coalesce("indexed", F.lit("")) == F.col("head"), "ready").otherwise("pending")
    return j.select("repository_id", "head", F.when(F.col("ok"), F.col("head")).otherwise(F.col("indexed")).alias("indexed"), state.alias("state"))


def queue_jobs(jobs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Derived work (``repository_id, head, artifact``), each once and none that is done."""
    once = jobs.dropDuplicates(["repository_id", "head", "artifact"])
    return once if done is None else once.join(done, ["repository_id", "head", "artifact"], "left_anti")


def watch_heads(spark: SparkSession, source: str, target: str, checkpoint: str, index, artifacts: list[str], quiet: str = "now", files_per_batch: int = 1000) -> None:
    """Work off the head changes in ``source``: the last head of each repository in a batch counts.

    ``index(df)`` gets ``repository_id, head`` and gives ``repository_id, head, ok``.  State and queue are
    tables of an epoch, so a repeated batch overwrites itself.
    """
    stream = spark.readStream.schema(HEADS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    scratch = Scratch(spark, "heads")

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy("repository_id").agg(F.max(F.struct("seen_at", "head")).alias("m")).select("repository_id", F.col("m.head").alias("head"))
        before = spark.read.parquet(f"{target}/state/epoch={epoch - 1}") if epoch else spark.createDataFrame([], "repository_id long, head string, indexed string, state string")
        known = before.join(last, "repository_id", "left_anti").unionByName(last.join(before.select("repository_id", "indexed"), "repository_id", "left").select("repository_id", "head", "indexed", F.lit("pending").alias("state")))
        known = scratch.save(known, f"known{epoch}")
        results = scratch.save(index(known.filter(F.coalesce("indexed", F.lit("")) != F.col("head")).select("repository_id", "head")), f"results{epoch}")
        next_states(known, results).write.mode("overwrite").parquet(f"{target}/state/epoch={epoch}")
        jobs = results.filter("ok").select("repository_id", "head", F.explode(F.array(*[F.lit(a) for a in artifacts])).alias("artifact"))
        queue_jobs(jobs).write.mode("overwrite").parquet(f"{target}/queue/epoch={epoch}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    (query.trigger(availableNow=True) if quiet == "now" else query.trigger(processingTime=quiet)).start().awaitTermination()
