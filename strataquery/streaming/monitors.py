"""Saved searches re-run on change, as streams.

A monitor's runs arrive as files; each micro-batch compares every run with the one before it and
appends what came and went.  The last run of every monitor is state, kept as a table in the shared
folder and replaced with each batch, so a restarted query goes on where the checkpoint says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordering import ordered_index
from ..session import Scratch

SCHEMA = "id long, monitor_id string, scope string, keys array<string>, status string, created_at timestamp"


def deltas(runs: DataFrame, previous: DataFrame | None, scratch: Scratch, label: str = "runs") -> tuple[DataFrame, DataFrame]:
    """Changes of every complete run against its predecessor, and the new state.

    A run of another scope can't be compared: its changes are empty and it is flagged.  Runs are numbered
    without their keys, so a busy monitor needs no task of its own; the keys of a run and of the one
    before meet in a join on unique numbers.
    """
    fine = runs.filter("status = 'complete'").select("monitor_id", "created_at", "id", "scope", "keys")
    rows = fine if previous is None else fine.unionByName(previous.select(fine.columns))
    numbered = scratch.save(ordered_index(rows.select("monitor_id", "created_at", "id").distinct(), ["monitor_id", "created_at", "id"], scratch, f"{label}-numbers"), f"{label}-numbered")
    told = scratch.save(rows.dropDuplicates(["monitor_id", "created_at", "id"]).join(numbered, ["monitor_id", "created_at", "id"]), f"{label}-told")
    before = told.select((F.col("idx") + 1).alias("idx"), "monitor_id", F.col("keys").alias("_k"), F.col("scope").alias("_s"))
    pair = told.join(before, ["idx", "monitor_id"])
    same = F.coalesce(F.col("_s") == F.col("scope"), F.lit(False))
    empty = F.array().cast("array<string>")
    out = pair.select("monitor_id", "id", F.when(same, F.array_sort(F.array_except("keys", "_k"))).otherwise(empty).alias("added"), F.when(same, F.array_sort(F.array_except("_k", "keys"))).otherwise(empty).alias("removed"), F.when(same, "complete").otherwise("incomplete").alias("state"))
    last = numbered.groupBy("monitor_id").agg(F.max("idx").alias("idx"))
    return out, told.join(last, ["monitor_id", "idx"], "left_semi").select(fine.columns)


def run_monitors(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Work off all files of ``source`` and stop; call again for later ones."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    scratch = Scratch(spark, "monitors")

    def state_path(epoch: int) -> str:
        return f"{target}/state/epoch={epoch}"

    def batch(df: DataFrame, epoch: int) -> None:
        previous = spark.read.parquet(state_path(epoch - 1)) if epoch else None
        changes, state = deltas(df, previous, scratch, f"epoch{epoch}")
        if previous is not None:  # monitors without a run in this batch keep their state
            state = state.unionByName(previous.join(state.select("monitor_id"), "monitor_id", "left_anti").select(state.columns))
        # Paths carry the epoch, so a batch that is repeated after a failure overwrites itself.
        changes.write.mode("overwrite").parquet(f"{target}/changes/epoch={epoch}")
        state.write.mode("overwrite").parquet(state_path(epoch))

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_requests(stream: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """An extension: requests and errors by connection and window, late rows up to a watermark."""
    return stream.withWatermark("observed_from", late).groupBy(F.window("observed_from", width), "source_name", "target_name").agg(F.sum("request_count").alias("requests"), F.sum("error_count").alias("errors"))


def first_deliveries(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each row once within the watermark, whatever is delivered twice."""
    return stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
