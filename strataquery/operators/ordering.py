"""Skew-proof ordering: neighbours and ranks within groups without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import Scratch


def ordered_index(df: DataFrame, order: list[str], scratch: Scratch, name: str, out: str = "idx") -> DataFrame:
    """Number rows 1..n in the total order of ``order`` (ascending, nulls first).

    A window would need one task for each group - or one for all rows.  Here the rows are
    range-partitioned on the whole order key, so a group holding a third of all rows spreads
    over a third of the partitions; each row's number is its place in its partition plus the
    sizes of the partitions before it, and those sizes - one row for a partition - are all
    that is brought together.  ``order`` must be a total order for a reproducible answer.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_w", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    kept = scratch.save(placed, name)
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row for each partition, so one running sum: bounded by the partition count, whatever the data.
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + F.col("_w") + 1).drop("_p", "_w", "_before")
