"""Equi-joins that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is heavy when it has more than this share of the rows; so there are at most SHARE heavy keys.
SHARE = 256
#: Below this many rows no key can hurt a task.
LEAST_ROWS = 200_000


def salted(rows: DataFrame, key: str, spread: str, total: int, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Add ``_salt`` to ``rows``: 0, or for heavy keys a number that spreads them.

    ``counts`` (key, ``n``) spares the pass that counts the keys, where they are counted already.
    Returns the rows and the heavy keys with their fan-out.  The heavy keys are at most SHARE
    rows whatever the data, as each has over total/SHARE rows; that bound is why they may be
    broadcast.
    """
    if total < LEAST_ROWS:
        return rows.withColumn("_salt", F.lit(0)), None
    piece = max(total // SHARE, 1)
    per = rows.groupBy(key).agg(F.count("*").alias("_n")) if counts is None else counts.select(key, F.col("n").alias("_n"))
    heavy = per.filter(F.col("_n") > piece).select(key, F.ceil(F.col("_n") / F.lit(piece)).cast("int").alias("_fan"))
    out = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_fan")).cast("int"), F.lit(0))).drop("_fan")
    return out, heavy


def replicated(side: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """The other side of a salted join: one copy of a heavy key for each of its salts."""
    if heavy is None:
        return side.withColumn("_salt", F.lit(0))
    fan = F.coalesce(F.col("_fan"), F.lit(1))
    return side.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan")
