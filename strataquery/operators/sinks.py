"""Tables put away: snapshots published whole, superseded ones removed, runs appended, exports and copies.

A snapshot is complete before it is named: its files are written under a name of their own, and one
small pointer file that is renamed into place says which is current; a reader sees the old one or the
new one, and a job that dies halfway leaves only a folder that the next clean-up takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    """The folder of the published snapshot, None before the first."""
    pointer, fs = _fs(spark, f"{root}/_current")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def publish_snapshot(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` and make it the current snapshot of ``root``; returns its folder."""
    spark = df.sparkSession
    folder = f"{root}/snapshot-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    temporary, fs = _fs(spark, f"{root}/_next-{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(folder.encode()))
    out.close()
    pointer, _ = _fs(spark, f"{root}/_current")
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, pointer, how)
    return folder


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    folder = current_snapshot(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no snapshot is published in {root}")
    return spark.read.parquet(folder)


def remove_superseded(spark: SparkSession, root: str) -> int:
    """Delete snapshots that aren't current; returns how many went."""
    keep = current_snapshot(spark, root)
    base, fs = _fs(spark, root)
    gone = 0
    for status in fs.listStatus(base):
        path = status.getPath()
        if path.getName().startswith("snapshot-") and (keep is None or path.getName() != keep.rsplit("/", 1)[-1]):
            fs.delete(path, True)
            gone += 1
    return gone


def replace_partitions(df: DataFrame, root: str, by: list[str]) -> None:
    """Overwrite only the partitions ``df`` has rows of; what a partition no longer has goes with it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)


def append_run(run: DataFrame, observations: DataFrame, root: str) -> None:
    """A run and its observations: the observations first, so a run that is there is complete; a repeated run replaces itself."""
    replace_partitions(observations, f"{root}/observations", ["run_id"])
    replace_partitions(run, f"{root}/runs", ["run_id"])


def whole_runs(spark: SparkSession, root: str) -> DataFrame:
    """Observations of runs that are recorded."""
    return spark.read.parquet(f"{root}/observations").join(spark.read.parquet(f"{root}/runs").select("run_id"), "run_id", "left_semi")


def stream_pages(results: DataFrame, order: list[str], size: int = 20, most: int = 500) -> DataFrame:
    """JSON lines of a growing answer: line k holds the first k pages of ``size``, at most ``most`` rows in all.

    The answer is bounded by ``most`` before anything is collected into a line.
    """
    top = results.orderBy(*order).limit(most)
    numbered = top.withColumn("_n", F.row_number().over(W.orderBy(*order)))  # at most ``most`` rows
    pages = numbered.agg(F.max("_n").alias("m")).select(F.explode(F.sequence(F.lit(1), F.ceil(F.col("m") / size).cast("int"))).alias("page"))
    rows = numbered.join(pages, F.col("_n") <= F.col("page") * size)  # most/size pages of at most ``most`` rows
    cols = [c for c in results.columns]
    body = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*cols).alias("r")))), lambda x: x["r"]).alias("matches"), F.max("_n").alias("_last"))
    total = numbered.agg(F.max("_n").alias("_m"))
    return body.join(total).select("page", F.to_json(F.struct("matches", (F.col("_last") == F.col("_m")).alias("complete"))).alias("line"))


def export_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """A table as CSV with a header, or as JSON lines, in as many files as it has partitions."""
    if form == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif form == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown form {form}")


def copy_tables(spark: SparkSession, read, write, names: list[str]) -> DataFrame:
    """Copy tables by name and compare their counts; ``read(name)`` gives a table, ``write(df, name)`` puts it away and gives it back.

    Both may be JDBC: ``spark.read.jdbc`` and ``df.write.jdbc``.
    """
    out = []
    for name in names:
        source = read(name)
        out.append((name, source.count(), write(source, name).count()))
    return spark.createDataFrame(out, "table_name string, source_rows long, target_rows long")
