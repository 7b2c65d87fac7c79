"""Session-level helpers: table access and the shared scratch area.

Everything an operator cuts its lineage with is written below the folder that the session
names in ``spark.checkpoint.dir`` - a folder all executors share, so a lost executor costs a
re-read and never the job.  Only where the setting is absent and all executors are threads of
this machine (tests, notebooks) a private folder is made up; a cluster without a shared folder is an
error, as its executors would write to disks that the others can't read.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    global _OWN_DIR
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="strataquery-")
        atexit.register(shutil.rmtree, _OWN_DIR, True)
    return f"file://{_OWN_DIR}"


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where a scan has fewer partitions than there are cores, else leave them.

    For maps that cost far more CPU than a row's transport; large inputs never shuffle here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is the cluster's to sweep
        pass


class Scratch:
    """Tables written to the shared folder and read back: exact sizes, no lineage.

    ``save`` is the engine's only way to cut lineage.  ``drop`` removes a table as soon as no
    later step reads it; what a returned (lazy) DataFrame still reads goes at session end.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strataquery-{label}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
