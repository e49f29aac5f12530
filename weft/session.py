"""Shared storage: where a plan is cut and intermediate tables live.

A cluster names one folder that the driver and every executor can reach in
``spark.checkpoint.dir``. Intermediate tables are written there as Parquet, so a
lost executor costs only a re-read. Without that setting a local session (tests, one machine)
gets a temporary folder, made once per application; on a cluster it is an error, since
executors do not see each other's folders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; never a machine-local one if the cluster names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.weft.local.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.weft.local.dir", own)
    return own


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_weft_path", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, for rows that an explode or a map over batches multiplied.

    Spark sizes them as the rows they were made of, and Parquet that repeats values by its small files, so
    it would send tables of many times its limit through the driver.
    """
    return df.hint("merge")
