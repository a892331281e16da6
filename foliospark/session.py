"""Session helpers shared by operators and queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; columns and filters chosen later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in spark.checkpoint.dir. Only a session on one machine,
    as in tests, may do without: it gets a temporary folder. Elsewhere a folder
    of one machine would be written in pieces and read back empty, so its
    absence is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        conf = tempfile.mkdtemp(prefix="foliospark-")
        forget_at_exit(spark, conf)
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the session's JVM ends: results are lazy and may be read until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of the session."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    forget_at_exit(spark, path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, where several later steps use it."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
