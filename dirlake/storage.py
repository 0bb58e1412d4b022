"""Where work that outlives a stage is kept: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one on a local master; on a cluster that is an error."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    own = spark.conf.get("dirlake.work.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="dirlake-")
        spark.conf.set("dirlake.work.dir", own)
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read back: a lineage cut that survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
