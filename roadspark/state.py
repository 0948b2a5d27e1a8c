"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; on a local master a temporary folder stands in for one that is not set."""
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the cluster has to name a shared folder")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="roadspark-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for files in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, far smaller than a checkpoint of many rows; it goes when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, cut, to be broadcast if it has no more rows than that."""
    own = cut(df)
    return F.broadcast(own) if own.count() <= most else own
