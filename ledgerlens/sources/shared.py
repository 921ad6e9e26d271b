"""Cuts of a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session on one machine may leave it unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerlens-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder, which a lost executor doesn't touch."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def filesystem(spark: SparkSession, place: str):
    """Hadoop's file system of a place, and the place as its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def put_whole(df: DataFrame, target: str, kind: str = "parquet") -> bool:
    """Write df aside and rename it to target as a whole; false if target is there already, then nothing changes."""
    spark, (parent, _, name) = df.sparkSession, target.rpartition("/")
    fs, path = filesystem(spark, target)
    if fs.exists(path):
        return False
    aside = f"{parent}/_writing-{name}-{uuid.uuid4().hex}"
    df.write.format(kind).save(aside)
    fs.mkdirs(filesystem(spark, parent)[1])
    if fs.rename(filesystem(spark, aside)[1], path):
        return True
    if not fs.exists(path):
        raise OSError(f"{aside} could not be moved to {target}")
    fs.delete(filesystem(spark, aside)[1], True)
    return False
