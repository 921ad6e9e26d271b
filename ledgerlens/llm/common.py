"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session that runs on one machine may leave it unset and gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerlens-"))
    return named or sc.getCheckpointDir()


def put_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file into the shared folder, unless it is there, and return its place."""
    base = shared_dir(spark)
    fs, root = FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (LocalFileSystem(), base)
    if fs.get_file_info(f"{root}/{name}").type == FileType.NotFound:
        fs.create_dir(root)
        with fs.open_output_stream(at := f"{root}/{name}-{uuid.uuid4().hex}") as out:
            out.write(data)
        fs.move(at, f"{root}/{name}")
    return f"{base}/{name}"


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever its case: name, with underscores after it if need be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most_bytes of one text column, so that numpy work on a piece stays small."""
    sizes = np.fromiter((len(x) if x else 0 for x in utf8(batch.column(column))), np.int64, batch.num_rows)
    block = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Tables:
    """Tables in the shared folder that one operator's steps leave for the next ones.

    A lost executor costs no step that has ended in a table, and the step's shuffle files go at once. Each table is
    dropped by its name after its last reader; those that a returned DataFrame reads stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, name: str, df: DataFrame, level: int = 3) -> DataFrame:
        """df, written and read again. level: of compression."""
        self.paths[name] = path = f"{shared_dir(self.spark)}/table-{name}-{uuid.uuid4().hex}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, level: int = 3) -> DataFrame:
    """df as a table that stays."""
    return Tables(df.sparkSession).store("kept", df, level)
