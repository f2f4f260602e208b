"""Helpers shared by the operators: scratch tables, shared files, Arrow bytes."""

from __future__ import annotations

import os
import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.session import ensure_checkpoint_dir

# Stands for a missing id while ids are compared: it sorts after every other.
NO_ID = (1 << 63) - 1


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it runs from a source tree
    (on a cluster it is installed, and this changes nothing)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of ``sf_dir``, in whatever store Spark reads it from."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return posixpath.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")


def spill(df: DataFrame, name: str, root: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back, so that
    later steps neither compute it again nor depend on any executor."""
    spark = df.sparkSession
    path = root or scratch(spark, name)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, bytes_needed, most: int = 16 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows need at most ``most`` bytes by the
    aggregate ``bytes_needed``, which is measured here; otherwise as it is, for
    Spark to join by a shuffle. Results are the same."""
    needed = df.agg(bytes_needed.alias("b")).first()["b"] or 0
    return F.broadcast(df) if needed <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store_of(path: str):
    """(pyarrow filesystem, path inside it) of a URI or a plain path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class SharedFile:
    """A file in shared storage that appears whole or not at all.

    Bytes go to a name of this attempt's own and are renamed at the end. A
    task that is run again writes another file; only the one whose row
    reaches the caller's manifest counts.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.path = posixpath.join(folder, self.name)
        self._store, inner = store_of(folder)
        self._store.create_dir(inner, recursive=True)
        self._final = posixpath.join(inner, self.name)
        self._part = self._final + ".part"
        self.stream = self._store.open_output_stream(self._part)

    def commit(self) -> str:
        self.stream.close()
        self._store.move(self._part, self._final)
        return self.path


def byte_rows(column: pa.Array, width: int) -> np.ndarray:
    """A null-free binary column whose values all have ``width`` bytes, as rows."""
    if len(column) == 0:
        return np.empty((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.reshape(len(column), width)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the slices ``starts[i] : starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
