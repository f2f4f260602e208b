"""Refreshable summary snapshots.

The dashboard kept each summary's result for an hour per (query,
arguments) and let the user force a refresh. Here that becomes a
*snapshot store*: a summary is written once as parquet, and later requests
read it back as long as it is younger than ``max_age_seconds``.

* A snapshot belongs to a name, a source and arguments. The folder is the
  name and a hash of the canonical JSON of all three, so no two of them
  share a path and no text can leave the root.
* Every build is a folder of its own, ``build-<epoch ms>-<unique id>``, and
  counts once it holds the marker file that is written after its data. A
  build that failed half-way has none and is never read; two writers never
  share a folder.
* A lookup lists the build folders of one snapshot. After a build only the
  ``keep`` newest complete ones stay, so the list stays short; unfinished
  ones go when they are a day old.
* The default root is a folder under the session's ``spark.checkpoint.dir``
  — shared storage on a cluster — so snapshots survive the loss of any
  executor and are visible to every driver using the same store.

The row order of a sorted summary is kept in a ``_position`` column and
restored on read.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.session import checkpoint_dir

# How long a summary is reused before it is rebuilt, how many complete builds
# stay, and after how long an unfinished one is taken for abandoned.
DEFAULT_MAX_AGE_SECONDS = 3600
DEFAULT_KEEP = 3
ABANDONED_SECONDS = 24 * 3600

COMPLETE = "_COMPLETE"
_BUILD = re.compile(r"build-(\d+)-[0-9a-f]{32}")


def _canonical(value: object) -> object:
    """What JSON cannot hold, with its type, so that 1, "1" and a date differ."""
    return {"type": type(value).__name__, "value": str(value)}


@dataclass(frozen=True)
class Build:
    """A complete build: its folder and when it was begun."""

    path: str
    epoch_ms: int


class SnapshotStore:
    """Parquet snapshots of summaries, keyed by name, source and arguments."""

    def __init__(self, spark: SparkSession, root: str | None = None,
                 max_age_seconds: float = DEFAULT_MAX_AGE_SECONDS, keep: int = DEFAULT_KEEP):
        if root is None:
            base = checkpoint_dir(spark)
            if not base:
                raise ValueError("no snapshot root given and spark.checkpoint.dir is unset")
            root = f"{base.rstrip('/')}/orderscope-snapshots"
        if keep < 1:
            raise ValueError("keep must be at least 1")
        self.spark = spark
        self.root = root.rstrip("/")
        self.max_age_seconds = max_age_seconds
        self.keep = keep

    def path(self, name: str, source: str, params: dict | None = None) -> str:
        key = json.dumps({"name": name, "source": source, "params": params or {}},
                         sort_keys=True, default=_canonical)
        plain = re.sub(r"[^A-Za-z0-9_]", "_", name)[:60]
        return f"{self.root}/{plain}-{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def _store(self, path: str):
        """(Hadoop path, its file system)."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, folder: str) -> list[tuple[Build, bool]]:
        """The build folders, newest first, and whether each is complete."""
        where, fs = self._store(folder)
        if not fs.exists(where):
            return []
        found = []
        for status in fs.listStatus(where):
            match = _BUILD.fullmatch(status.getPath().getName())
            if match and status.isDirectory():
                path = status.getPath()
                done = fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, COMPLETE))
                found.append((Build(f"{folder}/{path.getName()}", int(match[1])), done))
        return sorted(found, key=lambda b: (b[0].epoch_ms, b[0].path), reverse=True)

    def latest_build(self, name: str, source: str, params: dict | None = None) -> Build | None:
        """The newest complete build, or None."""
        return next((b for b, done in self._folders(self.path(name, source, params)) if done), None)

    def read(self, name: str, source: str, params: dict | None = None, build: Build | None = None) -> DataFrame:
        """A stored build (the newest by default), in its stored row order,
        with a ``built_at`` timestamp column."""
        build = build or self.latest_build(name, source, params)
        if build is None:
            raise FileNotFoundError(f"no snapshot at {self.path(name, source, params)}")
        return self.spark.read.parquet(build.path).orderBy("_position").drop("_position")

    def write(self, name: str, df: DataFrame, source: str, params: dict | None = None) -> Build:
        """Store ``df`` as a new build and drop builds beyond ``keep``."""
        now = int(time.time() * 1000)
        folder = self.path(name, source, params)
        build = Build(f"{folder}/build-{now}-{uuid.uuid4().hex}", now)
        (df.withColumn("_position", F.monotonically_increasing_id())
         .withColumn("built_at", F.timestamp_millis(F.lit(now)))
         .write.mode("errorifexists").parquet(build.path))
        marker, fs = self._store(f"{build.path}/{COMPLETE}")
        fs.create(marker).close()
        self._retire(folder, now)
        return build

    def _retire(self, folder: str, now: int) -> None:
        complete = 0
        for build, done in self._folders(folder):
            complete += done
            if complete > self.keep if done else now - build.epoch_ms > ABANDONED_SECONDS * 1000:
                where, fs = self._store(build.path)
                fs.delete(where, True)

    def get_or_build(self, name: str, build: Callable[[], DataFrame], source: str,
                     params: dict | None = None, refresh: bool = False) -> DataFrame:
        """The stored summary if fresh enough, else build, store and return it.
        ``refresh=True`` forces a rebuild (the user's "refresh")."""
        if not refresh:
            newest = self.latest_build(name, source, params)
            if newest is not None and time.time() * 1000 - newest.epoch_ms <= self.max_age_seconds * 1000:
                return self.read(name, source, params, newest)
        return self.read(name, source, params, self.write(name, build(), source, params))
