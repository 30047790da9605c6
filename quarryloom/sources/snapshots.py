"""Tables as versioned snapshots in one folder, in any store that Spark writes.

A version is a folder that Spark's committer has marked as complete; the current one is the highest.  A failed write
leaves an unmarked folder, which is never read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _system(self):
        return self._path(self.root).getFileSystem(self._conf)

    def versions(self, name: str, *, complete: bool = True) -> list[int]:
        system, folder = self._system(), self._path(f"{self.root}/{name}")
        if not system.exists(folder):
            return []
        found = [(m, s) for s in system.listStatus(folder) if (m := re.fullmatch(r"v(\d{8})", s.getPath().getName()))]
        return sorted(int(m[1]) for m, s in found if not complete or system.exists(self._path(s.getPath(), "_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current version; an empty table of the schema if there is none."""
        known = self.versions(name)
        if not known:
            if schema is None:
                raise ValueError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/v{known[-1]:08d}")

    def write(self, name: str, df: DataFrame, *, partition_by: list[str] | None = None, keep: int = 3) -> int:
        """A new version; versions but the last `keep` are dropped."""
        version = max(self.versions(name, complete=False), default=0) + 1
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{name}/v{version:08d}")
        for old in self.versions(name, complete=False)[:-keep]:
            self._system().delete(self._path(f"{self.root}/{name}/v{old:08d}"), True)
        return version
