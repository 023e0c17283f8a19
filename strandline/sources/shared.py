"""Intermediate tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names it. Where it is unset a folder of our own serves a local master, and a cluster is refused.
A settled table ends its lineage: a lost executor costs a re-read, later joins see plain scans, and what was numbered or
sampled on the way is the same for every reader.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is named (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="strandline-"))
        atexit.register(shutil.rmtree, _own_root[0], True)
    return f"file://{_own_root[0]}"


class Scratch:
    """Tables of one run of one operator in the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self._n = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}", 0
        self._tables: list[DataFrame] = []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here and later joins see a plain scan."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strandline_path = path
        self._tables.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove settled tables that nothing reads any more."""
        for df in frames:
            self.remove(df._strandline_path)
            self._tables = [t for t in self._tables if t is not df]

    def release(self, *frames: DataFrame | None) -> None:
        """Remove those of the frames that are settled tables."""
        self.drop(*[t for t in self._tables if any(t is f for f in frames)])

    def remove(self, where: str) -> None:
        """Remove a folder of files that operators wrote themselves."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *results: DataFrame) -> None:
        """Remove all settled tables but those that the operator's result reads."""
        self.drop(*[t for t in self._tables if all(t is not r for r in results)])

    def last(self, df: DataFrame) -> DataFrame:
        """``df`` written as the operator's result, and all tables that it came from removed."""
        result = self.settle(df, "result")
        self.keep(result)
        return result
