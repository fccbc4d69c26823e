"""A versioned table of models: folders of Parquet and a log whose entries are made exclusively."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was to follow."""


class ModelTable:
    """Models (a row each: model, asof_day and whatever is fitted, as coefficients, columns and metrics) by version.

    A commit writes its rows into a folder of its own and then creates the log entry behind the version it has read, which
    fails if that entry exists: compare and swap, as atomic as the exclusive creation of a file is (HDFS; object stores
    with conditional writes). Readers follow the log, so the rows of a writer that failed are never seen; an entry that is
    still empty is one being made and is passed over.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _entries(self) -> dict[int, str]:
        """Version to folder; the log has a line a commit."""
        fs, p = self._at("log")
        if not fs.exists(p):
            return {}
        out = {}
        for status in fs.listStatus(p):
            stream = fs.open(status.getPath())
            folder = bytes(stream.readNBytes(100)).decode()
            stream.close()
            if folder:
                out[int(status.getPath().getName())] = folder
        return out

    def version(self) -> int:
        """The newest version, 0 where there is none."""
        fs, p = self._at("log")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def commit(self, models: DataFrame, expected: int) -> int:
        """Adds models as version expected + 1; CommitConflict, leaving nothing behind, if that is there already."""
        folder = f"{expected + 1:012d}-{uuid.uuid4().hex}"
        models.withColumn("commit_no", F.lit(expected + 1)).write.parquet(f"{self.path}/rows/{folder}")
        fs, entry = self._at(f"log/{expected + 1:012d}")
        try:
            stream = fs.create(entry, False)
        except Py4JJavaError as e:
            rows_fs, rows = self._at(f"rows/{folder}")
            rows_fs.delete(rows, True)
            if fs.exists(entry):
                raise CommitConflict(f"version {expected + 1} is there already") from e
            raise
        stream.write(bytearray(folder.encode()))
        stream.close()
        return expected + 1

    def load(self, upto: Column | None = None, version: int | None = None) -> DataFrame | None:
        """Each model's newest row (by asof_day, then commit_no) of the versions up to one, and not after a day; None
        where nothing has been committed."""
        folders = [f"{self.path}/rows/{f}" for n, f in self._entries().items() if version is None or n <= version]
        if not folders:
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(*folders)
        rows = rows if upto is None else rows.where(F.col("asof_day") <= upto)
        w = Window.partitionBy("model").orderBy(F.desc("asof_day"), F.desc("commit_no"))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
