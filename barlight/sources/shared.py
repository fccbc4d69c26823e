"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths that this thread has taken, in order, for sweep().
_taken = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; any other fails, because its
    executors would not see each other's files."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barlight-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/barlight/{name}-{uuid.uuid4().hex}"
    _taken.paths = [*paths(), path]
    return path


def paths() -> list[str]:
    """Paths that this thread has taken and not swept."""
    return getattr(_taken, "paths", [])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, since: int, upto: int | None = None) -> None:
    """Deletes what this thread has stored beyond its first `since` paths (up to a number of them)."""
    for path in paths()[since:upto]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _taken.paths = [*paths()[:since], *(paths()[upto:] if upto is not None else [])]


def finished(df: DataFrame, name: str, since: int) -> DataFrame:
    """stored(df), after which everything is deleted that this thread has stored beyond its first `since` paths."""
    spark = df.sparkSession
    out = stored(df, name)
    sweep(spark, since, -1)
    return out


@contextlib.contextmanager
def swept_on_failure(spark: SparkSession) -> Iterator[int]:
    """Gives the number of paths taken so far; what is stored within is deleted if that fails."""
    since = len(paths())
    try:
        yield since
    except BaseException:
        sweep(spark, since)
        raise
