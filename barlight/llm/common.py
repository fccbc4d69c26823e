"""What the corpus operators share: shared storage, size-checked broadcasts, components."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.sources.shared import finished, swept_on_failure
from barlight.sources.shared import fresh_path as fresh_path
from barlight.sources.shared import stored as stored

#: Separators of words, fixed by the result contracts.
SPACES = r"[\x20\x09-\x0D]+"
#: A join side of at most this many rows may be broadcast (narrow rows, some tens of MB).
BROADCAST_ROWS = 200_000
#: And one with an array column, if its arrays have at most so many entries in all (keys, or spans of some 100 bytes).
BROADCAST_CELLS = 400_000


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of stored() frames that nothing will read again."""
    jvm = spark._jvm
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose result is stored, so that its intermediate tables are deleted; results are narrow."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with swept_on_failure(spark) as since:
            return finished(query(spark, sf_dir), query.__name__, since)

    return run


def shuffles_deleted(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query during which the shuffle files of each table that it stores are deleted as soon as that is written."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = spark.conf.get(name)
        spark.conf.set(name, "true")
        try:
            return query(spark, sf_dir)
        finally:
            spark.conf.set(name, was)

    return run


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the counted rows are within the limit; else Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def broadcast_arrays(df: DataFrame, column: str, limit: int = BROADCAST_CELLS) -> DataFrame:
    """A broadcast hint only where the rows and all entries of an array column together are within their limits."""
    rows, cells = df.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and cells <= limit else df


#: Columns of documents that operators read or change; others pass through untouched, whatever their names.
USED = ("doc_id", "text", "source", "n_chars")


def tucked(docs: DataFrame) -> DataFrame:
    """The used columns, and all others as one struct, so that their names clash with nothing."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in USED]
    return docs.select(*[c for c in USED if c in docs.columns], (F.struct(*others) if others else F.lit(None)).alias("_rest"))


def untucked(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in USED else F.col(f"_rest.`{c}`").alias(c) for c in names])


def single_spaced(text: Column) -> Column:
    """The text trimmed, with every run of separators as one space; null gives an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def n_words(text: Column) -> Column:
    """Number of words of a text without building them."""
    t = single_spaced(text)
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs: one row (node, root) per node that has an edge.

    Every round each label moves to the neighbour of least hash, edges are relabelled, loops and repeats go;
    the edges left shrink by a constant factor in expectation, so the rounds are logarithmic. Nothing is
    collected: edges and labels stay tables. The minimum is a partial aggregate, so hubs do no harm; the
    relabelling joins are plain equi-joins, which adaptive execution splits where a hub is skewed.
    """
    spark = edges.sparkSession
    live = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        moves = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(
            F.col("a").alias("was"), F.least(F.col("m"), rank("a"))["x"].alias("now"))
        moves = stored(moves, "moves")
        if labels is None:
            labels = moves.select(F.col("was").alias("node"), F.col("now").alias("root"))
        else:
            labels = stored(labels.join(moves, labels.root == moves.was, "left")
                            .select("node", F.coalesce("now", "root").alias("root")), "labels")
        old = live
        m2 = moves.select(F.col("was").alias("was2"), F.col("now").alias("now2"))
        live = stored(live.join(moves, live.a == moves.was).join(m2, live.b == m2.was2)
                      .select(F.least("now", "now2").alias("a"), F.greatest("now", "now2").alias("b"))
                      .where("a <> b").distinct(), "edges")
        discard(spark, old)
    return labels if labels is not None else spark.createDataFrame([], "node long, root long")
