"""Best-fit packing under conflicts: no bin holds two pieces of one source or of one cluster of near copies."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm import simhash
from barlight.llm.common import n_words, stored, tidy

CAPACITY = 2048
#: Pieces of a shard on average, which one task packs; pieces are dealt by hash, so long texts, hot sources and copies
#: spread evenly over the shards.
SHARD_PIECES = 4096
OUT = "doc_id long, piece int, n_tokens int, shard long, bin int, position int"


def pack_shard(f: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best-fit decreasing over bins ordered by residual, which carry a bitmap of sources and one of clusters.

    The search starts at the least residual that the piece fits in and goes on to larger ones until a bin's
    bitmaps don't meet the piece's; if none is left, it opens a bin.
    """
    f = f.sort_values(["n_tokens", "doc_id", "tie", "piece"], ascending=[False, True, True, True], kind="stable", na_position="last")
    often = f.cluster.map(f.cluster.value_counts())
    source_bit = {s: 1 << k for k, s in enumerate(f.source.drop_duplicates())}
    cluster_bit = {c: 1 << k for k, c in enumerate(f.cluster[often > 1].drop_duplicates())}
    bins: list[list[int]] = []  # of each bin: sources, clusters
    order: list[tuple[int, int]] = []  # (residual, bin)
    where, position = [], []
    for n, source, cluster in zip(f.n_tokens.tolist(), f.source.tolist(), f.cluster.tolist(), strict=True):
        s, c = source_bit[source], cluster_bit.get(cluster, 0)
        at = bisect_left(order, (n, -1))
        while at < len(order) and (bins[order[at][1]][0] & s or bins[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            residual, k = order.pop(at)
        else:
            residual, k = capacity, len(bins)
            bins.append([0, 0])
        bins[k][0] |= s
        bins[k][1] |= c
        where.append(k)
        position.append(capacity - residual)
        if residual > n:
            insort(order, (residual - n, k))
    return pd.DataFrame({"doc_id": f.doc_id, "piece": f.piece, "n_tokens": f.n_tokens, "shard": f.shard, "bin": where, "position": position})


def text_clusters(docs: DataFrame) -> DataFrame:
    """tie (hash of the text) and cluster of every distinct text: texts whose fingerprints links reach are one cluster."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    return simhash.near_duplicates(keyed).select(F.col("doc_id").alias("tie"), F.col("component_id").alias("cluster")).distinct()


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id, piece, n_tokens, shard, bin, position for every piece of every text; a bin is (shard, bin).

    Texts longer than the capacity are cut into full pieces and a rest. Copies share a cluster: that of `clusters`
    (tie, cluster), else the exact text. Null sources are one source; null and blank texts give one piece of 0
    tokens in no bin (null); equal rows stay separate rows; pieces of one length go by id, then text; an empty table
    gives an empty result; other columns are not read.
    """
    text, tie = F.col("text"), F.xxhash64("text")
    sized = stored(docs.select("doc_id", F.coalesce("source", F.lit("\0")).alias("source"), tie.alias("tie"), n_words(text).alias("size")), "sizes")
    number = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))
    shards = max(1, -(-(sized.agg(F.sum(number)).first()[0] or 0) // shard_pieces))
    sized = sized.withColumn("cluster", F.col("tie")) if clusters is None else sized.join(stored(clusters, "clusters"), "tie")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), (number - 1).cast("int")))).withColumn(
        "n_tokens", F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("int"))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", "piece"), F.lit(shards)))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(f, capacity)

    full = cut.where("n_tokens > 0").select("doc_id", "piece", "n_tokens", "shard", "source", "cluster", "tie")
    packed = full.groupBy("shard").applyInPandas(run, OUT)
    empty = cut.where("n_tokens <= 0").select("doc_id", "piece", "n_tokens", "shard", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("int").alias("position"))
    return packed.union(empty)


@tidy
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, clusters=text_clusters(docs))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLES: dict[str, str] = {}
