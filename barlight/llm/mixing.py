"""Mixing sources to target weights by blocks of tokens.

Words of each source form one stream that is cut into blocks of fixed length. Output shards draw multinomial
source counts; the n-th slot that a source gets anywhere is mapped through a keyed permutation of the source's
block numbers, one permutation for each pass over the source, and slots meet blocks in an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlight.llm.common import maybe_broadcast, n_words, stored, tidy, tucked, untucked

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
BLOCK_TOKENS, SHARD_BLOCKS, SEED = 128, 8192, 20_240_607
#: Sources that a mix may have (some 100 MB of names and sizes).
MOST_SOURCES = 1_000_000
#: Rows of a bucket in which offsets are summed; buckets of a source are summed first, so a hot source is many tasks.
BUCKET_ROWS = 5_000


def water_fill(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above `most` times its size; the excess is shared again by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        by = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = rest * weights[i] / by
        above = {i for i in open_ if out[i] > most * sizes[i]}
        if not above:
            break
        for i in above:
            out[i] = float(most * sizes[i])
        open_ -= above
    return out


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64) + key
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of range(n) sends k: a four-round Feistel network, walked until within range."""
    half = np.array([max(1, (int(x) - 1).bit_length() + 1 >> 1) for x in np.unique(n)], np.uint64)[np.searchsorted(np.unique(n), n)]
    mask, x, todo = (np.uint64(1) << half) - np.uint64(1), k.astype(np.uint64), np.ones(len(k), bool)
    while todo.any():
        left, right, h, m = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo]
        for r in range(4):
            left, right = right, left ^ (_mixed(right, key[todo] + np.uint64(r * 0x9E3779B9)) & m)
        x[todo] = left << h | right
        todo &= x >= n.astype(np.uint64)
    return x.astype(np.int64)


class Plan:
    """What a mix aims at, by source in code-point order with null last: a row a source, held by the driver.

    Sources are collections or hosts, not documents: at most MOST_SOURCES, else ValueError.
    """

    def __init__(self, names: list[str | None], sizes: list[int], block: int, weights: tuple = WEIGHTS, most: int = MOST):
        self.names, self.sizes, self.block = names, sizes, block
        self.targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
        self.blocks = [-(-s // block) for s in sizes]
        self.quotas = [min(round(t * b / s), most * b) if s else 0 for t, b, s in zip(self.targets, self.blocks, sizes, strict=True)]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, n, int(s), t) for i, (n, s, t) in enumerate(zip(self.names, self.sizes, self.targets, strict=True))]
        return spark.createDataFrame(rows, "source_no int, source_name string, source_size long, target double")


def place(docs: DataFrame, size: str = "_size", rows: int = BUCKET_ROWS, block: int = BLOCK_TOKENS, **how) -> tuple[Plan, DataFrame]:
    """The plan, and docs with source_no, source_size, target, bucket, row and the offset of each text in its source's stream.

    docs has doc_id, source, _tie (orders equal ids) and the column named by size. Offsets are sums over buckets
    of rows, then within them; the order is by hash of the id, so reruns agree.
    """
    spark = docs.sparkSession
    totals = docs.groupBy("source").agg(F.sum(size).alias("s"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()  # a row a source
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    plan = Plan([r.source for r in totals], [int(r.s or 0) for r in totals], block, **how)
    buckets = max(1, -(-sum(r.n for r in totals) // rows))
    named = plan.frame(spark)
    with_no = docs.join(maybe_broadcast(named, len(totals)), docs.source.eqNullSafe(named.source_name)).drop("source_name")
    with_no = with_no.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(buckets)))
    sums = with_no.groupBy("source_no", "bucket").agg(F.sum(size).alias("s"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_no", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "_tie", size)
    placed = with_no.withColumn("row", F.row_number().over(inside)).withColumn(
        "_upto", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(starts, ["source_no", "bucket"])
    return plan, placed.withColumn("offset", F.col("start") + F.col("_upto") - F.col(size)).drop("_upto", "start")


def slots(spark: SparkSession, plan: Plan, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """shard, source_no, block for every slot of the mix; the slots of a source are exactly its quota.

    Every shard draws its own multinomial counts. What a source has drawn above its quota goes to the sources
    below theirs, so totals follow the targets and not the draw.
    """
    total = sum(plan.quotas)
    schema = "shard long, source_no int, block long"
    if not total:
        return spark.createDataFrame([], schema)
    upto, quotas, count = np.cumsum(np.array(plan.quotas, np.int64)), plan.quotas, -(-total // shard_blocks)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f.id:
                # a multinomial draw as so many draws of a source; sources that get none take no row
                size = min(shard_blocks, total - int(shard) * shard_blocks)
                drawn_ = np.searchsorted(upto, np.random.default_rng([seed, int(shard)]).integers(0, total, size), side="right")
                source, counts = np.unique(drawn_, return_counts=True)
                yield pd.DataFrame({"shard": int(shard), "source_no": source, "n": counts})

    drawn = stored(spark.range(0, count, 1, min(count, 200)).mapInPandas(draw, "shard long, source_no int, n long"), "draws")
    drawn_of = np.zeros(len(quotas), np.int64)
    for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect():  # a row a source
        drawn_of[r.source_no] = r.n
    # slots above a source's quota, in order, take the places that sources below theirs lack, in order
    quota = np.array(quotas, np.int64)
    surplus, lack = np.maximum(drawn_of - quota, 0), np.maximum(quota - drawn_of, 0)
    before_surplus, upto_lack = np.cumsum(surplus) - surplus, np.cumsum(lack)
    # ordinals of a source's slots: sums over chunks of shards, then within them
    chunked = drawn.withColumn("chunk", F.floor(F.col("shard") / 4096))
    w = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = chunked.groupBy("source_no", "chunk").agg(F.sum("n").alias("s")).select(
        "source_no", "chunk", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("base"))
    v = Window.partitionBy("source_no", "chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranged = chunked.withColumn("upto", F.sum("n").over(v)).join(base, ["source_no", "chunk"]).where("n > 0")
    each = ranged.select("shard", "source_no", F.explode(F.sequence(F.col("base") + F.col("upto") - F.col("n"), F.col("base") + F.col("upto") - 1)).alias("k"))
    blocks = np.array(plan.blocks, np.int64)

    def to_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            no, k = f.source_no.to_numpy(np.int64).copy(), f.k.to_numpy(np.int64).copy()
            over = k >= quota[no]
            at = before_surplus[no[over]] + k[over] - quota[no[over]]
            to = np.searchsorted(upto_lack, at, side="right")
            no[over], k[over] = to, drawn_of[to] + at - (upto_lack[to] - lack[to])
            n = blocks[no]
            key = (np.uint64(seed) << np.uint64(32)) + (no.astype(np.uint64) << np.uint64(8)) + (k // n).astype(np.uint64)
            yield pd.DataFrame({"shard": f.shard, "source_no": no, "block": permuted(k % n, n, _mixed(key, key))})

    return each.mapInPandas(to_block, schema)


def pieces(placed: DataFrame, block: int = BLOCK_TOKENS, size: str = "_size") -> DataFrame:
    """A row for each part of a text that lies in one block: placed's columns, block, first word and words of the part."""
    last = F.floor((F.col("offset") + F.col(size) - 1) / block)
    cut = placed.where(F.col(size) > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), last)))
    first = F.greatest(F.col("block") * block - F.col("offset"), F.lit(0))
    return cut.withColumn("first", first).withColumn(
        "n", F.least((F.col("block") + 1) * block - F.col("offset"), F.col(size)) - first)


def mix(docs: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Null or blank texts have size 0 and take 0; a null source is a source of its own, the last; equal rows are
    taken from separately; an empty table gives an empty result; other columns are not read.
    """
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("_size"), F.xxhash64("text").alias("_tie")), "sized")
    plan, placed = place(sized, block=block)
    placed = stored(placed, "placed")
    often = stored(slots(docs.sparkSession, plan).groupBy("source_no", "block").agg(F.count("*").alias("times")), "often")
    taken = pieces(placed, block).join(often, ["source_no", "block"]).groupBy("source_no", "bucket", "row").agg(
        F.sum(F.col("n") * F.col("times")).alias("taken"))
    return placed.join(taken, ["source_no", "bucket", "row"], "left").select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """The mix itself with the columns of docs: a row for each part of a text in each slot that its block fills.

    text is the part with its own white space, n_chars (where docs has it) its length; empty texts take no slot. Rows are
    placed without their texts, and texts meet their parts in one join; rows that are equal in all columns share a text.
    A text of any length is one row, whose words are split once.
    """
    names = docs.columns
    docs = tucked(docs)
    rest = [F.to_json("_rest")] if isinstance(docs.schema["_rest"].dataType, StructType) else []
    every = ["text", "source", *(["n_chars"] if "n_chars" in names else [])]
    docs = docs.withColumn("_own", F.xxhash64(*every, *rest))
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("_size"), F.xxhash64("text").alias("_tie"), "_own"), "sized")
    plan, placed = place(sized, block=block)
    placed = stored(placed, "placed")
    # stored, so that its join is planned by its real size
    often = stored(slots(docs.sparkSession, plan).groupBy("source_no", "block").agg(F.count("*").cast("int").alias("times")), "often")
    part = F.struct(*[F.col(c).cast("int").alias(c) for c in ("first", "n", "times")])
    parts = pieces(placed, block).join(often, ["source_no", "block"]).groupBy("source_no", "bucket", "row", "doc_id", "_own").agg(
        F.collect_list(part).alias("_parts"))  # a part for each block that a text lies in
    parts = parts.select(F.col("doc_id").alias("_id"), F.col("_own").alias("_part_of"), "_parts")
    again = stored(sized.groupBy("doc_id", "_own").count().where(F.col("count") > 1).select(F.col("doc_id").alias("_again"), F.col("_own").alias("_again_own")), "again")
    among = docs.doc_id.eqNullSafe(F.col("_again")) & (docs["_own"] == F.col("_again_own"))
    small = maybe_broadcast(again, again.count())
    single = docs.join(small, among, "left_anti").union(docs.join(small, among, "left_semi").dropDuplicates(["doc_id", "_own"]))
    # words with the separators that follow them; leading separators belong to the first
    tokens = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    tokens = F.filter(tokens, lambda t: F.rtrim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")) != "")
    cut = lambda w, p: F.struct(F.array_join(F.slice(w, p["first"] + 1, p["n"]), "").alias("text"), p["times"].alias("times"))
    whole = single.join(parts, single.doc_id.eqNullSafe(parts["_id"]) & (single["_own"] == parts["_part_of"]))
    out = whole.withColumn("_cut", F.explode(F.transform(F.array(tokens), lambda w: F.transform("_parts", lambda p: cut(w, p)))[0]))
    out = out.withColumn("text", F.col("_cut.text")).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_cut.times"))))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return untucked(out, names)


@tidy
def op5_multinomial_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_multinomial_mixing": op5_multinomial_mixing}
ORACLES: dict[str, str] = {}
