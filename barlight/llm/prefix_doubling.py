"""Removal of repeated substrings by distributed prefix doubling over byte positions.

The name of 2h bytes at a position is made of the pair of names of h bytes there and h further on. A round sends the
names of one length to buckets by their leading bits, Spark sorts each bucket, and what it answers ranks each name among
the documents: alone, or held before. Positions that are alone drop out, those left go on at a greater length:

1. 24 bytes, at the least-named position of each 50-byte window (about one in fourteen). Windows that are equal choose the
   same position, so a window whose position is alone is alone.
2. 76 bytes around the positions left, all that their windows can cover, which is past the threshold: a context that an
   earlier document holds is settled, with all its windows.
3. 50 bytes, at every window of the contexts left, once a context.

Documents are placed in blocks in order of their ids, so an answer is a bit (an earlier block holds this name) and a name
travels once a block, which pre-aggregates frequent ones. Names are 64 bits of a hash of the pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import discard, fresh_path, stored, tidy

#: Bytes of a repeated string (fixed by the result contract), of the names that positions are chosen by, and the places a
#: window chooses among.
LENGTH, SEED = 50, 24
PLACES = LENGTH - SEED + 1
LEFT = PLACES - 1
CONTEXT = LEFT + LENGTH
#: Stands between documents in a block: no byte.
GAP = 256
#: Positions named at once; contexts named at once.
STEP, CONTEXTS = 1 << 18, 20_000
PLACE_FREE = ~np.uint64(2 * STEP - 1)


@dataclass(frozen=True)
class Blocks:
    """Bytes of text of a block and of a range of ids that one task places, and names of a bucket (at least so many
    buckets, so that they spread)."""

    block_bytes: int = 3 << 20
    range_bytes: int = 24 << 20
    bucket_names: int = 4_000_000
    least_buckets: int = 256


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    z += b
    z *= np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(29)
    return z


def _doubled(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of 8 and of 16 symbols at each place of the last axis; those of four are packed as they are."""
    x = symbols.astype(np.uint64)
    x = (x[..., :-1] << np.uint64(9)) | x[..., 1:]
    x = (x[..., :-2] << np.uint64(18)) | x[..., 2:]
    x = _paired(x[..., :-4], x[..., 4:])
    return x, _paired(x[..., :-8], x[..., 8:])


def window_names(symbols: np.ndarray) -> np.ndarray:
    """Names of the LENGTH symbols at each place of the last axis."""
    _, x = _doubled(symbols)
    x = _paired(x[..., :-16], x[..., 16:])
    return _paired(x[..., :-18], x[..., 18:])


def context_names(symbols: np.ndarray) -> np.ndarray:
    """Names of the rows of CONTEXT symbols."""
    eight, x = _doubled(symbols)
    x = _paired(x[:, :-16], x[:, 16:])
    return _paired(_paired(x[:, 0], x[:, 32]), _paired(eight[:, 64], eight[:, 68]))


def chosen(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, name, first, last: chosen places, their SEED-symbol names, and the windows that chose them (from, to)."""
    out = []
    for s in range(0, len(symbols) - LENGTH + 1, STEP):
        part = symbols[s:s + STEP + LENGTH]
        if len(part) < LENGTH:
            break
        eight, sixteen = _doubled(part)
        name = _paired(sixteen[:len(part) - SEED + 1], eight[16:])
        n = min(STEP, len(part) - LENGTH + 1)
        gaps = np.r_[0, np.cumsum(part == GAP)]
        whole = gaps[LENGTH:LENGTH + n] == gaps[:n]
        # the place stands in the low bits, so that the least is found with its place, the first of several
        least = (name & PLACE_FREE) | np.arange(len(name), dtype=np.uint64)
        for h in (1, 2, 4, 8, PLACES - 16):
            least = np.minimum(least[:-h], least[h:])
        windows = np.flatnonzero(whole)
        if len(windows):
            at = (least[windows] & ~PLACE_FREE).astype(np.int64)
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(windows) > 1)])
            ends = np.r_[new[1:], len(at)] - 1
            out.append((at[new] + s, name[at[new]], windows[new] + s, windows[ends] + s))
    if not out:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    place, name, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)])  # a part's end may split windows of one place
    return place[new], name[new], first[new], last[np.r_[new[1:], len(place)] - 1]


class Block:
    """Texts of a block as symbols, with gaps before, between and behind them."""

    def __init__(self, sizes: np.ndarray, data: bytes):
        self.sizes, self.data = sizes, np.frombuffer(data, np.uint8)
        self.from_ = np.r_[0, np.cumsum(sizes)]
        shift = np.repeat(np.arange(1, len(sizes) + 1) * LEFT, sizes)
        self.symbols = np.full(len(self.data) + (len(sizes) + 1) * LEFT, GAP, np.uint16)
        self.symbols[np.arange(len(self.data)) + shift] = self.data
        self.starts = self.from_[:-1] + np.arange(1, len(sizes) + 1) * LEFT

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the leading bits, so buckets follow each other in the order of names."""
    return ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _runs(names: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """bucket, from, to of names in order."""
    of = bucket_of(names, buckets).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of)) + 1
    edges = [0, *cuts.tolist(), len(of)] if len(of) else [0]
    return ((int(of[i]), i, j) for i, j in zip(edges, edges[1:], strict=False))


MESSAGE = "bucket int, block long, low long, names binary"
ANSWER = "block long, bucket int, bits binary"


def _messages(block: int, low: int, names: np.ndarray, buckets: int) -> Iterator[tuple]:
    """A row for each bucket of a block's distinct names, which are in order."""
    return ((bucket, block, low, names[i:j].tobytes()) for bucket, i, j in _runs(names, buckets))


def _bits(answers: list | None, names: np.ndarray, buckets: int) -> np.ndarray:
    """The answered bit of each of a block's distinct names."""
    by_bucket = {a["bucket"]: a["bits"] for a in answers or []}
    out = np.zeros(len(names), bool)
    for bucket, i, j in _runs(names, buckets):
        out[i:j] = np.unpackbits(np.frombuffer(by_bucket[bucket], np.uint8), count=j - i)
    return out


def _ranked(names: DataFrame, shared: bool) -> DataFrame:
    """Sorts the names of each bucket and answers every block by a bit a name: several blocks hold it (shared), or one of
    lower ids does. A row (block, answers)."""

    def rank(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("names")]
        low = np.repeat(table.column("low").to_numpy(), [len(p) for p in parts])
        every = np.concatenate(parts)
        order = np.lexsort((low, every))
        ranked = every[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        rank_of = np.cumsum(new) - 1
        found = np.empty(len(every), bool)
        found[order] = (np.bincount(rank_of) > 1)[rank_of] if shared else low[order] > low[order][new][rank_of]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(found, cuts)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    answers = names.groupBy("bucket").applyInArrow(rank, ANSWER)
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def _arrow(rows: Callable[[dict], Iterator[tuple]], schema: str, df: DataFrame) -> DataFrame:
    """df with every row (a block) turned into rows of the schema, batch by batch."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    into = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(rows({c: batch.column(c)[i].as_py() for c in batch.schema.names}))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), into.types, strict=True)], schema=into)

    return df.mapInArrow(run, schema)


def placed(docs: DataFrame, size: int, blocks: Blocks) -> DataFrame:
    """block, ids, sizes, data: texts (doc_id, data) in order of id, some to a block. No two blocks share an id, but those
    of one id alone, which an id with many rows is cut into; these count as one another's equals."""
    many = max(1, -(-size // blocks.range_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, first, pool, run = TaskContext.get().partitionId() << 32, True, [], []

        def block(rows: list) -> Iterator[pa.RecordBatch]:
            nonlocal no
            if rows:
                ids, texts = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]
                columns = [pa.array([no], pa.int64()), pa.array([ids.tobytes()]), pa.array([np.array([len(t) for t in texts], np.int64).tobytes()]), pa.array([b"".join(texts)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "data"])
                no += 1

        weight = lambda rows: sum(len(r[1]) + LEFT for r in rows)
        held = [0, 0]  # weights of pool and run
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if run and run[-1][0] != row[0]:
                    if first:  # the range before may end in this id
                        yield from block(run)
                    else:
                        pool += run
                        held[0] += held[1]
                    first, run, held[1] = False, [], 0
                    if held[0] >= blocks.block_bytes:
                        yield from block(pool)
                        pool, held[0] = [], 0
                run.append(row)
                held[1] += weight([row])
                if held[1] >= 2 * blocks.block_bytes and len(run) > 1:  # the rest of this id's rows become blocks of their own
                    yield from block(pool)
                    yield from block(run[:-1])
                    first, pool, run, held = True, [], run[-1:], [0, weight(run[-1:])]
        yield from block(pool)
        yield from block(run)

    ordered = docs.withColumn("_t", F.xxhash64("data")).repartitionByRange(many, "doc_id", "_t").sortWithinPartitions("doc_id", "_t").select("doc_id", "data")
    return ordered.mapInArrow(cut, "block long, ids binary, sizes binary, data binary")


def _array(x: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(x, kind)


def _kept(df: DataFrame, name: str, parts: int) -> DataFrame:
    """stored(), in tighter files and bucketed by block, so that answers come to the blocks and blocks are not shuffled."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts, "block").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of the catalog; the files stay
    return out


def removed_spans(blocks: DataFrame, buckets: int, parts: int) -> DataFrame:
    """block, text, start, end: for each block arrays of spans to remove, of its text-th text, in order."""
    spark = blocks.sparkSession

    def seeds(row: dict) -> Iterator[tuple]:
        b = Block(_array(row["sizes"]), row["data"])
        yield from _messages(row["block"], int(_array(row["ids"])[0]), np.unique(chosen(b.symbols)[1]), buckets)

    def contexts(row: dict) -> Iterator[tuple]:
        """The places of a block that are not alone, and their distinct contexts."""
        b, ids = Block(_array(row["sizes"]), row["data"]), _array(row["ids"])
        place, name, first, last = chosen(b.symbols)
        names, of = np.unique(name, return_inverse=True)
        text = b.text_of(place)
        owner = ids[text]
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, of, owner)
        np.maximum.at(high, of, owner)
        keep = np.flatnonzero((_bits(row["answers"], names, buckets) | (low < high))[of])
        if not len(keep):
            return
        place, text, first, last = place[keep], text[keep], first[keep], last[keep]
        around = [b.symbols[place[i:i + CONTEXTS, None] + np.arange(-LEFT, LENGTH)] for i in range(0, len(place), CONTEXTS)]
        name = np.concatenate([context_names(x) for x in around])
        names, at, of = np.unique(name, return_index=True, return_inverse=True)
        # first occurrences, in the order of places, so that neighbours overlap in the file
        bytes_ = np.concatenate([(x & 255).astype(np.uint8) for x in around])[np.sort(at)]
        yield (row["block"], int(ids[0]), names.tobytes(), of.astype(np.int32).tobytes(), text.astype(np.int32).tobytes(), (place - b.starts[text]).tobytes(),
               ids[text].tobytes(), at.tobytes(), (first - place + LEFT)[at].astype(np.int8).tobytes(), (last - place + LEFT)[at].astype(np.int8).tobytes(), bytes_.tobytes())

    def tell(row: dict) -> Iterator[tuple]:
        yield from _messages(row["block"], row["low"], _array(row["names"], np.uint64), buckets)

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        """settled (a context of an earlier block), and for the windows of the others: context, offset, name."""
        names, at = _array(row["names"], np.uint64), _array(row["at"])
        settled = _bits(row["answers"], names, buckets)
        symbols = _array(row["bytes"], np.uint8).reshape(-1, CONTEXT)
        rank = np.empty(len(at), np.int64)
        rank[np.argsort(at, kind="stable")] = np.arange(len(at))
        first, last = _array(row["first"], np.int8), _array(row["last"], np.int8)
        context, offset, name = [], [], []
        still = np.flatnonzero(~settled)
        for i in range(0, len(still), CONTEXTS):
            some = still[i:i + CONTEXTS]
            own = window_names(symbols[rank[some]])
            x, o = np.nonzero((np.arange(PLACES) >= first[some, None]) & (np.arange(PLACES) <= last[some, None]))
            context.append(some[x].astype(np.int32)), offset.append(o.astype(np.int8)), name.append(own[x, o])
        empty = [np.empty(0, np.int32)], [np.empty(0, np.int8)], [np.empty(0, np.uint64)]
        return (settled, *(np.concatenate(x or e) for x, e in zip((context, offset, name), empty, strict=True)))

    def windows(row: dict) -> Iterator[tuple]:
        yield from _messages(row["block"], row["low"], np.unique(opened(row)[3]), buckets)

    def spans(row: dict) -> Iterator[tuple]:
        settled, context, offset, name = opened(row)
        names, of = np.unique(name, return_inverse=True)
        owner, at = _array(row["owner"]), _array(row["at"])
        earliest = owner[at]  # the first occurrence of a context is in its earliest document
        low = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(low, of, earliest[context])
        gone = _bits(row["more"], names, buckets)[of] | (low[of] < earliest[context])
        mask = np.zeros((len(settled), PLACES), bool)
        mask[context[gone], offset[gone]] = True
        first, last = _array(row["first"], np.int8), _array(row["last"], np.int8)
        whole = (np.arange(PLACES) >= first[:, None]) & (np.arange(PLACES) <= last[:, None])
        which, text, place = _array(row["which"], np.int32), _array(row["text"], np.int32), _array(row["place"])
        all_of = settled[which] | (owner > earliest[which])
        got_text, got_start = [], []
        for i in range(0, len(which), CONTEXTS):
            part = slice(i, i + CONTEXTS)
            x, o = np.nonzero(np.where(all_of[part, None], whole[which[part]], mask[which[part]]))
            got_text.append(text[part][x]), got_start.append(place[part][x] - LEFT + o)
        text, start = np.concatenate(got_text), np.concatenate(got_start)
        if not len(start):
            return
        order = np.lexsort((start, text))
        text, start = text[order], start[order]
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (start[1:] > start[:-1] + LENGTH)])
        end = start[np.r_[new[1:], len(start)] - 1] + LENGTH
        yield row["block"], text[new].astype(np.int32).tobytes(), start[new].tobytes(), end.tobytes()

    alone = _ranked(_arrow(seeds, MESSAGE, blocks), True)
    schema = ("block long, low long, names binary, which binary, text binary, place binary, owner binary, at binary, first binary, last binary, bytes binary")
    left = _kept(_arrow(contexts, schema, blocks.hint("merge").join(alone, "block")), "contexts", parts)
    known = stored(_ranked(_arrow(tell, MESSAGE, left.select("block", "low", "names")), False), "answers")
    more = _ranked(_arrow(windows, MESSAGE, left.hint("merge").join(known, "block")), False).withColumnRenamed("answers", "more")
    out = stored(_arrow(spans, "block long, text binary, start binary, end binary", left.hint("merge").join(known, "block").join(more, "block", "left")), "spans")
    discard(spark, left, known)
    return out


def kept_texts(docs: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (data) of each row of docs.

    Null and empty texts have no bytes. Rows that share an id are one document: their texts don't match each other, and
    repeated rows get equal results. Rows without an id are compared with none and keep all. A text is never cut, so a
    block holds at least one, however long. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    n, size = own.where("doc_id IS NOT NULL").agg(F.count("*"), F.sum(F.octet_length("data"))).first()
    without = own.where("doc_id IS NULL").select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "data")
    if not n:
        return without
    size += n * LEFT
    buckets = max(blocks.least_buckets, size // PLACES * 2 // blocks.bucket_names)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // blocks.range_bytes))
    table = _kept(placed(own.where("doc_id IS NOT NULL"), size, blocks), "blocks", parts)
    found = removed_spans(table, buckets, parts)

    def cut(row: dict) -> Iterator[tuple]:
        ids, sizes, data = _array(row["ids"]), _array(row["sizes"]), row["data"]
        from_ = np.r_[0, np.cumsum(sizes)]
        text, start, end = (_array(row["text"] or b"", np.int32), _array(row["start"] or b""), _array(row["end"] or b""))
        at = np.searchsorted(text, np.arange(len(ids) + 1))
        for k in range(len(ids)):
            own, pieces, upto = data[from_[k]:from_[k + 1]], [], 0
            for i in range(at[k], at[k + 1]):
                pieces.append(own[upto:start[i]])
                upto = end[i]
            kept = b"".join([*pieces, own[upto:]])
            yield int(ids[k]), len(own), len(own) - len(kept), int(at[k + 1] - at[k]), kept

    return _arrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, data binary", table.hint("merge").join(found, "block", "left")).unionByName(without)


@tidy
def op12_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"))


QUERIES = {"op12_prefix_doubling": op12_prefix_doubling}
ORACLES: dict[str, str] = {}
