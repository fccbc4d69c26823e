"""Language-model scores by deleted interpolation: bigrams, unigrams and a uniform share, mixed by context frequency.

For a token k after a token j: P = a2(b) c(j,k)/c(j) + a1(b) c(k)/N + a0(b)/(V+1), with b the bucket of c(j), N the
training tokens and V their types; all unknown words are one further type. The weights come from
expectation-maximisation over the tokens of a held-out fold of the training documents, with counts of the other folds.

Texts are taken in blocks. A block asks for the counts of its distinct words and bigrams: its keys are dealt to
buckets by hash, a bucket adds up what all blocks have of a key and answers each of them; the block's stream of words
travels along and meets the answers. Keys of a block are distinct, so no frequent word or bigram makes a large group. A block deals to at most FAN parts; where there are more
buckets than that, the requests of a part are merged in chunks that ask for their keys in turn, so that the number of
records follows the input.
"""

from __future__ import annotations

import itertools
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import stored, tidy

FOLDS, TEST, DEV = 7, 2, 3
#: Bytes of text whose keys a bucket holds, and of texts that are counted together as one block.
BUCKET_BYTES, BLOCK_BYTES = 12 << 20, 7 << 20
#: Parts that a block or chunk deals its keys to, and keys that are merged in a chunk.
FAN, CHUNK_KEYS = 256, 2_000_000
END = b""  # no word is empty
PAIR = np.int64(1) << 62  # marks the key of a bigram
BUCKETS = 26  # of context counts: none, and by powers of two


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w) >> 2


def fold(doc_id: str) -> object:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _mixed(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return z ^ (z >> np.uint64(29))


def pair_key(j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Key of a bigram by the hashes of its words."""
    z = _mixed(_mixed(j) + k.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (z >> np.uint64(2)).astype(np.int64) | PAIR


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(key) % np.uint64(buckets)).astype(np.int64)


def short(key: np.ndarray) -> np.ndarray:
    """Keys of words as they are, of bigrams in 40 bits: what a bucket tells keys apart by. A bucket has some two million
    keys, so that about one or two bigrams in a million share their key with another."""
    return np.where(key < PAIR, key, (_mixed(key ^ np.int64(0x5851F42D4C957F2D)) >> np.uint64(24)).astype(np.int64) | PAIR)


def in_order(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of keys by bucket, then short key, and their buckets in that order."""
    b = bucket_of(key, buckets)
    order = np.lexsort((short(key), b))
    return order, b[order]


def units(buckets: int, fan: int) -> list[int]:
    """Buckets of a part at each level of dealing, down to one."""
    out, unit = [], buckets
    while not out or unit > 1:
        unit = -(-unit // fan)
        out.append(unit)
    return out


def packed(*arrays: np.ndarray, rising: bool = False) -> bytes:
    """Integer arrays behind their lengths, each number in the fewest bytes, by planes of bytes, compressed; the first as
    differences if it is rising."""
    parts = []
    for i, a in enumerate(arrays):
        a = np.diff(a, prepend=0) if rising and i == 0 else a
        size = next(s for s in (1, 2, 4, 8) if s == 8 or len(a) == 0 or (int(a.max()) < 1 << 8 * s - 1 and int(a.min()) >= 0))
        parts += [struct.pack("<qb", len(a), size), np.ascontiguousarray(a.astype(f"<i{size}")).view(np.uint8).reshape(-1, size).T.tobytes()]
    raw = b"".join(parts)
    return struct.pack("<q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes, rising: bool = False) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], struct.unpack_from("<q", data)[0], "zstd", asbytes=True)
    at, out = 0, []
    while at < len(raw):
        n, size = struct.unpack_from("<qb", raw, at)
        planes = np.frombuffer(raw, np.uint8, n * size, at + 9).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<i{size}").ravel().astype(np.int64))
        at += 9 + n * size
    return [np.cumsum(out[0]), *out[1:]] if rising else out


class Texts:
    """Texts of a block as they come: ids, folds, lengths with the end, and their words by number in order of first use."""

    def __init__(self) -> None:
        self.ids, self.parts, self.lengths, self.streams, self.load = [], [], [], [], 0
        self.local: dict[bytes, int] = defaultdict(itertools.count(1).__next__, {END: 0})

    def add(self, doc_id: int | None, part: int, text: str | None) -> None:
        found = tokens(text)
        stream = np.zeros(len(found) + 1, np.int32)
        stream[:-1] = np.fromiter(map(self.local.__getitem__, found), np.int32, len(found))
        self.ids.append(doc_id)
        self.parts.append(part)
        self.lengths.append(len(stream))
        self.streams.append(stream)
        self.load += 6 * len(stream) + 60

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and the stream, numbered by frequency (so that it packs well), END being 0."""
        stream = np.concatenate(self.streams)
        order = np.r_[0, 1 + np.argsort(-np.bincount(stream, minlength=len(self.local))[1:], kind="stable")]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return np.fromiter(map(word_hash, self.local), np.int64, len(self.local))[order], rank[stream]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Texts]:
    """Blocks of bounded bytes, those of the held-out fold apart; a longer text is a block of its own."""
    held = {False: Texts(), True: Texts()}
    for batch in batches:
        for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            held[part == DEV].add(doc_id, part, text.as_py())
            if held[part == DEV].load >= size:
                yield held[part == DEV]
                held[part == DEV] = Texts()
    yield from (x for x in held.values() if x.ids)


class Block:
    """A block's stream of words by number (END is 0) and its distinct bigrams, with the hashes of the words or without."""

    def __init__(self, n_words: int, stream: np.ndarray, lengths: np.ndarray, words: np.ndarray | None = None):
        self.words, self.stream = words, stream
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        before = np.r_[0, stream[:-1]]  # a text begins after an end, and every text ends with one
        pairs, self.pair = np.unique(before * n_words + stream, return_inverse=True)
        self.j, self.k = pairs // n_words, pairs % n_words

    def keys(self) -> np.ndarray:
        """Keys of the words, then of the bigrams."""
        return np.r_[self.words, pair_key(self.words[self.j], self.words[self.k])]


def dealt(block: int, keys: np.ndarray, bucket: np.ndarray, unit: int, *more: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """part, block, data of a block's requests; keys come in_order(). A part of one bucket takes short keys."""
    part = bucket // unit
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
    for i, j in itertools.pairwise(cuts):
        yield int(part[i]), block, packed(short(keys[i:j]) if unit == 1 else keys[i:j], *(m[i:j] for m in more), rising=unit == 1)


def as_batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


ASKED = {"part": pa.int64(), "block": pa.int64(), "data": pa.binary()}
TOLD = {"block": pa.int64(), "part": pa.int64(), "data": pa.binary(), "types": pa.int64(), "tokens": pa.int64(), "dev": pa.int64()}
ASKED_SCHEMA, TOLD_SCHEMA = "part long, block long, data binary", "block long, part long, data binary, types long, tokens long, dev long"
#: Parts of rows that are no requests: what a chunk keeps of those it merged; states of blocks have this or less.
MEMO, STATE = -1, -2


def grouped(frame: DataFrame, key: str, other: str, work: Callable, schema: str) -> DataFrame:
    """Runs work(key, iterator of (other, data)) once a key, in order of other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for k, group in itertools.groupby(rows, lambda r: r[0]):
            yield from work(k, ((r[1], r[2]) for r in group))

    return frame.select(key, other, "data").repartition(key).sortWithinPartitions(key, other).mapInArrow(run, schema)


def _meet(part: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Answers of a bucket: for each block the totals of its keys; and the bucket's types, tokens and held-out tokens.
    States of blocks pass."""
    if part <= STATE:
        yield from (as_batch([(block, MEMO, data, 0, 0, 0)], TOLD) for block, data in rows)
        return
    names, parts = zip(*((block, unpacked(data, rising=True)) for block, data in rows), strict=True)
    key, n, d = (np.concatenate([p[i] for p in parts]) for i in range(3))
    keys, at = np.unique(key, return_inverse=True)
    total, dev = (np.bincount(at, x, len(keys)).astype(np.int64) for x in (n, d))
    own = keys < PAIR
    yield as_batch([(-1, part, b"", int((total[own] > 0).sum()), int(total[own].sum()), int(dev[own].sum()))], TOLD)
    ends = np.cumsum([len(p[0]) for p in parts])
    for block, p, end in zip(names, parts, ends, strict=True):
        there = at[end - len(p[0]) : end]
        yield as_batch([(block, part, packed(total[there], dev[there]), 0, 0, 0)], TOLD)


def _told(rows: Iterator[tuple[int, bytes]]) -> tuple[bytes, list[np.ndarray]]:
    """The state of a block or memo of a chunk (they come first), and the answers in order of their parts."""
    state, parts = None, []
    for part, data in rows:
        if part == MEMO:
            state = data
        else:
            parts.append(unpacked(data))
    return state, [np.concatenate([p[i] for p in parts]) for i in range(2)]


def answered(requests: DataFrame, buckets: int, levels: list[int], chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """TOLD: for every request (part, block, data) the training and held-out totals of its keys, in their order; rows of
    the states pass, with part MEMO."""
    if levels[0] == 1:
        return grouped(requests, "part", "block", _meet, TOLD_SCHEMA)
    unit = levels[1]

    def merge(part: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if part <= STATE:
            yield from (as_batch([(part, block, data)], ASKED) for block, data in rows)
            return
        names, parts, held = [], [], 0
        for block, data in itertools.chain(rows, [(None, None)]):
            if block is not None:
                names.append(block)
                parts.append(unpacked(data))
                held += len(parts[-1][0])
            if names and (block is None or held >= chunk_keys):
                key, n, d = (np.concatenate([p[i] for p in parts]) for i in range(3))
                keys, at = np.unique(key, return_inverse=True)
                order, b = in_order(keys, buckets)
                place = np.empty(len(keys), np.int64)
                place[order] = np.arange(len(keys))
                chunk = xxhash.xxh64_intdigest(struct.pack("<qqq", unit, part, names[0])) >> 1
                memo = packed(np.full(len(names), part), np.array(names), np.array([len(p[0]) for p in parts]), place[at])
                sums = [np.bincount(at, x, len(keys)).astype(np.int64)[order] for x in (n, d)]
                yield as_batch([(MEMO, chunk, memo), *dealt(chunk, keys[order], b, unit, *sums)], ASKED)
                names, parts, held = [], [], 0

    def split(chunk: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        memo, (n, d) = _told(rows)
        part, names, sizes, place = unpacked(memo)
        ends = np.cumsum(sizes)
        yield as_batch([(block, p, packed(n[place[e - s : e]], d[place[e - s : e]]), 0, 0, 0)
                        for p, block, s, e in zip(part.tolist(), names.tolist(), sizes.tolist(), ends.tolist(), strict=True)], TOLD)

    merged = stored(grouped(requests, "part", "block", merge, ASKED_SCHEMA), "merged-requests")
    below = stored(answered(merged.where("part >= 0"), buckets, levels[1:], chunk_keys), "answers-below")
    told = below.where("block <> -1").select("block", "part", "data").unionByName(merged.where(F.col("part") == MEMO))
    zero = F.lit(0).cast("long")
    states = merged.where(F.col("part") <= STATE).select("block", F.lit(MEMO).cast("long").alias("part"), "data", zero.alias("types"), zero.alias("tokens"), zero.alias("dev"))
    return grouped(told, "block", "part", split, TOLD_SCHEMA).unionByName(below.where("block = -1")).unionByName(states)


GATHERED = {"block": pa.int64(), "data": pa.binary(), "types": pa.int64(), "tokens": pa.int64(), "dev": pa.int64()}
GATHERED_SCHEMA = "block long, data binary, types long, tokens long, dev long"


def gathered(told: DataFrame, buckets: int) -> DataFrame:
    """A row for each block: what the scores need of it (ids, nulls, lengths, stream, and the training and held-out totals
    of its words and bigrams); and rows of block -1 with sums of types, tokens and held-out tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = lambda batch: zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
        for block, group in itertools.groupby((r for batch in batches for r in columns(batch)), lambda r: r[0]):
            if block == -1:
                yield as_batch([(-1, b"", *(sum(x) for x in zip(*(r[3:] for r in group), strict=True)))], GATHERED)
                continue
            state, counts = _told((r[1], r[2]) for r in group)
            ids, nulls, lengths, words, stream = unpacked(state)
            order, _ = in_order(Block(len(words), stream, lengths, words).keys(), buckets)
            own = np.empty((2, len(order)), np.int64)
            own[:, order] = counts
            w = len(words)
            yield as_batch([(block, packed(ids, nulls, lengths, stream, own[0, :w], own[0, w:], own[1, :w], own[1, w:]), 0, 0, 0)], GATHERED)

    return told.repartition("block").sortWithinPartitions("block", "part").mapInArrow(run, GATHERED_SCHEMA)


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1), 0)


def estimates(cj: np.ndarray, ck: np.ndarray, cjk: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of the bigram (0 after an unseen context) and of the unigram."""
    return np.divide(cjk, cj, out=np.zeros(len(cj)), where=cj > 0), ck / max(total, 1)


CELLS, COARSE = 512, 64  # steps of a logarithmic scale of bigram and unigram estimates
CELL_SCHEMA = "key long, d double, s2 double, s1 double"


def _scale(p: np.ndarray, steps: int) -> np.ndarray:
    return np.where(p > 0, 1 + np.clip((np.log2(np.maximum(p, 2.0**-40)) + 40) * steps / 40, 0, steps - 1).astype(np.int64), 0)


def maximised(b: np.ndarray, d: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights of each context bucket by expectation-maximisation: p has the three estimates of d held-out tokens each
    in bucket b. A bucket without tokens keeps the start; after an unseen context the bigram has no weight."""
    weights = np.empty((BUCKETS, 3))
    for x in range(BUCKETS):
        own = b == x
        a = np.array([0.0, 0.8, 0.2]) if x == 0 else np.array([0.5, 0.4, 0.1])
        for _ in range(500 if own.any() else 0):
            share = p[own] * a
            new = (share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300) * d[own, None]).sum(axis=0) / d[own].sum()
            done = np.abs(new - a).max() < 1e-9
            a = new
            if done:
                break
        a = np.maximum(a, [0.0 if x == 0 else 1e-6, 1e-6, 1e-6])
        weights[x] = a / a.sum()
    return weights


def learn(blocks_: DataFrame, total: int, types: int) -> np.ndarray:
    """Weights by context bucket from the blocks of the held-out fold, with counts less their own.

    Tokens are summed over cells of (context bucket, bigram estimate, unigram estimate) of bounded number, each with
    its mean estimates; expectation-maximisation runs over the cells.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (x for batch in batches for x in batch.column(0).to_pylist()):
            _, _, lengths, stream, word, pair, dev_word, dev_pair = unpacked(data)
            own, word, pair = Block(len(word), stream, lengths), word - dev_word, pair - dev_pair
            cj = word[own.j]
            p2, p1 = estimates(cj, word[own.k], pair, total)
            d = np.bincount(own.pair, minlength=len(pair)).astype(np.float64)
            key = (context_bucket(cj) * (CELLS + 1) + _scale(p2, CELLS)) * (COARSE + 1) + _scale(p1, COARSE)
            keys, at = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.bincount(at, x)) for x in (d, d * p2, d * p1))], ["key", "d", "s2", "s1"])

    found = blocks_.select("data").mapInArrow(cells, CELL_SCHEMA).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("d", "s2", "s1")])
    key, d, s2, s1 = (c.to_numpy() for c in found.orderBy("key").toArrow().columns)
    return maximised(key // ((CELLS + 1) * (COARSE + 1)), d, np.column_stack([s2 / d, s1 / d, np.full(len(d), 1.0 / (types + 1))]))


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES, fan: int = FAN, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Null and blank texts are an end alone; a null id counts as an empty one for its fold; equal rows give equal rows; a
    long text is scored whole, in a block of its own; an empty table gives an empty result; without training documents
    every count is 0. Columns other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id").cast("long").alias("part"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    levels = units(buckets, fan)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, texts in enumerate(blocks(batches, block_bytes)):
            words, stream = texts.numbered()
            lengths = np.array(texts.lengths)
            own = Block(len(words), stream, lengths, words)
            train = (np.array(texts.parts) != TEST)[own.doc].astype(np.float64)
            n = np.r_[np.bincount(stream, train, len(words)), np.bincount(own.pair, train, len(own.j))].astype(np.int64)
            dev = texts.parts[0] == DEV
            block = (TaskContext.get().partitionId() << 32 | number) << 1 | dev
            state = packed(np.array([x or 0 for x in texts.ids]), np.array([x is None for x in texts.ids], np.int64), lengths, words, stream)
            keys = own.keys()
            order, b = in_order(keys, buckets)
            yield as_batch([(STATE - block % buckets, block, state)], ASKED)
            for one in dealt(block, keys[order], b, levels[0], n[order], n[order] * dev):
                yield as_batch([one], ASKED)

    told = answered(docs.mapInArrow(read, ASKED_SCHEMA), buckets, levels, chunk_keys)
    all_blocks = stored(gathered(told, buckets), "blocks")
    sums = all_blocks.where("block = -1").agg(F.sum("types"), F.sum("tokens"), F.sum("dev")).first()
    types, total, dev_total = (x or 0 for x in sums)
    weights = learn(all_blocks.where("block >= 0 AND block % 2 = 1"), total - dev_total, types)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (x for batch in batches for x in batch.column(0).to_pylist()):
            ids, nulls, lengths, stream, word, pair, _, _ = unpacked(data)
            own = Block(len(word), stream, lengths)
            cj = word[own.j]
            p2, p1 = estimates(cj, word[own.k], pair, total)
            a = weights[context_bucket(cj)]
            log = np.log10(a[:, 0] * p2 + a[:, 1] * p1 + a[:, 2] / (types + 1))
            base = np.log10((word + 1) / (total + types + 1))
            sums = [np.bincount(own.doc, x) for x in ((word > 0)[stream], base[stream], log[own.pair])]
            cols = [pa.array(ids, mask=nulls.astype(bool)), pa.array(lengths), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = all_blocks.where("block >= 0").select("data").mapInArrow(finish, RESULT)
    return out.select("doc_id", (fold("doc_id") == TEST).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


@tidy
def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_deleted_interpolation": op2_deleted_interpolation}
ORACLES: dict[str, str] = {}
