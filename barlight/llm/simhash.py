"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits share a partition, each partition has its own threshold (the thresholds sum to
``distance - partitions + 1``, -1 skips a partition), dynamic programming picks them on estimated
candidate counts, and every candidate is verified on the whole fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import components, discard, maybe_broadcast, stored, tidy, tucked, untucked

BITS, SEED = 64, 42
#: A bucket of more fingerprints is dealt out as pairs of blocks of this size.
BLOCK = 1024


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles, A-Z lower-cased: XXH64 with seed 42, a bit is set if over half the hashes have it."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) < width:
        grams = [b" ".join(found)]
    else:
        grams = map(b" ".join, zip(*(found[k:] for k in range(width)), strict=False))
    raw = np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    counts, step = np.zeros(BITS, np.int64), 1 << 16
    for at in range(0, len(raw), step):
        counts += np.unpackbits(raw[at : at + step], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are set together: 64 x 64 sums, whatever the input."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        n = 0
        for f in frames:
            raw = f.fp.to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1)[:, ::-1].astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pd.DataFrame({"pos": np.arange(BITS * BITS + 1), "v": np.append(total.ravel(), n)})

    got = fps.select("fp").mapInPandas(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros(BITS * BITS + 1)
    sums[got.pos] = got.v
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the bits into groups of nearly one size; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        out.append(sorted(group))
        left -= set(group)
    return out


def part_value(bits: list[int]):
    """The bits of column fp that a partition holds, packed into a long."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def close_share(differ: np.ndarray, most: int) -> float:
    """Chance that at most so many of independent bits differ."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return float(dist.sum())


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 or more, one a partition, of the given sum and least cost; cost[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, x in enumerate(row, start=-1):
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*chosen, t])
        best = nxt
    return best[total]


def plan_probe(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """Partitions with thresholds for a self-join of all fingerprints: the cheapest over 2 to 4 partitions."""
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    layouts = {m: correlated_parts(n, both, m) for m in range(2, min(4, distance + 1) + 1)}
    # pairs that agree on a partition, of all layouts in one pass
    parts = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), part_value(g).alias("v")) for m, groups in layouts.items() for i, g in enumerate(groups)]
    each = fps.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.m", "p.i", "p.v").count()
    same = dict.fromkeys(((m, i) for m, groups in layouts.items() for i in range(len(groups))), 0.0)
    same |= {(r.m, r.i): r.pairs for r in each.groupBy("m", "i").agg(F.sum(F.col("count").cast("double") ** 2).alias("pairs")).collect()}
    choices = []
    for m, groups in layouts.items():
        cost = []
        for i, g in enumerate(groups):
            scale = same[m, i] / max(n * n * close_share(differ[g], 0), 1e-9)
            row, signatures = [0.0], 0.0
            for t in range(0, distance - m + 2 + m):
                signatures += float(np.prod([(len(g) - k) / (k + 1) for k in range(t)]))
                candidates = same[m, i] if t == 0 else min(n * n * close_share(differ[g], t) * max(scale, 1), n * n)
                row.append(0.05 * candidates + n * (signatures + 1))
            cost.append(row[: distance + 2])
        choices.append((*allocate(cost, distance - m + 1), m))
    _, thresholds, m = min(choices, key=lambda x: (x[0], x[2]))
    return [(g, t) for g, t in zip(layouts[m], thresholds, strict=True) if t >= 0]


def masks(bits: int, most: int) -> list[int]:
    out = [0]
    for _ in range(most):
        out = sorted({x | 1 << k for x in out for k in range(bits)} | set(out))
    return out


def link_in_buckets(keyed: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that span, within each bucket of (part, key, i, j), the fingerprints at most so far apart."""

    def link(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        end = np.repeat(np.r_[cuts[1:], len(key)], np.diff(np.r_[cuts, len(key)]))
        root, a, b = np.arange(len(fp)), [], []
        at, d = np.arange(len(fp)), 1
        while len(at := at[at + d < end[at]]):
            x = at[(np.bitwise_count(fp[at] ^ fp[at + d]) <= distance)]
            x = x[(root[x] != root[x + d]) & (fp[x] != fp[x + d])]
            for i in x.tolist():
                r, s = i, i + d
                while root[r] != r:
                    r = root[r]
                while root[s] != s:
                    s = root[s]
                if r != s:
                    root[max(r, s)] = min(r, s)
                    a.append(i)
                    b.append(i + d)
            if len(x):
                while (root[root] != root).any():
                    root = root[root]
            d += 1
        return fp[a], fp[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for batch in _with_end(batches):
            if batch is not None:
                key = np.vstack([key, np.column_stack([batch.column(c).to_numpy() for c in range(4)])])
                fp = np.r_[fp, batch.column(4).to_numpy().view(np.uint64)]
            last = len(fp) if batch is None else int(np.searchsorted((key != key[-1]).any(axis=1)[::-1], True)) if len(fp) else 0
            cut = len(fp) if batch is None else len(fp) - last
            if cut:
                a, b = link(key[:cut], fp[:cut])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                key, fp = key[cut:], fp[cut:]

    grouped = keyed.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    return grouped.select("part", "key", "i", "j", "fp").mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(fps: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges between distinct fingerprints of column fp that connect all that are at most `distance` bits apart.

    A bucket with more than `block` fingerprints is dealt out: each pair of its blocks is a task of its own, so
    no bucket lands in one task and no pair is lost; what a bucket gives is a spanning forest, not its pairs.
    """
    plan = plan_probe(fps, distance)
    probes = None
    for i, (bits, t) in enumerate(plan):
        value = part_value(bits)
        if t:
            value = F.explode(F.transform(F.array(*[F.lit(x) for x in masks(len(bits), t)]), lambda x, v=value: v.bitwiseXOR(x.cast("long"))))
        one = fps.select(F.lit(i).cast("long").alias("part"), value.alias("key"), "fp")
        probes = one if probes is None else probes.union(one)
    hot = probes.groupBy("part", "key").count().where(F.col("count") > block)
    hot = stored(hot.select("part", "key", F.ceil(F.col("count") / block).alias("blocks")), "hot")
    n = hot.count()
    zero = F.lit(0).cast("long")
    joined = probes.join(maybe_broadcast(hot, n), ["part", "key"], "left") if n else probes.withColumn("blocks", F.lit(None).cast("long"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    calm = joined.where("blocks is null").select("part", "key", zero.alias("i"), zero.alias("j"), "fp")
    if n:
        dealt = joined.where("blocks is not null").withColumn("own", own)
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        calm = calm.union(dealt.select("part", "key", F.least("own", "other"), F.greatest("own", "other"), "fp"))
    return link_in_buckets(calm, distance)


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fp, fingerprint (hex), component_id (least doc_id that links reach) for every row of docs.

    Null and blank texts have fingerprint zero and link like any other; equal rows stay separate rows; a text of
    fewer words than a shingle is one shingle; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    by_doc = stored(fingerprints(docs, width), "fingerprints")
    fps = stored(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(links(fps, distance))
    linked = fps.join(found, fps.fp == found.node).groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = found.join(linked, "root").select(F.col("node").alias("fp"), "least_id")
    named = stored(fps.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "named")
    discard(spark, fps)
    return by_doc.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SKETCH, BAND = 80, 5  # minima of a text, and how many make a band: 16 bands, 0.998 of pairs at 0.8 share one
#: A bucket of more texts is dealt out as pairs of blocks of this size; a task holds the shingles of two blocks.
TEXT_BLOCK = 256
#: Chance that a pair of the least similarity is set aside by its sketches.
SET_ASIDE = 1e-9


def _raw_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles with repeats, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    grams = [b" ".join(found)] if len(found) < width else map(b" ".join, zip(*(found[k:] for k in range(width)), strict=False))
    return np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the word shingles."""
    return np.unique(_raw_hashes(text, width))


def _majority(raw: np.ndarray) -> int:
    """Fingerprint of the hashes: a bit is set if over half of them have it."""
    counts, digests, step = np.zeros(BITS, np.int64), raw.view(np.uint8).reshape(-1, 8), 1 << 16
    for at in range(0, len(digests), step):
        counts += np.unpackbits(digests[at : at + step], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def marks(own: DataFrame, width: int) -> DataFrame:
    """doc_id, th and what near copies are looked for by, in one pass over the texts: fp, n (distinct shingles), keys (a hash
    for each band of minima) and sketch (16 bits of each minimum). Whole texts stay where they are."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
    mix = rng.integers(1, 1 << 63, BAND, np.uint64) * np.uint64(2) + np.uint64(1)
    spread = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, keys, sketches = [], [], [], []
            for text in batch.column(2):
                raw = _raw_hashes(text.as_py(), width)
                h = np.unique(raw)
                fps.append(_majority(raw))
                sizes.append(len(h))
                banded, sketch = np.empty(0, np.uint64), b""
                if len(h):
                    h ^= h >> np.uint64(29)
                    low = np.minimum.reduce([(h[at : at + 4096, None] * factors).min(axis=0) for at in range(0, len(h), 4096)])
                    banded = ((low >> np.uint64(7)).reshape(-1, BAND) * mix).sum(axis=1, dtype=np.uint64)
                    banded ^= np.arange(len(banded), dtype=np.uint64) << np.uint64(58)
                    sketch = ((low * spread) >> np.uint64(48)).astype("<u2").tobytes()
                keys.append(banded.view(np.int64))
                sketches.append(sketch)
            columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                       pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "fp", "n", "keys", "sketch"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, fp long, n int, keys array<long>, sketch binary")


def least_agreeing(least: float) -> int:
    """Minima of two sketches that agree at least, but for a chance of SET_ASIDE, if the texts are so similar."""
    below, m = 0.0, 0
    while (below := below + math.comb(SKETCH, m) * least**m * (1 - least) ** (SKETCH - m)) < SET_ASIDE:
        m += 1
    return m


def _agree(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, least: float, agreeing: int) -> np.ndarray:
    """Whether sketches and numbers of shingles allow the similarity."""
    return ((x == y).sum(axis=-1) >= agreeing) & (np.minimum(n_x, n_y) >= least * np.maximum(n_x, n_y))


def _minima(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), "<u2").reshape(-1, SKETCH)


def promising(pairs: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity; all others are less similar (SET_ASIDE)."""
    agreeing = least_agreeing(least)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = _agree(_minima(f.sketch_a), _minima(f.sketch_b), f.n_a.to_numpy(), f.n_b.to_numpy(), least, agreeing)
            yield f.loc[ok, ["a", "b"]]

    side = lambda x: first.where("n > 0").select(F.col("th").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def texts_of(own: DataFrame, first: DataFrame, wanted: DataFrame) -> DataFrame:
    """th and text, a row for each of the wanted th; only rows of the least id are moved, so exact copies stay."""
    wanted = stored(first.join(wanted.distinct(), "th", "left_semi").select(F.col("th").alias("_th"), "first_id"), "wanted")
    found = own.join(maybe_broadcast(wanted, wanted.count()), (own.th == F.col("_th")) & own.doc_id.eqNullSafe(F.col("first_id")), "left_semi")
    return stored(found.select("th", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["th"]), "wanted-texts")


def similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of texts whose shingle sets have at least this Jaccard similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known: dict[int, np.ndarray] = {}
            ok = []
            for a, b, x, y in zip(f.a, f.b, f.text_a, f.text_b, strict=True):
                if a not in known:
                    known = {a: shingle_hashes(x, width)}
                p, q = known[a], shingle_hashes(y, width)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= least * (len(p) + len(q) - both))
            yield f.loc[ok, ["a", "b"]]

    named = lambda side: texts.select(F.col("th").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(named("a"), "a").join(named("b"), "b").mapInPandas(run, "a long, b long")


def candidate_buckets(first: DataFrame, distance: int) -> DataFrame:
    """key and th: the bands of minima, and the components of fingerprints within `distance` bits, of the texts."""
    fps = stored(first.select("fp").distinct(), "distinct")
    named = components(links(fps, distance))
    near = first.select("th", "fp").join(named, F.col("fp") == F.col("node"), "left")
    banded = first.select(F.explode("keys").alias("key"), "th")
    return stored(banded.union(near.select(F.xxhash64(F.coalesce("root", "fp")).alias("key"), "th")), "buckets")


def unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """key, th, root of the buckets that hold texts of several labels and more than the three texts whose pairs the
    heads make; of buckets with the same texts only one, as their pairs are the same."""
    rooted = buckets.join(labels, F.col("th") == F.col("node"), "left").select("key", "th", F.coalesce("root", "th").alias("root"))
    same = [F.bit_xor(F.xxhash64("th", F.lit(salt))).alias(f"s{salt}") for salt in (1, 2)]
    each = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"), *same)
    left = each.where((F.col("n") > 3) & (F.col("least") != F.col("most"))).groupBy("n", "s1", "s2").agg(F.min("key").alias("key"), F.first("n").alias("size"))
    left = stored(left.select("key", "size"), "unsettled-keys")
    return stored(rooted.join(maybe_broadcast(left, left.count()), "key"), "unsettled")


def dealt_out(pending: DataFrame, block: int) -> DataFrame:
    """key, i, j, th, root: every text of a bucket in each pair (i, j) of blocks that its own block is in."""
    zero, blocks = F.lit(0).cast("long"), F.ceil(F.col("size") / block)
    dealt = pending.withColumn("own", F.pmod(F.xxhash64("th"), blocks)).withColumn("other", F.explode(F.sequence(zero, blocks - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "th", "root")


def promising_in_blocks(dealt: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """The rows of dealt_out() that have a partner of another label whose sketch allows the similarity in their blocks."""
    agreeing = least_agreeing(least)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x, n, root = _minima(f.sketch), f.n.to_numpy(), f.root.to_numpy()
        ok = [bool((_agree(x, x[i], n, n[i], least, agreeing) & (root != root[i])).any()) for i in range(len(f))]
        return f.loc[ok, ["key", "i", "j", "th", "root"]]

    sketched = dealt.join(first.where("n > 0").select("th", "n", "sketch"), "th")
    return sketched.groupBy("key", "i", "j").applyInPandas(run, "key long, i long, j long, th long, root long")


def similar_in_buckets(dealt: DataFrame, texts: DataFrame, width: int, least: float, block: int = TEXT_BLOCK) -> DataFrame:
    """Edges (a, b) of at least this similarity that span, with the labels, all such pairs of each bucket.

    Every pair of texts of different labels is compared, unless edges found before already join the two. A bucket
    of more than `block` texts is dealt out as pairs of blocks, so that no bucket lands in one task; rows with a column
    i have been dealt out already.
    """

    def link(th: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.array([len(h) for h in sets])
        end = np.cumsum(size)
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        has, label, out = np.zeros(len(ids) + 1, bool), np.unique(root, return_inverse=True)[1], []
        for i in range(len(th) - 1):
            own = ids[end[i] - size[i] : end[i]]
            has[own] = True
            upto = np.r_[0, np.cumsum(has[ids[end[i] :]])]
            both = np.diff(upto[np.r_[0, end[i + 1 :] - end[i]]])
            has[own] = False
            near = np.flatnonzero((both >= least * (size[i] + size[i + 1 :] - both)) & (label[i + 1 :] != label[i])) + i + 1
            for j in near.tolist():
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    out.append((int(th[i]), int(th[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, th, root, sets = None, [], [], []
        for batch in _with_end(batches):
            columns = [batch.column(c).to_pylist() for c in range(5)] if batch is not None else [[None]] * 5
            texts_ = batch.column(5) if batch is not None else [None]
            out = []
            for key, i, j, t, r, text in zip(*columns, texts_, strict=True):
                if (key, i, j) != now:
                    if len(th) > 1:
                        out += link(np.array(th), np.array(root), sets)
                    now, th, root, sets = (key, i, j), [], [], []
                if text is not None:
                    th.append(t)
                    root.append(r)
                    sets.append(shingle_hashes(text.as_py(), width))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    if "i" not in dealt.columns:
        dealt = dealt_out(dealt, block)
    rows = dealt.join(texts.select("th", "text"), "th").select("key", "i", "j", "th", "root", "text")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def drop_near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, distance: int = 3) -> DataFrame:
    """One row of each group of near copies, that of the least id: texts whose shingle sets are similar, transitively.

    Fingerprints within `distance` bits are candidates, but of texts of similarity 0.8 only some tenth are so close,
    so equal bands of minima add candidates. The texts of a bucket meet two drawn from it first; then, in buckets that this
    leaves in several groups, all pairs of different groups are compared. Sketches of 160 bytes set aside pairs that are
    not so similar; the others are verified on whole texts, and only those texts are moved. Exact copies are one text
    throughout; equal rows are copies too; null texts are copies of each other, and of empty ones; a text of any length is
    one row, and blocks of a bucket hold the shingles of some 512 texts at a time; ties go to the text of least hash; an
    empty table gives an empty result; all columns of docs are kept.
    """
    spark, names = docs.sparkSession, docs.columns
    own = tucked(docs).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    every = stored(marks(own, width), "marks")
    same = [F.any_value(c).alias(c) for c in ("fp", "n", "keys", "sketch")]  # equal for equal texts
    first = stored(every.groupBy("th").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), *same), "texts")
    discard(spark, every)
    buckets = candidate_buckets(first, distance)
    drawn = F.struct(F.xxhash64("th").alias("h"), "th")
    heads = stored(buckets.groupBy("key").agg(F.min(drawn)["th"].alias("a"), F.max(drawn)["th"].alias("z")).where("a <> z"), "heads")
    shared = stored(buckets.join(maybe_broadcast(heads, heads.count()), "key"), "shared")
    discard(spark, buckets)
    near = shared.select(F.explode(F.array("a", "z")).alias("a"), F.col("th").alias("b"))
    pairs = near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(promising(pairs, first, least), "pairs")
    texts = texts_of(own, first, pairs.select(F.explode(F.array("a", "b")).alias("th")))
    edges = stored(similar(pairs, texts, width, least), "similar")
    found = components(edges)
    discard(spark, texts)
    pending = unsettled(shared.select("key", "th"), found)
    dealt = stored(promising_in_blocks(dealt_out(pending, TEXT_BLOCK), first, least), "dealt")
    more = stored(similar_in_buckets(dealt, texts_of(own, first, dealt.select("th")), width, least), "similar-in-buckets")
    if not more.isEmpty():
        found = components(edges.union(more))
    least_id = found.join(first.select(F.col("th").alias("node"), "first_id"), "node").groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("m"))
    later = found.join(least_id, "root").where(F.col("m.node") != F.col("node")).select(F.col("node").alias("th"))
    # most texts are one row that stays: whole texts are dealt anew only where rows share one
    later = stored(later, "later")
    many = first.where("rows > 1").select("th", "first_id")
    touched = stored(later.union(many.select("th")).distinct(), "touched")
    alone = own.join(maybe_broadcast(touched, touched.count()), "th", "left_anti")
    many = stored(many.join(later, "th", "left_anti").select(F.col("th").alias("_th"), "first_id"), "many")
    shared_ = own.join(maybe_broadcast(many, many.count()), (own.th == F.col("_th")) & own.doc_id.eqNullSafe(F.col("first_id")), "left_semi")
    return untucked(alone.select(*own.columns).union(shared_.dropDuplicates(["doc_id", "th"])), names)


@tidy
def op8_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op8_pigeonhole_simhash": op8_pigeonhole_simhash}
ORACLES: dict[str, str] = {}
