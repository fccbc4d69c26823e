"""Near copies by sketches, and mixing by narrow rows, against plain counts."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.llm import mixing, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_least_agreeing_is_the_tail_of_the_binomial():
    m = simhash.least_agreeing(0.8)
    tail = lambda upto: sum(math.comb(80, k) * 0.8**k * 0.2 ** (80 - k) for k in range(upto))
    assert tail(m) < simhash.SET_ASIDE <= tail(m + 1)


def test_sketches_keep_every_similar_pair(spark):
    rng = np.random.default_rng(3)
    texts, n = [], 60
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 12 + 5 * i)]
        changed = list(words)
        changed[len(words) // 2 :] = changed[len(words) // 2 + 1 :] if i % 2 else changed[len(words) // 2 :]
        texts += [words, changed[: max(6, int(len(words) * 0.97))]]
    sets = [set(zip(*(t[k:] for k in range(5)), strict=False)) for t in texts]
    docs = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, th long, text string")
    first = simhash.marks(docs, 5)
    pairs = [(i, j) for i in range(2 * n) for j in (i + 1, i + 2) if j < 2 * n]
    got = {tuple(r) for r in simhash.promising(spark.createDataFrame(pairs, "a long, b long"), first, 0.8).collect()}
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(near) > 20 and near <= got
    assert not {(a, b) for a, b in got if not sets[a] & sets[b]}


@pytest.mark.parametrize("sizes", [[5000, 40, 900, 0, 7], [30, 30], [100_000]])
def test_slots_are_whole_passes_over_blocks(spark, sizes):
    plan = mixing.Plan([f"s{i}" for i in range(len(sizes))], sizes, 8)
    got = collections.Counter((r.source_no, r.block) for r in mixing.slots(spark, plan, shard_blocks=64).collect())
    for no, (blocks, quota) in enumerate(zip(plan.blocks, plan.quotas, strict=True)):
        times = sorted(got[no, b] for b in range(blocks))
        assert sum(times) == quota
        assert not times or times == sorted(quota // blocks + (b < quota % blocks) for b in range(blocks))


def test_taken_is_the_sum_over_the_parts_of_a_text(spark):
    texts = [" ".join(["word"] * n) for n in (300, 5, 0, 77, 1200, 16, 33)]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sized = docs.select("doc_id", "source", F.size(F.filter(F.split("text", " "), lambda x: x != "")).cast("long").alias("_size"), F.xxhash64("text").alias("_tie"))
    plan, placed = mixing.place(sized, block=16)
    often = collections.Counter((r.source_no, r.block) for r in mixing.slots(spark, plan).collect())
    want = {r.doc_id: sum(often[r.source_no, w // 16] for w in range(r.offset, r.offset + r["_size"])) for r in placed.collect()}
    assert {r.doc_id: r.taken for r in mixing.mix(docs, block=16).collect()} == want


def test_equal_rows_and_clashing_columns_are_mixed_whole(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, long, "a", 1, {"k": "x"})] * 3 + [(1, long, "a", 2, None), (None, long, None, 3, None), (2, None, "a", 4, None), (3, " \n", "b", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `_own` int, `_parts` map<string,string>")
    taken = collections.Counter()
    for r in mixing.mix(docs, block=16).collect():
        taken[r.doc_id] += r.taken
    got, parts = mixing.mixed_documents(docs, block=16), collections.Counter()
    assert got.columns == docs.columns
    for r in got.collect():
        parts[r.doc_id] += len(WORD.findall(r.text))
        assert r["_own"] in ((1, 2) if r.doc_id == 1 else (3,))
    assert dict(parts) == {k: v for k, v in taken.items() if v}
