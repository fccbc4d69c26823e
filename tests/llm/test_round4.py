"""Passages whose seeds many texts hold, who is listed with a passage, and fits of the kinds of personal data."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.llm import chaining, pii
from tests.llm.test_operators import joined


@pytest.mark.parametrize("block", [8, 1024])
def test_texts_that_no_head_is_like_still_meet(spark, monkeypatch, block):
    """Sixty texts hold a line of 30 words; behind it, ten pairs share 24 words of which every fourth differs, so no seed."""
    monkeypatch.setattr(chaining, "BLOCK", block)
    rng = np.random.default_rng(31)
    line, texts_ = [f"line{i}" for i in range(30)], []
    for k in range(10):
        texts_ += [joined(rng, 20, line, *[x for i in range(6) for x in ([f"own{k}-{i}-{m}" for m in range(3)], 1)], 20) for _ in range(2)]
    texts_ += [joined(rng, 20, line, 40) for _ in range(40)]
    order = rng.permutation(len(texts_)).tolist()
    df = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts_)], "doc_id long, text string")
    got = {frozenset((r.doc_id, r.other_id)) for r in chaining.shared_passages(df).collect()}
    assert got == {frozenset((order[2 * k], order[2 * k + 1])) for k in range(10)}


def test_a_seed_of_two_texts_counts_with_those_of_many(spark):
    """One seed is theirs alone, the others those of lines that many texts hold."""
    rng = np.random.default_rng(32)
    lines = [[f"part{k}-{i}" for i in range(10)] for k in range(4)]
    texts_ = [joined(rng, 15, x, 15) for x in lines for _ in range(20)]
    gap = lambda: [f"x{v}" for v in rng.integers(0, 1 << 40, 2)]
    own = [f"rare{i}" for i in range(9)]
    both = [joined(rng, 20, lines[0], gap(), lines[1], gap(), own, gap(), lines[2], gap(), lines[3], 20) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts_ + both)), "doc_id long, text string")
    got = [r for r in chaining.shared_passages(df).collect() if {r.doc_id, r.other_id} == {80, 81}]
    assert got and max(r.words for r in got) == 49


def test_every_document_with_a_passage_is_listed(spark, tmp_path):
    rng = np.random.default_rng(33)
    passage = [f"p{i}" for i in range(60)]
    texts_ = [joined(rng, 30, passage, 10) for _ in range(20)] + [joined(rng, 100) for _ in range(20)]
    spark.createDataFrame(list(enumerate([*texts_, texts_[0]])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = chaining.op9_chained_passages(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {*range(20), 40}
    assert {(r.doc_id, r.start_word, r.other_id, r.other_start) for r in got if r.kind == "passage"} == {(r.other_id, r.other_start, r.doc_id, r.start_word) for r in got if r.kind == "passage"}


def test_kinds_are_fitted_one_after_another(spark, monkeypatch):
    """The driver holds plans, tasks and code of one kind's fit at a time."""
    running, most = [], []

    def fit(rows, held, settings):
        running.append(1)
        time.sleep(0.3)
        most.append(len(running))
        running.pop()
        return most[-1], None, 0.5

    monkeypatch.setattr(pii, "fit", fit)
    df = spark.createDataFrame([(0, "mail jo@mail.com or call +44 123 456 7890")], "doc_id long, text string").withColumn("base", pii.base_spans(F.col("text")))
    assert list(pii.trained(df, pii.Settings(drawn_spans=5))) == list(pii.KINDS) and most == [1] * 4
