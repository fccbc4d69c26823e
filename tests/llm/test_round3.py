"""Spelling variants, repeated substrings and whitening against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlight.llm import common, permuterm, prefix_doubling, whitening

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(permuterm.UPPER, permuterm.LOWER)


def edits_apart(a, b):
    """True where one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, damage=97):
    n = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if edits_apart(w, x)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root)
    return out


def word_rows():
    rng = np.random.default_rng(3)
    base = ["hello", "yellow", "bookkeeper", "aaaaa", "aaaaaa", "aaaaaaa", "Straße", "naïveté", "ÀÉÎÕÜ", "résumé", "colour", "color", "colors", "colours", "mississippi"]
    letters = "abcdeéß"
    found = []
    for i in range(400):
        words = []
        for w in rng.choice(base, 12, p=np.arange(len(base), 0, -1) / sum(range(len(base) + 1))):
            k, c = int(rng.integers(len(w))), letters[int(rng.integers(len(letters)))]
            words.append([w, w, w.upper(), w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]][int(rng.integers(6))])
        found.append((i, ", ".join(words)))
    return found + [(None, "hello hello helloo"), (400, None), (401, ""), (402, "hello " * 5000), (5, found[5][1]), (5, found[5][1]), (403, "$hello$ x1y22hello_yellow")]


@pytest.mark.parametrize("damage", [97, 5])
def test_variants(spark, damage):
    rows = word_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "root")}).repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in permuterm.variants(docs, permuterm.Variants(damage=damage)).collect()}
    want = plain_variants(rows, damage)
    assert got == want and len(want) > 40 and any(v[4] != (v[2] or k) for k, v in want.items())


def test_variants_of_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "to be or not"), (None, "")], "doc_id long, text string")
    assert permuterm.variants(docs).count() == 0 and permuterm.variants(docs.limit(0)).count() == 0


def plain_removal(rows):
    """(doc_id, bytes removed, spans, hash) of each row, by the set of all strings of smaller ids."""
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append((t or "").encode())
    seen, out = set(), []
    for i in sorted(x for x in texts if x is not None):
        for t in texts[i]:
            gone = np.zeros(len(t), bool)
            for p in range(len(t) - 49):
                if t[p:p + 50] in seen:
                    gone[p:p + 50] = True
            spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
            out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
        for t in texts[i]:
            seen |= {t[p:p + 50] for p in range(len(t) - 49)}
    return sorted(out + [(None, len(t), 0, 0, hashlib.sha256(t).hexdigest()) for t in texts[None]], key=repr)


def text_rows():
    rng = np.random.default_rng(8)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{'é' if i % 9 == 0 else 'wo'}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(words, n))
    shared = [make(int(n)) for n in (9, 10, 11, 12, 13, 20, 40, 100, 300)]
    found = []
    for i in range(120):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            s = shared[int(rng.integers(len(shared)))]
            k = int(rng.integers(len(s)))
            parts += [make(int(rng.integers(0, 30))), [s, s[k:], s[:k], s[:k] + "#" + s[k:]][int(rng.integers(4))]]
        found.append((int(rng.integers(1000)), "".join(parts)))
    copies = [(2000 + i, found[3][1]) for i in range(30)]
    edges = ["", None, "x" * 49, "x" * 50, "x" * 51, "x" * 400, "xy" * 100, "yx" * 30, "z" * 50, make(5000), shared[7][:50], shared[7][-50:], "a" + shared[7][:49]]
    return found + copies + [(5000 + i, t) for i, t in enumerate(edges * 2)] + [(7, make(50) + shared[8])] * 3 + [(8, shared[8] + make(3)), (8, shared[8] + shared[7])] + [(None, shared[8]), (None, None), (-5, shared[6])]


@pytest.mark.parametrize("how", [prefix_doubling.Blocks(), prefix_doubling.Blocks(3000, 20_000, 500, 4), prefix_doubling.Blocks(300, 2000, 100, 1)])
def test_repeated_substrings(spark, how):
    rows = text_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "data", "ids", "_t")}).repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.data).hexdigest()) for r in prefix_doubling.kept_texts(docs, how).collect()]
    want = plain_removal(rows)
    assert sorted(got, key=repr) == want and sum(r[3] > 1 for r in want) > 20


def test_one_id_with_most_rows(spark):
    rows = [(9, f"{i} " + "the same passage of an id that has many rows of its own, again and again " * 3) for i in range(200)] + [(10, "the same passage of an id that has many rows of its own"), (8, "no such thing")]
    got = prefix_doubling.kept_texts(spark.createDataFrame(rows, "doc_id long, text string"), prefix_doubling.Blocks(2000, 8000, 100, 4)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.data).hexdigest()) for r in got), key=repr) == plain_removal(rows)


def test_no_texts(spark):
    for rows in ([], [(None, None)], [(1, None)], [(1, "short")]):
        got = prefix_doubling.kept_texts(spark.createDataFrame(rows, "doc_id long, text string"))
        assert [(r.n_removed, r.n_spans) for r in got.collect()] == [(0, 0)] * len(rows)


def test_names_of_positions():
    """Equal windows choose equal places, every window has one, and names tell windows apart as their bytes do."""
    rng = np.random.default_rng(4)
    data = "".join(rng.choice(["ab", "c", "abc ", "d"], 4000)).encode()
    block = prefix_doubling.Block(np.array([1000, 0, 30, len(data) - 1030]), data)
    place, _, first, last = prefix_doubling.chosen(block.symbols)
    assert all((first <= place) & (place <= last + prefix_doubling.LEFT))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    sizes = [1000, 30, len(data) - 1030]
    assert len(covered) == len(set(covered)) == sum(max(0, n - 49) for n in sizes)
    names = prefix_doubling.window_names(block.symbols)
    by_name, by_bytes = {}, {}
    for p in covered:
        by_name.setdefault(names[p], set()).add(block.symbols[p:p + 50].tobytes())
        by_bytes.setdefault(block.symbols[p:p + 50].tobytes(), set()).add(names[p])
    assert all(len(x) == 1 for x in [*by_name.values(), *by_bytes.values()])


def vectors():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(700, 24)) * np.linspace(2, 0.3, 24)) @ rng.normal(size=(24, 24))
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [rows[5], (None, rows[6][1])]
    return rows + [(2000, None), (2001, []), (2002, [1.0] * 23 + [None]), (2003, [float("nan")] * 24), (2004, [float("inf")] + [0.0] * 23), (2005, [1.0] * 5)]


def test_whitening(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("x", "n", "component", "label")}).repartition(7)
    got = whitening.whitened(table).toPandas()
    ok = [(i, v) for i, v in rows if v and len(v) == 24 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64.0 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in ok])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:16], vecs[:, ::-1][:, :16]
    assert len(got) == 16 * len(ok) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    want = (x - s / n) @ vecs / np.sqrt(values)
    dev = {(i, str(v)): int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True))) for (i, v), r in zip(ok, x, strict=True)}
    assert sorted(got.deviation) == sorted(d for (i, v) in ok for d in [dev[i, str(v)]] * 16)
    for c in range(16):
        part = got[got.component == c + 1]
        assert part.explained.iloc[0] == pytest.approx(values[c] / np.trace(centred.T @ centred / n), rel=1e-9)
        ours = part.dropna(subset=["vec_id"]).drop_duplicates("vec_id").set_index("vec_id").whitened
        theirs = {i: w for (i, _), w in zip(ok, want[:, c], strict=True) if i is not None}
        sign = np.sign(ours[0] * theirs[0])
        assert all(abs(sign * ours[i] - w) < 1e-8 for i, w in theirs.items())


def test_whitening_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows, some in (([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0), ([(1, [1.0, 2.0, 3.0]), (2, [1.5, 2.0, 3.0])], 1), ([(1, [2.0]), (2, [3.0]), (3, [7.0])], 1)):
        got = whitening.whitened(spark.createDataFrame(rows, schema)).toPandas()
        assert len(got) == some * len(rows) and (not some or got.identity_error.max() < 1e-9)


def test_whitening_of_large_entries(spark):
    rows = [(i, [float(3 * 10**12 + i * i * 10**9), float(i)]) for i in range(5)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 and all(r.deviation is None for r in got)


@pytest.mark.parametrize("kind", ["random", "graded", "identity", "deficient", "clusters", "nearly"])
def test_qd_solver(kind):
    rng = np.random.default_rng(9)
    for d in (1, 2, 3, 16, 40):
        m = rng.normal(size=(d, d))
        m = {"random": m, "graded": np.triu(m) * np.logspace(0, -8, d), "identity": np.eye(d), "deficient": m * (np.arange(d) >= d // 2),
             "clusters": np.linalg.qr(m)[0] @ np.diag(np.r_[np.full(d // 2, 3.0), np.full(d - d // 2, 1.0)]), "nearly": np.diag(rng.integers(1, 3, d).astype(float)) + 1e-9 * m}[kind]
        values, vecs = whitening.directions(m, 16)
        true = np.linalg.svd(m, compute_uv=False) ** 2
        assert np.allclose(values, true, rtol=1e-9, atol=1e-13 * true[0])
        some = values[:vecs.shape[1]] > 1e-12 * true[0]
        v = vecs[:, some]
        assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11 and np.abs(m.T @ m @ v - v * values[:len(some)][some]).max() < 1e-11 * true[0]


def test_arrays_are_broadcast_by_their_entries(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [])], "k long, x array<int>")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(common.broadcast_arrays(df, "x", 3)) and not hinted(common.broadcast_arrays(df, "x", 2)) and hinted(common.broadcast_arrays(df.limit(0), "x"))
