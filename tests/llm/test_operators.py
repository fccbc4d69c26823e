"""Corpus operators against brute force on small tables, with nulls, empty and long texts, repeats and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from barlight.llm import chaining, common, compaction, fixity, interpolation, line_quality, media, mixing, packing, pii, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = 2
KINDS = "doc_id long, text string, lang string, source string, n_chars long, base string, th string, n_words string"


def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    own = [make(int(n)) for n in rng.integers(20, 300, 60)]
    passage = make(80)
    own[LONG] = make(200)
    out = own + [own[0], own[0], own[1] + " tail"]
    near = own[LONG].split()
    near[len(near) // 2] = "changed"
    out += [" ".join(near), make(40) + "\n" + passage + "\n" + make(30), make(25) + "\n" + passage + "\n" + make(60)]
    out += [None, "", "  \n\t ", "one", "two words", "of " * 200, make(6000), "a\nb\nb\nc c\n\nb"]
    out += [f"{make(60)}\nSubscribe to our letter {i}\n{make(20)}" for i in range(14)]
    out += ["Mail me at Jo.Doe+x@mail.example.org or 10.0.0.255, 300.1.1.1 and 4111 1111 1111 1111 or +1 (555) 123-4567 x", "é 4111111111111111 4111111111111111 ü@x.de"]
    return out


def rows():
    found = [(i, t, "en", f"s{i % 5}" if i % 3 else "s0", len(t or ""), "x", "y", "z") for i, t in enumerate(texts())]
    found += [found[5], found[5], (None, "a row without an id " * 20, None, None, None, None, None, None)]
    return found


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KINDS).repartition(3).cache()


@pytest.fixture(scope="module")
def unique(docs):
    return docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def plain_counts(text):
    s = text or ""
    w, lines = WORD.findall(s), [x for x in s.split("\n") if WORD.search(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    often = collections.Counter(grams)
    places = {i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(places)


def test_quality_counts(docs):
    got = line_quality.judge(docs).collect()
    assert len(got) == len(rows())
    text = {r[0]: r[1] for r in rows()}
    for r in got:
        want = plain_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_frequent_lines_go(docs):
    limits = line_quality.Limits(line_documents=3, line_share=0.0)
    kept = {r.doc_id: r.text for r in line_quality.cleaned(docs, limits).collect() if r.text and "word" in r.text}
    with_line = [i for i, t in enumerate(texts()) if t and "Subscribe" in t and i % 3 == 0]
    assert len(with_line) >= 3 and all("Subscribe" not in kept[i] for i in with_line if i in kept)


def test_lines_of_pages_of_shared_lines_are_counted_by_document(spark):
    rng = np.random.default_rng(3)
    lines = [f"shared line {'x' * (i + 1)} of the pages of this host" for i in range(60)]
    pages = ["\n".join(lines[k] for k in rng.choice(60, 8, replace=False)) for _ in range(2000)]
    rare = "a line that only copies of one page hold, many times over"
    df = spark.createDataFrame([*[(i, t, "h") for i, t in enumerate(pages)], *[(2000 + i, rare, "h") for i in range(50)]], "doc_id long, text string, source string")
    key = lambda x: df.select(line_quality._key(F.lit(x)).alias("k")).first().k
    got = {r.key for r in line_quality.frequent_lines(df, line_quality.repeated_lines(df)).collect()}
    assert len(got) == 60 and key(rare) not in got
    assert not [r for r in line_quality.judge(df).collect() if r.doc_id < 2000 and r.kept]


def plain_lines(text):
    """Normalised lines of a text and the line each came from."""
    out = []
    for line in (text or "").split("\n"):
        x = re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")
        if x:
            out.append((x, line))
    return out


def plain_quality(table, limits):
    """Of each (id, text, host) row: kept, and the text without the frequent lines of its host."""
    holders, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, host in table:
        lines = tuple(x for x, _ in plain_lines(text))
        hosts[host].add(lines)
        for x in lines:
            holders[host, x].add(lines)
    frequent = {k for k, v in holders.items() if len(v) >= max(limits.line_documents, limits.line_share * len(hosts[k[0]]))}
    out = []
    for doc_id, text, host in table:
        n, _, _, _, again = plain_counts(text)
        gone = [x for x, _ in plain_lines(text) if (host, x) in frequent]
        removed = sum(len(x.split(" ")) for x in gone)
        kept = n >= 50 and 100 * again <= 50 * n and n - removed >= limits.least_kept * n
        lines = [line for line in (text or "").split("\n") if not any((host, x) in frequent for x, _ in plain_lines(line))]
        out.append((doc_id, kept, "\n".join(lines) if gone else text))
    return out


def hosted():
    rng = np.random.default_rng(12)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, n))
    menu = [make(6) + f" item {i}" for i in range(30)]
    out = []
    for i in range(400):
        lines = [make(int(rng.integers(5, 40))).upper() if rng.random() < 0.1 else make(int(rng.integers(5, 40))) for _ in range(int(rng.integers(1, 6)))]
        lines += [f"{menu[k]} {int(rng.integers(0, 99))}" for k in rng.choice(30, int(rng.integers(0, 12)), replace=False)]
        rng.shuffle(lines)
        out.append((i, "\n".join(lines), ["big", "small", None][min(2, int(rng.integers(0, 8)) // 3)]))
    return [*out, *[(400 + i, *out[i][1:]) for i in range(60)], (None, None, "big"), (None, "", None), (None, "", None)]


@pytest.mark.parametrize("limits", [line_quality.Limits(), line_quality.Limits(line_documents=3, line_share=0.1)])
def test_quality_against_plain_rules(spark, limits):
    df = spark.createDataFrame(hosted(), "doc_id long, text string, source string").repartition(4)
    want = plain_quality(hosted(), limits)
    order = lambda x: sorted(x, key=repr)
    assert order((r.doc_id, r.kept) for r in line_quality.judge(df, limits).collect()) == order((i, k) for i, k, _ in want)
    assert order((r.doc_id, r.text) for r in line_quality.cleaned(df, limits).collect()) == order((i, t) for i, k, t in want if k)
    assert 20 < sum(k for _, k, _ in want) < len(want) - 20


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), list(PLAIN).index(kind), kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_against_plain_patterns(spark, docs):
    rng = np.random.default_rng(4)
    bits = ["a@b.de", "x.y+z@mail-1.example.org", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+49 30 1234567", "+1", "é", "@", ".", "-", " ", "7", "12", "word", "\n", "a@b", "%"]
    made = [("".join(rng.choice(bits, int(rng.integers(1, 12))))) for _ in range(600)] + ["1" * 40, "1.1." * 30, "+1 " * 40, "a@b." * 20 + "c", None, ""]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in df.select("text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect():
        assert [(x.kind, x.start, x.end) for x in r.b] == plain_base(r.text), r.text


def planted():
    """Texts with spans that no strict pattern takes, as (text, spans), and clean ones with near misses."""
    rng = np.random.default_rng(21)
    words = [f"{a}{b}" for a in ("lo", "ka", "mi", "ter", "so", "un") for b in ("ra", "nel", "sto", "ig", "vem")]
    prose = lambda n: " ".join(rng.choice(words, n))
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    card = lambda: next(x for x in iter(lambda: "4" + d(15), None) if plain_base(x))
    name = lambda: f"{rng.choice(words)}{rng.choice(['.', '_', ''])}{rng.choice(words)}"
    four = lambda x, by: by.join(x[i : i + 4] for i in range(0, 16, 4))
    hidden = {
        "email": lambda: rng.choice([f"{name()} at {rng.choice(words)} dot org", f"{name()}[at]{rng.choice(words)}[dot]net", f"{name()} (at) {rng.choice(words)} (dot) de"]),
        "phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{rng.integers(200, 999)}-{d(3)}-{d(4)}", f"00 49 {d(3)} {d(3)} {d(4)}"]),
        "card": lambda: rng.choice([four(card(), "."), four(card(), "_"), four(card(), "  ")]),
        "ip": lambda: rng.choice(["[.]", " dot ", " . "]).join(map(str, rng.integers(1, 255, 4))),
    }
    miss = [lambda: f"{rng.integers(1900, 2030)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", lambda: f"1{rng.integers(0, 9)}.0{rng.integers(1, 9)}.{rng.integers(1900, 2030)}", lambda: d(7), lambda: f"{d(4)}.{d(5)}",
            lambda: f"{rng.choice(words)} at {rng.choice(words)}.{str(rng.choice(words)).title()}", lambda: "300.1.2.900", lambda: f"{rng.integers(10, 99)} {rng.integers(100, 999)} {rng.integers(100, 999)}"]
    dirty = []
    for i in range(240):
        kind = list(hidden)[i % 4]
        before, value = prose(12) + " ", str(hidden[kind]())
        while plain_base(before + value):
            value = str(hidden[kind]())
        dirty.append((before + value + " " + prose(8), (kind, len(before), len(before) + len(value))))
    return dirty, [prose(10) + " " + miss[i % len(miss)]() + " " + prose(6) for i in range(140)]


def test_spans_outside_the_strict_patterns_are_found(spark):
    dirty, clean = planted()
    df = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in dirty] + clean)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert not any(r.base for r in got.values())
    hits = collections.Counter(s[0] for i, (_, s) in enumerate(dirty) if s in {(x.kind, x.start, x.end) for x in got[i].spans})
    assert all(hits[k] >= 0.8 * 60 for k in pii.KINDS), hits
    assert sum(bool(got[len(dirty) + i].spans) for i in range(len(clean))) <= 0.05 * len(clean)
    said = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert all(said[i] == t[: s[1]] + f"[{s[0].upper()}]" + t[s[2] :] for i, (t, s) in enumerate(dirty) if len(got[i].spans) == 1 and (got[i].spans[0].kind, got[i].spans[0].start, got[i].spans[0].end) == s)


def test_tests_of_texts_pass_all_matches(spark):
    """No generator's match is lost to the cheap test before it."""
    dirty, clean = planted()
    bits = ["06 12 34 56 78", "jo at mail dot org", "a [at] b.c", "1 . 2 . 3 . 4", "4111.1111.1111.1111", "411111111111", "+1 5551234567", "x(AT)y(DOT)z"]
    texts_ = [t for t, _ in dirty] + clean + bits
    df = spark.createDataFrame([(t,) for t in texts_], "text string")
    for kind, may, pattern in pii.WIDE:
        assert df.where(F.col("text").rlike(pattern) & ~F.col("text").rlike(may)).count() == 0, kind


def test_base_spans(unique):
    got = {r.doc_id: r for r in pii.spans(unique.select("doc_id", "text")).collect()}
    last = max(got)
    assert [(s.kind, s.value) for s in got[last - 1].base] == [("email", "Jo.Doe+x@mail.example.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert [(s.kind, s.start) for s in got[last].base] == []  # two cards in a row are one match of 32 digits
    text = {r[0]: r[1] or "" for r in rows()}
    for r in got.values():
        assert all(text[r.doc_id][s.start : s.end] == s.value for s in r.spans)


def test_base_patterns_do_not_blow_up(spark):
    hard = ["a" * 60_000 + "@", "1" * 60_000, "1 " * 30_000, "+1" + "-" * 60_000, ".1" * 30_000, "a.b@c." * 5_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    assert df.select(F.size(pii.base_spans(F.col("text")))).count() == len(hard)


def test_redaction(unique):
    got = {r.doc_id: r for r in pii.redacted(unique).collect()}
    row = got[max(got) - 1]
    assert row.text.startswith("Mail me at [EMAIL] or [IP], 300.1.1.1 and [CARD] or [PHONE] x") and row.n_chars == len(row.text) and row.base == "x"
    text = {r[0]: r[1] for r in rows()}
    found = {r.doc_id: r.spans for r in pii.spans(unique).collect()}
    for i, r in got.items():
        want, at = "", 0
        for x in found[i]:
            if x.end > at:
                want += (text[i] or "")[at : max(x.start, at)] + (f"[{x.kind.upper()}]" if x.start >= at else "")
                at = x.end
        assert r.text == (want + text[i][at:] if found[i] else text[i])


def plain_components(values, linked):
    label = {i: i for i, _ in values}
    changed = True
    while changed:
        changed = False
        for i, x in values:
            low = min(label[j] for j, y in values if linked(x, y))
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_fingerprints_and_components(unique):
    got = simhash.near_duplicates(unique).collect()
    text = {r[0]: r[1] for r in rows()}
    for r in got:
        w = (text[r.doc_id] or "").encode().lower().split()
        grams = [b" ".join(x) for x in zip(w, w[1:], w[2:], strict=False)] or ([b" ".join(w)] if w else [])
        counts = [sum(xxhash.xxh64_intdigest(g, 42) >> k & 1 for g in grams) for k in range(64)]
        assert r.fingerprint == f"{sum((2 * c > len(grams)) << k for k, c in enumerate(counts)):016x}"
    want = plain_components([(r.doc_id, int(r.fingerprint, 16)) for r in got], lambda x, y: (x ^ y).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in got} == want


def test_dense_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    center = int(rng.integers(1 << 62))
    fps = {center}
    while len(fps) < 300:
        fps.add(center ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(1, 5)), replace=False)))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.links(df, 3, block=32)
    got = {r.node: r.root for r in common.components(edges).collect()}
    values = [(x, x) for x in fps]
    want = plain_components(values, lambda x, y: (x ^ y).bit_count() <= 3)
    groups = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
    assert groups({x: got.get(x, x) for x in fps}) == groups(want)


def test_thresholds_sum_and_cost():
    cost = [[0, 5, 50, 500, 900], [0, 1, 20, 300, 900], [0, 9, 70, 600, 900]]
    total, t = simhash.allocate(cost, 1)
    options = [(sum(c[x + 1] for c, x in zip(cost, y, strict=True)), list(y)) for y in np.ndindex(5, 5, 5) for y in [[v - 1 for v in y]] if sum(y) == 1]
    assert sum(t) == 1 and total == min(o[0] for o in options)


def test_one_of_each_group_of_near_copies_stays(docs):
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    sets = {i: set(zip(*(WORD.findall((t or "").lower())[k:] for k in range(5)), strict=False)) for i, t in enumerate(texts())}
    assert len(ids) == len(set(ids)) and 60 not in ids and 61 not in ids and 0 in ids
    near = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = [i for i in ids if i is not None]
    assert not [(a, b) for a in kept for b in kept if a < b and near(a, b)]
    assert {i for i in sets if len(sets[i]) > 1 and not any(near(i, j) for j in sets if j != i)} <= set(ids)


def test_near_copies_inside_a_template_are_found(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    template, made = draw(200), []
    for i in range(300):
        block = draw(43)
        made.append(template + block)
        if i % 3 == 0:
            made.append(template + block[:23] + draw(20))
    ids = rng.permutation(len(made)).tolist()
    sets = {i: set(zip(*(t[k:] for k in range(5)), strict=False)) for i, t in zip(ids, made, strict=True)}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    linked = [(a, b) for a in ids for b in ids if a < b and near(a, b)]
    assert len(linked) == 100
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, made, strict=True)], "doc_id long, text string")
    kept = [r.doc_id for r in simhash.drop_near_copies(df).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(ids) - {b for _, b in linked})


def test_blocks_of_a_bucket_lose_no_pair(spark):
    long = [[f"w{i}-{k}" for k in range(60)] for i in range(40)]
    texts_ = [*long, *[t[:-2] for t in long], []]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts_)], "th long, text string")
    pending = df.select(F.lit(1).cast("long").alias("key"), "th", F.col("th").alias("root"), F.lit(len(texts_)).cast("long").alias("size"))
    got = simhash.similar_in_buckets(pending, df, 5, 0.8, block=8).distinct().collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} == {(i, i + 40) for i in range(40)}


def test_water_filling():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.water_fill([10, 100, 190], [5, 2, 1]) == pytest.approx([30, 180, 90])


def test_permutations_are_permutations():
    for n in (1, 2, 7, 64, 1000):
        k = np.arange(n)
        assert sorted(mixing.permuted(k, np.full(n, n), np.full(n, 99, np.uint64))) == list(range(n))


def test_mix(docs):
    a, b = (sorted(tuple(r) for r in mixing.mix(docs, block=16).na.fill({"doc_id": -1}).collect()) for _ in range(2))
    assert a == b and len(a) == len(rows())
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    got = mixing.mix(docs, block=16).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert sorted(r.source_size for r in got) == sorted(sizes.values())
    assert all(abs(r.taken - r.target) <= max(32, 0.05 * r.target) for r in got)
    assert all(t <= 3 * s for _, s, _, _, t in a)


def test_mixed_parts_are_the_words_taken(unique):
    taken = {r.doc_id: r.taken for r in mixing.mix(unique, block=16).collect()}
    parts = collections.Counter()
    for r in mixing.mixed_documents(unique, block=16).collect():
        parts[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and r.th == "y"
    assert {k: v for k, v in taken.items() if v} == dict(parts)


def plain_pack(rows, capacity):
    """Best-fit decreasing by looking at every bin: rows are (n, doc_id, tie, piece, source, cluster) in order."""
    bins, out = [], {}
    for n, doc_id, tie, piece, source, cluster in rows:
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and source not in b["sources"] and cluster not in b["clusters"]]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        out[doc_id, tie, piece] = (k, capacity - bins[k]["left"])
        bins[k]["left"] -= n
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
    return out


@pytest.mark.parametrize("near", [False, True])
def test_packing(docs, near):
    clusters = packing.text_clusters(docs) if near else None
    got = packing.pack(docs, capacity=256, shard_pieces=60, clusters=clusters).toPandas()
    full = got[got.bin.notna()]
    sizes = collections.Counter()
    for r in rows():
        sizes[r[0]] += len(WORD.findall(r[1] or ""))
    placed = full.fillna({"doc_id": -1}).groupby("doc_id").n_tokens.sum().to_dict()
    assert placed == {(-1 if k is None else k): v for k, v in sizes.items() if v}
    assert (full.groupby(["shard", "bin"]).n_tokens.sum() <= 256).all()
    assert got.bin.isna().sum() == sum(not WORD.findall(r[1] or "") for r in rows())
    tie = {r.doc_id: r.tie for r in docs.select("doc_id", F.xxhash64("text").alias("tie")).collect()}
    of = {r.tie: r.cluster for r in clusters.collect()} if near else {t: t for t in tie.values()}
    source = {r[0]: r[3] or "\0" for r in rows()}
    ids = [None if x != x else int(x) for x in full.doc_id]
    full = full.assign(doc_id=pd.Series(ids, full.index, object), tie=[tie[x] for x in ids], source=[source[x] for x in ids])
    full = full.assign(cluster=[of[t] for t in full.tie])
    assert not full.duplicated(["shard", "bin", "source"]).any() and not full.duplicated(["shard", "bin", "cluster"]).any()
    for _, f in full.groupby("shard"):
        order = sorted(f.itertuples(), key=lambda r: (-r.n_tokens, r.doc_id is None, r.doc_id or 0, r.tie, r.piece))
        want = plain_pack([(r.n_tokens, r.doc_id, r.tie, r.piece, r.source, r.cluster) for r in order], 256)
        seen = collections.Counter(r.doc_id for r in order)
        assert all(want[r.doc_id, r.tie, r.piece] == (r.bin, r.position) for r in order if max(seen.values()) == 1 or not f.duplicated(["doc_id", "tie", "piece"]).any())


def test_shards_are_of_so_many_pieces(spark):
    long = spark.createDataFrame([(i, "w " * 2000, f"s{i}") for i in range(20)], "doc_id long, text string, source string")
    got = packing.pack(long, capacity=10, shard_pieces=500).groupBy("shard").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) < 700


def test_best_fit_takes_the_tightest_bin():
    f = pd.DataFrame({"doc_id": [1, 2, 3, 4], "piece": 0, "n_tokens": [70, 60, 30, 25], "shard": 0, "source": list("abac"), "cluster": [1, 2, 3, 4], "tie": 0})
    got = packing.pack_shard(f, 100).set_index("doc_id").bin.to_dict()
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}  # 3 would fit bin 0 best but its source is there


def test_media_round_trip(spark, docs):
    path = common.fresh_path(spark, "media")
    media.write_archives(docs, path)
    got = media.digests(media.read_archives(spark, path, split_bytes=4096)).collect()
    assert len(got) == len(rows())
    want = collections.Counter()
    for r in rows():
        data = (r[1] or "").encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        want[r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want


def test_damaged_member_is_named_and_others_come(spark, unique, tmp_path):
    path = f"file://{tmp_path}/media"
    media.write_archives(unique.limit(20).coalesce(1), path)
    file = next(tmp_path.glob("media/*.bma"))
    data = bytearray(file.read_bytes())
    data[media.HEAD_SIZE + 20] ^= 1
    file.write_bytes(data)
    got = media.read_archives(spark, path).collect()
    assert len(got) == 20 and [r.position for r in got if r.error] == [0]


def test_archives_add_up(spark, docs, empty):
    path = common.fresh_path(spark, "media")
    media.write_archives(empty, path)
    assert media.digests(media.read_archives(spark, path)).count() == 0
    media.write_archives(docs.where("doc_id = 3"), path)
    media.write_archives(docs.where("doc_id = 4"), path)
    assert sorted(r.doc_id for r in media.read_archives(spark, path).collect()) == [3, 4]
    media.write_archives(docs.where("doc_id = 7"), path, mode="overwrite")
    assert [r.doc_id for r in media.read_archives(spark, path).collect()] == [7]


def test_a_retry_may_succeed(tmp_path):
    """A member whose first read is damaged comes from the second; its neighbours are read once."""
    import pyarrow as pa
    from pyarrow import fs

    writer = media.ArchiveWriter(f"file://{tmp_path}")
    writer.commit([writer.write(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a", "b", "c"]})]))])
    reader = media.ArchiveReader(f"file://{tmp_path}", 1 << 20, 2, 1 << 20)
    (part,) = reader.partitions()
    opened = []

    class Flaky:
        def __init__(self, f, bad):
            self.f, self.at, self.bad = f, 0, bad

        def seek(self, at):
            self.at = at
            self.f.seek(at)

        def read(self, n):
            data = self.f.read(n)
            return bytes(n) if self.at and self.bad else data

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    class Store:
        open_input_stream = staticmethod(fs.LocalFileSystem().open_input_stream)

        @staticmethod
        def open_input_file(path):
            opened.append(path)
            return Flaky(fs.LocalFileSystem().open_input_file(path), len(opened) == 1)

    name = f"{tmp_path}/{part.archive}"
    offsets = np.frombuffer(open(f"{name}.idx", "rb").read(), "<i8").tolist()
    first = Store.open_input_file(name)
    got = [reader.member(Store, name, at, first) for at in offsets]
    assert [r[0] for r in got] == [1, 2, 3] and not any(r[3] for r in got) and len(opened) == 3


def pages_of(spark, n=2000):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 9)) for i in range(n)] + [(None, None, None)], "page_id long, url string, html string")


def test_fixity(spark):
    records = fixity.archived(pages_of(spark), 100).cache()
    assert fixity.compared(records, records).count() == 0
    got = collections.defaultdict(set)
    for r in fixity.compared(records, fixity.damaged(records)).collect():
        got[r.status].add((r.page_id, r.url))
    mark = {i: hashlib.md5(f"http://h/{i}".encode()).hexdigest()[:2] for i in range(2000)}
    named = lambda *m, tail="": {(i, f"http://h/{i}{tail}") for i in mark if mark[i] in m}
    assert got == {"changed": named("5a", "c3"), "missing": named("e7"), "added": named("f1", tail="#copy")} and all(got.values())


def test_only_differing_branches_are_descended(spark):
    records = fixity.archived(pages_of(spark), 4000)
    one = fixity.leaves(records).cache()
    other = one.withColumn("hash", F.when(F.col("node") == 700, "x").otherwise(F.col("hash")))
    levels = fixity.height(one)
    got = fixity.audit(fixity.tree(one, levels, "a"), fixity.tree(other, levels, "b")).collect()
    assert levels == 3 and [r.node for r in got] == [700]


def test_replicas_of_other_shapes(spark):
    records = fixity.archived(pages_of(spark), 100).cache()
    ids = lambda df: {r.page_id for r in df.collect()}
    gone = {i for i in range(2000) if i % 10 == 3}
    lost = fixity.compared(records, records.where("page_id IS NULL OR page_id % 10 <> 3"))
    assert {r.status for r in lost.collect()} == {"missing"} and ids(lost) == gone
    more = fixity.compared(records.where("page_id IS NULL OR page_id % 10 <> 3"), records)
    assert {r.status for r in more.collect()} == {"added"} and ids(more) == gone
    cut = fixity.compared(records, records.where("page_id < 40"))
    assert ids(cut) == set(range(40, 2000)) | {None}
    no = records.where("archive = 0").select("page_id").collect()
    whole = fixity.compared(records, records.where("archive <> 0"))
    assert ids(whole) == {r.page_id for r in no}
    assert fixity.compared(records, records.limit(0)).count() == 2001 and fixity.compared(records.limit(0), records.limit(0)).count() == 0


def test_equal_records_are_told_apart(spark):
    rows_ = [(1, "u", "same")] * 3 + [(1, "u", "other"), (None, "u", "x" * 300_000)]
    records = fixity.archived(spark.createDataFrame(rows_, "page_id long, url string, html string")).cache()
    assert fixity.compared(records, records).count() == 0
    two = records.where("page_id IS NULL").union(records.where("page_id = 1").dropDuplicates(["record"]))
    assert {r.status for r in fixity.compared(records, two).collect()} <= {"missing", "changed"}


def test_compaction(spark, docs):
    table = compaction.ShardTable(spark, common.fresh_path(spark, "shards"), target=40_000, fanout=2)
    table.append(docs.withColumn("arrival", F.pmod(F.xxhash64("text"), F.lit(4))), "arrival")
    before = table.manifest()
    version = table.compact()
    after = table.manifest()
    assert version > before[0] and len(after[1]) < len(before[1])
    order = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.select("doc_id", "text").collect())
    assert order(table.read()) == order(docs) == order(table.read(before[0]))
    with pytest.raises(FileExistsError):
        table.commit(before[0], before[1])
    assert table.vacuum() and order(table.read()) == order(docs)


def test_compaction_of_odd_tables(spark, docs, empty):
    table = compaction.ShardTable(spark, common.fresh_path(spark, "shards"), fanout=2)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.append(empty)
    assert table.compact() == 1 and table.read().count() == 0 and table.read().columns == docs.columns
    clash = docs.withColumns({c: F.lit(c) for c in ("run_0", "file_0", "_run", "_arrival", "_shard", "_file", "place")})
    table = compaction.ShardTable(spark, common.fresh_path(spark, "shards"), fanout=2)
    for k in range(4):
        table.append(clash.where(F.pmod(F.xxhash64("text"), F.lit(4)) == k).coalesce(1))
    table.compact()
    got = table.read(place="where")
    assert got.columns == [*clash.columns, "where"] and got.count() == docs.count() and {r._run for r in got.collect()} == {"_run"}
    assert {r.merges for r in got.select("where.*").collect()} >= {1}
    with pytest.raises(ValueError, match="place"):
        table.read(place="place")


def plain_runs(sizes, target, fanout):
    """Runs by size tier, written as a loop over all shards."""
    tiers = collections.defaultdict(list)
    for k, s in enumerate(sizes):
        if s < target / 2:
            tiers[int(math.log(max(s, 1), fanout))].append(k)
    out = []
    for t in sorted(tiers):
        run, load = [], 0
        for k in tiers[t]:
            if run and load + sizes[k] > target:
                out.append(run)
                run, load = [], 0
            run.append(k)
            load += sizes[k]
        out.append(run)
    return [r for r in out if len(r) >= fanout]


def test_runs_are_of_one_tier(spark):
    rng = np.random.default_rng(9)
    table = compaction.ShardTable(spark, "file:///none", target=1000, fanout=3)
    for _ in range(30):
        sizes = np.exp(rng.uniform(0, 8, rng.integers(0, 60))).astype(int).tolist()
        shards = [compaction.Shard(str(k), s, 1, 0) for k, s in enumerate(sizes)]
        got = [[int(s.path) for s in r] for r in table.runs(shards)]
        assert got == plain_runs(sizes, 1000, 3)
        assert all(sum(sizes[k] for k in r) <= 1000 and len({int(math.log(max(sizes[k], 1), 3)) for k in r}) == 1 for r in got)


def test_manifest_entries_follow_the_changes(spark, docs):
    table = compaction.ShardTable(spark, common.fresh_path(spark, "shards"))
    shards = [compaction.Shard(f"p{k}", 1, 1, 0) for k in range(90)]
    for k, s in enumerate(shards):
        table.commit(k, [s], schema=docs.schema)
    assert table.manifest()[1] == shards and table.manifest(17)[1] == shards[:17]
    assert sum(len(table._entry(v)["add"]) for v in table.versions()) < 4 * len(shards)


def plain_chain_score(a, b, p):
    best = []
    for i in range(len(a)):
        best.append(max([p.gain] + [best[j] + p.gain - p.gap * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if a[j] < a[i] and b[j] < b[i]]))
    return max(best)


def test_chains_are_best():
    rng, p = np.random.default_rng(3), chaining.Chaining(seeds=1)
    for _ in range(50):
        pairs = sorted(map(tuple, rng.integers(0, 120, (25, 2)).tolist()))
        a, b = [x for x, _ in pairs], [y for _, y in pairs]
        c = chaining.chains(a, b, p)[0]
        got = p.gain * len(c) - p.gap * (a[c[-1]] - a[c[0]] + b[c[-1]] - b[c[0]])
        assert got == pytest.approx(plain_chain_score(a, b, p))
        assert all(a[i] < a[j] and b[i] < b[j] for i, j in zip(c, c[1:], strict=False))


def test_shared_passages(docs):
    got = chaining.shared_passages(docs).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in got if r.kind == "passage"}
    assert frozenset((64, 65)) in pairs and frozenset((63, LONG)) in pairs
    assert {(r.doc_id, r.other_id) for r in got if r.kind == "copy"} >= {(60, 0), (61, 0)}
    shared = {frozenset((a, b)) for a in range(60) for b in range(a)}
    assert not pairs & shared


def joined(rng, *parts):
    """Parts with words of their own between them; a number is so many such words."""
    draw = lambda n: [f"x{v}" for v in rng.integers(0, 1 << 40, n)]
    return " ".join(w for p in parts for w in (draw(p) if isinstance(p, int) else p))


@pytest.mark.parametrize("few", [2, 8])
def test_passages_whose_parts_are_in_earlier_texts(spark, few):
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(80)]
    texts_ = [joined(rng, 30, passage[a : a + 30], 30) for a in (0, 25, 50)] + [joined(rng, 20, passage, 40), joined(rng, 50, passage, 10)]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = [r for r in chaining.shared_passages(df, chaining.Chaining(few=few)).collect() if {r.doc_id, r.other_id} == {3, 4}]
    assert got and max(r.words for r in got) == 80


def test_hot_parts_lose_no_passage(spark):
    """Thirty words that many texts hold, in three kinds; a few texts hold all of them in a row, in one class."""
    rng = np.random.default_rng(18)
    passage = [f"p{i}" for i in range(90)]
    texts_ = [joined(rng, 30, passage[a : a + 30], 30) for a in (0, 30, 60) for _ in range(40)]
    whole = list(range(len(texts_), len(texts_) + 12))
    texts_ += [joined(rng, int(rng.integers(5, 60)), passage, 20) for _ in whole]
    order = rng.permutation(len(texts_)).tolist()
    df = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts_)], "doc_id long, text string")
    ids = {order[i] for i in whole}
    found = [r for r in chaining.shared_passages(df).collect() if r.words >= 85]
    links = {(r.doc_id, r.other_id) for r in found}
    assert {x for p in links for x in p} == ids
    label = plain_components([(i, i) for i in sorted(ids)], lambda x, y: x == y or (x, y) in links or (y, x) in links)
    assert len(set(label.values())) == 1


@pytest.mark.parametrize("period", [1, 3, 8, 13])
def test_periodic_passages(spark, period):
    rng = np.random.default_rng(period)
    line = [f"q{i}" for i in range(period)]
    texts_ = [joined(rng, 20, line * (-(-70 // period)), 25), joined(rng, 41, line * (-(-70 // period)), 5), joined(rng, 100)]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = chaining.shared_passages(df).collect()
    assert {(r.doc_id, r.other_id) for r in got} in ({(0, 1)}, {(1, 0)}) and max(r.words for r in got) >= 60


def test_fuzzy_passages(spark):
    rng = np.random.default_rng(2)
    rows_, want = [], set()
    for i in range(60):
        passage = [f"f{i}-{k}" for k in range(90)]
        other = [f"y{v}" if rng.random() < 0.08 else w for w, v in zip(passage, rng.integers(0, 1 << 40, 90), strict=True)]
        rows_ += [(2 * i, joined(rng, 30, passage, 30)), (2 * i + 1, joined(rng, 60, other, 5))]
        want.add(frozenset((2 * i, 2 * i + 1)))
    got = {frozenset((r.doc_id, r.other_id)) for r in chaining.shared_passages(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_runs_are_keyed_by_content(spark):
    rng, p = np.random.default_rng(6), chaining.Chaining()
    h, at = rng.integers(-(1 << 60), 1 << 60, 50), np.cumsum(rng.integers(1, 9, 50))
    key, place = chaining.run_keys(h, at, p)
    again, moved = chaining.run_keys(np.r_[rng.integers(0, 99, 7), h[10:40]], np.r_[np.arange(7), at[10:40] - at[10] + 500], p)
    inside = [i for i in range(10, 40) if at[np.searchsorted(at, at[i] + p.least_words - p.k) if at[i] + p.least_words - p.k <= at[-1] else 0] <= at[39] and at[i] + p.least_words - p.k <= at[39]]
    own = dict(zip(key.tolist(), place.tolist(), strict=True))
    shared = [k for k in again.tolist() if k in own]
    assert len(shared) == 2 * len(inside) > 20 and len(set(key.tolist())) == len(key)
    assert {m - own[k] for k, m in zip(again.tolist(), moved.tolist(), strict=True) if k in own} == {500 - at[10]}


def plain_model(train, dev, tokens_of):
    """Scores by deleted interpolation, written token by token."""
    pairs = lambda t: list(zip([b"", *t[:-1]], t, strict=True))
    count = lambda ids, f: collections.Counter(x for i in ids for x in f(tokens_of[i]))
    uni, bi = count(train, list), count(train, pairs)
    first_uni, first_bi = count(train - dev, list), count(train - dev, pairs)
    total, types, first_total = sum(uni.values()), len(uni), sum(first_uni.values())
    bucket = lambda c: 0 if not c else 1 + int(math.log2(c))

    def parts(j, k, u, b, n):
        return (b[j, k] / u[j] if u[j] else 0.0, u[k] / n if n else 0.0, 1 / (types + 1))

    seen = collections.defaultdict(list)
    for i in dev:
        for j, k in pairs(tokens_of[i]):
            seen[bucket(first_uni[j])].append(parts(j, k, first_uni, first_bi, first_total))
    weights = {}
    for x, p in seen.items():
        p, a = np.array(p), np.array([0.0, 0.8, 0.2] if x == 0 else [0.5, 0.4, 0.1])
        for _ in range(500):
            share = p * a
            new = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
            done, a = np.abs(new - a).max() < 1e-9, new
            if done:
                break
        weights[x] = a
    out = {}
    for i, t in tokens_of.items():
        out[i] = 0.0
        for j, k in pairs(t):
            a = weights.get(bucket(uni[j]), np.array([0.0, 0.8, 0.2] if not uni[j] else [0.5, 0.4, 0.1]))
            out[i] += math.log10(sum(x * y for x, y in zip(a, parts(j, k, uni, bi, total), strict=True)))
    return out


@pytest.mark.parametrize("how", [{}, {"bucket_bytes": 1500, "block_bytes": 4000, "fan": 3, "chunk_keys": 500}])
def test_language_model_scores(unique, how):
    got = {r.doc_id: r.score for r in interpolation.score(unique, **how).collect()}
    text = {r[0]: r[1] for r in rows()}
    tokens_of = {i: [*(text[i] or "").encode().lower().split(), b""] for i in got}
    part = {i: zlib.crc32(str(i).encode()) % 7 for i in got}
    want = plain_model({i for i in got if part[i] != 2}, {i for i in got if part[i] == 3}, tokens_of)
    for i, x in got.items():
        assert x == pytest.approx(want[i], rel=2e-3, abs=1e-3)


def test_requests_follow_the_input():
    """Records of a block or chunk are bounded by the fan, whatever the number of buckets."""
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 5000))
    for buckets in (1, 200, 40_000, 10**8):
        levels = interpolation.units(buckets, 256)
        b = interpolation.bucket_of(keys, buckets)
        order = np.lexsort((keys, b))
        assert len(list(interpolation.dealt(1, keys[order], b[order], levels[0]))) <= 256
        assert levels[-1] == 1 and all(-(-x // y) <= 256 for x, y in zip([buckets, *levels], levels, strict=False))


def test_packed_arrays_come_back():
    rng = np.random.default_rng(2)
    a, b, c = np.sort(rng.integers(0, 1 << 62, 300)), rng.integers(-5, 5, 300), np.empty(0, np.int64)
    for rising in (False, True):
        assert all((x == y).all() for x, y in zip(interpolation.unpacked(interpolation.packed(a, b, c, rising=rising), rising), (a, b, c), strict=True))


def test_language_model(unique):
    got = {r.doc_id: r for r in interpolation.score(unique).collect()}
    text = {r[0]: r[1] for r in rows()}
    tokens = {i: (text[i] or "").encode().lower().split() + [None] for i in got}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in got}
    c = collections.Counter(w for i in got if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i]), abs=1e-6)
        assert r.score < 0


@pytest.mark.parametrize("run", [
    line_quality.judge, line_quality.cleaned, simhash.near_duplicates, simhash.drop_near_copies, pii.spans, pii.redacted, mixing.mix, mixing.mixed_documents,
    packing.pack, chaining.shared_passages, interpolation.score,
], ids=lambda f: f.__name__)
def test_empty_table(empty, run):
    assert run(empty).count() == 0


def test_pipeline(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, now, ""), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        now = out
    assert now.count() > 0
