"""Quality rules on the lines that documents of a host share, in DataFrame functions alone.

Lines are normalised and hashed, the distinct documents of each host that hold a line are counted, lines above
the limits are removed, and documents that lose too much are rejected, as are those that fail the base rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import SPACES, broadcast_arrays, maybe_broadcast, single_spaced, stored, tidy, tucked, untucked

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """Base rules and limits of lines; a line goes if so many distinct documents of its host have it."""

    least_words: int = 50
    most_repeat_percent: int = 50
    #: A line must be in this many distinct documents of the host, and in this share of them.
    line_documents: int = 10
    line_share: float = 0.02
    #: A document is depleted if it keeps less than this share of its words.
    least_kept: float = 0.3


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    """Lines with a word, as they stand."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _normal_lines(text: Column) -> Column:
    """Lines with a word in lower case, numbers as 0, words one space apart."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0")
    t = F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _key(line: Column) -> Column:
    """Hash of a host and a normalised line."""
    return F.xxhash64("source", line)


def repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more, w being an array column of words.

    Windows are compared by hash (XXH64). Where all are distinct the answer is 0; else they are sorted with
    their places, so the work is n log n however long the text.
    """
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)).otherwise(F.array().cast("array<bigint>"))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def covered(h: Column) -> Column:
        return _let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def base_counts(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""

    def counts(t: Column) -> Column:
        w = F.filter(F.split(t, " "), lambda x: x != "")
        return _let(w, lambda w: F.struct(F.size(w).alias("n"), (F.length(t) - F.greatest(F.size(w) - 1, F.lit(0))).alias("chars"), repeat_words(w).alias("again")))

    lines = _let(_lines(F.col("text")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumn("_c", F.explode(F.array(_let(single_spaced(F.col("text")), counts))))
    out = out.withColumns({
        "n_words": F.col("_c.n").cast("long"),
        "word_chars": F.col("_c.chars").cast("long"),
        "n_symbols": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": lines.cast("long"),
        "n_repeat_words": F.col("_c.again").cast("long"),
    }).drop("_c")
    return out.withColumn("base_failed", (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.most_repeat_percent * F.col("n_words")))


def _whole(lines: Column) -> Column:
    """Hash of all normalised lines of a text, by which copies are one document."""
    return F.xxhash64(lines)


def repeated_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each occurrence of a line that at least `line_documents` rows of its host hold: source, doc_id, tie,
    key, n (the line's words) and whole, the hash of the document's normalised text.

    The first pass counts rows by partial aggregates, an upper bound of the distinct documents; only lines that
    reach the limit are looked at again, so what is kept of unique lines is a hash and a count in one shuffle.
    """
    keys = docs.select(F.explode(F.transform(_normal_lines(F.col("text")), _key)).alias("key"))
    some = stored(keys.groupBy("key").count().where(F.col("count") >= limits.line_documents).select("key"), "repeated-keys")
    words = lambda x: F.struct(_key(x).alias("key"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("n"))
    marked = _let(_normal_lines(F.col("text")), lambda x: F.struct(F.transform(x, words).alias("lines"), _whole(x).alias("whole")))
    one = docs.select("source", "doc_id", F.xxhash64("text").alias("tie"), F.explode(F.array(marked)).alias("m"))
    every = one.select("source", "doc_id", "tie", "m.whole", F.explode("m.lines").alias("line")).select("source", "doc_id", "tie", "whole", "line.key", "line.n")
    return stored(every.join(maybe_broadcast(some, some.count()), "key", "left_semi"), "repeated-lines")


def frequent_lines(docs: DataFrame, repeated: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """key of every line above the limits among repeated_lines(), counting distinct documents of the host, as the host's
    own number does; copies count once. Both are first made distinct by document, so a hot line or host spreads."""
    per_line = repeated.select("source", "key", "whole").distinct().groupBy("source", "key").agg(F.count("*").alias("documents"))
    hosts = docs.select(F.col("source").alias("host"), _whole(_normal_lines(F.col("text"))).alias("whole")).distinct()
    hosts = hosts.groupBy("host").agg(F.count("*").alias("host_documents"))
    least = F.greatest(F.lit(limits.line_documents), F.col("host_documents") * limits.line_share)
    found = per_line.join(hosts, per_line.source.eqNullSafe(hosts.host))
    return stored(found.where(F.col("documents") >= least).select("key"), "frequent-lines")


def removed_words(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, tie (hash of the text), removed (words in frequent lines), keys (those lines) where there are any.

    Equal rows (one id and one text) are taken together; each has its equal share of the words.
    """
    repeated = repeated_lines(docs, limits)
    frequent = frequent_lines(docs, repeated, limits)
    hit = repeated.join(maybe_broadcast(frequent, frequent.count()), "key", "left_semi")
    hit = hit.groupBy("doc_id", "tie").agg(F.sum("n").alias("n"), F.collect_set("key").alias("keys"))
    rows = docs.groupBy(F.col("doc_id").alias("id2"), F.xxhash64("text").alias("tie2")).agg(F.count("*").alias("rows"))
    joined = hit.join(rows, hit.doc_id.eqNullSafe(rows.id2) & (hit.tie == rows.tie2))
    return joined.select("doc_id", "tie", (F.col("n") / F.col("rows")).alias("removed"), "keys")


def cleaned(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that pass, without the frequent lines of their hosts; n_chars, if there, follows the text."""
    names = docs.columns
    docs = tucked(docs)
    lost = stored(removed_words(docs.select("doc_id", "text", "source"), limits), "lost").withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    verdict = base_counts(docs.select("*", F.xxhash64("text").alias("_own")), limits)
    joined = verdict.join(broadcast_arrays(lost, "keys"), verdict.doc_id.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_tie")), "left")
    joined = joined.where(~F.col("base_failed") & (F.col("n_words") - F.coalesce("removed", F.lit(0.0)) >= limits.least_kept * F.col("n_words")))
    normal = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), SPACES, " "))
    without = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("keys", _key(normal(x)))), "\n")
    out = joined.withColumn("text", F.when(F.col("keys").isNull(), F.col("text")).otherwise(without))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("keys").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return untucked(out, names)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the base counts, base_failed, removed_words and kept for every row of docs.

    Null or blank texts have no words and fail; a null host is a host of its own; equal rows get equal verdicts;
    an empty table gives an empty result; columns other than doc_id, text and source are not read.
    """
    docs = docs.select("doc_id", "text", "source")
    lost = removed_words(docs, limits).withColumnsRenamed({"doc_id": "lost_id", "tie": "lost_tie"})
    base = base_counts(docs, limits).withColumn("tie", F.xxhash64("text")).drop("text")
    joined = base.join(lost, base.doc_id.eqNullSafe(lost.lost_id) & (base.tie == lost.lost_tie), "left")
    removed = F.coalesce("removed", F.lit(0.0))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        removed.cast("long").alias("removed_words"),
        (~F.col("base_failed") & (F.col("n_words") - removed >= limits.least_kept * F.col("n_words"))).alias("kept"))


@tidy
def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_line_frequency": op1_line_frequency}
ORACLES: dict[str, str] = {}
