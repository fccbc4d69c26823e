"""Spelling variants of the words of a corpus by permuterm rotations: words one edit apart meet in a sorted range.

A word is marked at its end and rotated. The rotation that starts behind a character, without that character, is the
prefix that all words share which differ from it there alone, and the whole rotation of a word that lacks the character.
So rotations are sorted by that prefix; a range of one prefix holds a word for each character of the alphabet at most,
and one scan of it gives each word its number of neighbours and the most frequent one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.llm.common import discard, stored, tidy

#: Characters of a run, and the upper-case letters that are lowered, fixed by the result contract.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks the end of a word; no letter.
END = "$"


@dataclass(frozen=True)
class Variants:
    """Which words count, which occurrences lose a code point (one of so many by checksum; 0: none), and how much more
    frequent a form must be than its variant."""

    least_letters: int = 5
    least_count: int = 3
    damage: int = 97
    form_ratio: int = 2


def _damaged(run: Column, doc_id: Column, params: Variants) -> Column:
    if not params.damage:
        return run
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % params.damage == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, params: Variants = Variants()) -> DataFrame:
    """word, n of every word of the texts that is long and frequent enough.

    A null or empty text has no words; a null id reads as empty; equal rows count each; texts of any length are taken
    whole. Shorter runs can't become words and are passed over by the pattern. Counts are partial aggregates, so frequent
    words don't gather.
    """
    text = F.translate("text", UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{params.least_letters},}}"), F.lit(0))).alias("run"))
    words = runs.select(_damaged(F.col("run"), F.col("doc_id"), params).alias("word")).where(F.length("word") >= params.least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= params.least_count)


def rotations(words: DataFrame) -> DataFrame:
    """key, whole, last, word, n: every rotation of a marked word, and every one without the character before its start.

    last: the next character differs, so that a run of one character, which gives one shorter word, is met once.
    """
    w, size = F.col("word"), F.length("word")
    part = lambda i: F.concat(F.substring(w, i + 1, size), F.lit(END), F.substring(w, F.lit(1), i))
    own = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(part(i).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("last")))
    less = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.concat(F.substring(w, i + 2, size), F.lit(END), F.substring(w, F.lit(1), i)).alias("key"), F.lit(False).alias("whole"),
        (F.substring(w, i + 1, F.lit(1)) != F.substring(w, i + 2, F.lit(1))).alias("last")))
    return words.select("word", "n", F.explode(F.concat(own, less)).alias("r")).select("r.key", "r.whole", "r.last", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near and best (less: minus its count, word) of every word that has a near one.

    Words of a range that lack their character there are replacements of each other; the one that is the whole range is
    one deletion away from those. A range is as wide as the alphabet, so its window is small whatever the input.
    """
    scan = Window.partitionBy("key").orderBy("whole", F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    ranged = rotations(words).withColumn("me", me).withColumns({
        "replaced": F.count_if(~F.col("whole")).over(scan), "longer": F.count_if("last").over(scan),
        "first": F.min(F.when(~F.col("whole"), F.col("me"))).over(scan),
        "second": F.nth_value(F.when(~F.col("whole"), F.col("me")), 2).over(scan),
        "longest": F.min(F.when(F.col("last"), F.col("me"))).over(scan), "shorter": F.min(F.when(F.col("whole"), F.col("me"))).over(scan)})
    other = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    shorter = F.when(F.col("last"), F.col("shorter"))
    met = ranged.select(
        "word", F.when(F.col("whole"), F.col("longer")).otherwise(F.col("replaced") - 1 + shorter.isNotNull().cast("int")).alias("met"),
        F.when(F.col("whole"), F.col("longest")).otherwise(F.least(other, shorter)).alias("best"))
    return met.where("met > 0").groupBy("word").agg(F.sum("met").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): the end of each chain, by pointers that double their reach a round.

    Counts at least double along a chain, so it is short and has no cycle.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("ahead"))
        moved = stored(now.join(ahead, now.root == ahead.at, "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        discard(forms.sparkSession, now)
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, params: Variants = Variants()) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of docs.

    The form of a word is its most frequent near word (ties: the first in code-point order) if that is frequent enough.
    Columns other than doc_id and text are not read; a table without words gives no rows.
    """
    words = stored(word_counts(docs.select("doc_id", "text"), params), "words")
    near = neighbours(words).withColumnRenamed("word", "of")
    form = F.when(-F.col("best.less") >= params.form_ratio * F.col("n"), F.col("best"))
    with_form = stored(words.join(near, words.word == near.of, "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form["word"].alias("form"), (-form["less"]).alias("form_n")), "forms")
    roots = last_forms(with_form.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return with_form.join(roots, with_form.word == roots.of, "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


@tidy
def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_permuterm_variants": op11_permuterm_variants}
ORACLES: dict[str, str] = {}
