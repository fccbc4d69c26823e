"""Personal data by boosted trees over candidate spans, in DataFrame functions and Spark ML alone.

Strict patterns give the base spans. Wide patterns propose further, overlapping candidates; gradient-boosted
trees score their format and context, a threshold calibrated on held-out candidates picks those to redact.

The trees learn from spans of known truth: personal data of the corpus (the base spans, in their context) and drawn
ones are rewritten in ways that the strict patterns miss (a phone without its plus, "jo at mail dot org"), and beside
them stand near misses (dates, ids, failed check digits, prose around "at"). Candidates of the corpus that no base span
covers carry no label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.llm.common import broadcast_arrays, stored, tidy, tucked, untucked

#: Patterns of the result contract in forms that don't backtrack: a start within a run that has failed from its
#: beginning fails too, so runs are entered at their beginning or where the last match ended (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",  # fewer digits fail anyway
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]++)++",
}
_AT = r"(?:\x20?@\x20?|\x20?[\[(]at[\])]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20dot\x20|\x20?[\[(]dot[\])]\x20?)"
_POINT = r"(?:\.|\x20\.\x20|\x20dot\x20|\x20?[\[(](?:\.|dot)[\])]\x20?)"
#: High-recall generators: kind, a test that every text with a match passes, and a pattern; what they give may overlap.
WIDE = (
    ("email", r"(?i)@|[\[(]at[\])]|\x20at\x20[A-Z0-9-]+" + _DOT + "[A-Z0-9-]",
     r"(?i)(?:\G|(?<![A-Z0-9._%+-]))[A-Z0-9._%+-]++" + _AT + "[A-Z0-9-]++(?:" + _DOT + "[A-Z0-9-]++)++"),
    ("ip", r"(?i)[0-9]" + _POINT + "[0-9]", r"(?i)(?<![0-9.])[0-9]{1,3}(?:" + _POINT + r"[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("card", r"[0-9]{12}|[0-9]{4}[\x20._-]{1,2}[0-9]{4}|[0-9]{4}[\x20._-][0-9]{6}",
     r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20._-]{1,2}[0-9]{4}){3}|[0-9]{4}[\x20._-][0-9]{6}[\x20._-][0-9]{5})(?![0-9])"),
    ("phone", r"\+[0-9]", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", r"[0-9](?:[\x20()./-]{0,2}+[0-9]){6}", r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+"),
)
KINDS = ("email", "ip", "card", "phone")
HINTS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|address|reach)\b",
    "ip": r"(?i)\b(ip|address|host|server|from|login|client)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment|account)\b",
    "phone": r"(?i)\b(phone|call|tel|telephone|mobile|cell|fax|dial|contact|reach)\b",
}
FEATURES = ("length", "digits", "separators", "groups", "longest", "first", "last", "even", "letters", "capitals", "at", "dots", "plus", "brackets", "hint",
            "luhn", "octets", "dated", "tail", "wordy")


@dataclass(frozen=True)
class Settings:
    """Bounds of the classifier's training and calibration."""

    #: Spans of a kind of the corpus, and drawn ones, that train its trees (some ten candidates each); a bound on the
    #: fit, not on what is scored nor on what the threshold is calibrated with.
    train_spans: int = 4_000
    drawn_spans: int = 600
    precision: float = 0.95
    trees: int = 10
    depth: int = 4
    seed: int = 7


def found(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (kind, start, end, value) in code points."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def placed(v: Column, gaps: Column) -> Column:
        # ends of the matches: sums of the gaps and matches so far
        steps = F.zip_with(F.slice(gaps, 1, F.size(v)), v, lambda g, x: F.struct(g.alias("g"), x.alias("v")))
        seed = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

        def add(acc: Column, x: Column) -> Column:
            start = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)) + x["g"]
            one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["v"])).alias("end"), x["v"].alias("value"))
            return F.concat(acc, F.array(one))

        return F.aggregate(steps, seed, add)

    both = F.struct(values.alias("v"), lengths.alias("g"))
    return F.transform(F.array(both), lambda b: placed(b["v"], b["g"]))[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    return _luhn_sum(digits) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    """Whether a match passes its kind's rule."""
    if kind == "ip":
        return F.forall(F.split(x["value"], r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).isin(0, 1, 2) | (
            (F.length(F.regexp_replace(p, "^0+", "")) == 3) & (F.regexp_replace(p, "^0+", "") <= "255")))
    n = F.length(_digits(x["value"]))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(x["value"]))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


#: Cheap tests that a text must pass to have any match.
MAY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
NONE = "array<struct<kind:string,start:int,end:int,value:string>>"


def base_spans(text: Column) -> Column:
    """The base spans of a text by start, then kind."""
    parts = []
    for kind in KINDS:
        may = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(r"[0-9](?:[\x20-]?+[0-9]){11}" if kind == "card" else MAY[kind])
        parts.append(F.when(may, F.filter(found(text, kind, BASE[kind]), partial(_valid, kind))).otherwise(F.array().cast(NONE)))
    return in_order(F.concat(*parts))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    no = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), no(x).alias("k"), x["end"].alias("e"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def candidates(texts: DataFrame, *keep: str) -> DataFrame:
    """A row for each wide match of a text: the columns kept, kind, start, end, value and its features."""
    text, none, parts = F.col("text"), F.array().cast(NONE), []
    for kind, may, pattern in WIDE:
        some = found(text, kind, pattern)
        if kind == "phone":
            some = F.filter(some, lambda x: F.length(_digits(x["value"])) <= 15)
        parts.append(F.when(text.rlike(may), some).otherwise(none))
    rows = texts.select(*keep, "text", F.explode(F.array_distinct(F.concat(*parts))).alias("c"))
    before = F.substring("text", F.greatest(F.col("c.start") - 39, F.lit(1)), F.least(F.col("c.start"), F.lit(40)))
    after = F.substring(F.col("text"), F.col("c.end") + 1, F.lit(20))
    rows = rows.select(*keep, "c.*", F.concat(before, F.lit(" "), after).alias("around"))
    v = F.col("value")
    n = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    runs = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    size = lambda x: F.coalesce(F.length(x), F.lit(0)).cast("double")
    hint = F.coalesce(*[F.when(F.col("kind") == k, F.col("around").rlike(p)) for k, p in HINTS.items()])
    luhn = F.when(F.length(_digits(v)).between(12, 19), _luhn(_digits(v))).otherwise(False)
    octets = (F.size(runs) == 4) & F.forall(runs, lambda r: F.length(r).between(1, 3) & (r.cast("int") <= 255))
    # a year or a day with a month, by separators; sums by decimal or thousands' marks
    dated = v.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}[-./\x20][01]?[0-9](?:[-./\x20][0-3]?[0-9])?(?![0-9])|(?<![0-9])[0-3]?[0-9][-./\x20][01]?[0-9][-./\x20](?:19|20)[0-9]{2}(?![0-9])")
    return rows.withColumns({
        "length": size(v), "digits": n("[0-9]"), "separators": n(r"[\x20./()_-]"), "groups": F.size(runs).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).cast("double"),
        "first": size(F.get(runs, F.lit(0))), "last": size(F.get(runs, F.size(runs) - 1)), "even": (F.size(F.array_distinct(F.transform(runs, lambda r: F.length(r)))) == 1).cast("double"),
        "letters": n("[A-Za-z]"), "capitals": n("[A-Z]"), "at": n("@|(?i:at)"), "dots": n(r"\.|(?i:dot)"), "plus": v.startswith("+").cast("double"), "brackets": n(r"[\[(]"),
        "hint": hint.cast("double"), "luhn": luhn.cast("double"), "octets": octets.cast("double"), "dated": dated.cast("double"),
        "tail": size(F.regexp_extract(v, r"[a-z]*$", 0)), "wordy": F.regexp_count("around", F.lit("[A-Za-z]{2,}")).cast("double"),
    }).drop("around")


def _pick(h: Column, *options: Column | str) -> Column:
    """One of the options, by a hash."""
    return F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in options]), F.pmod(h, F.lit(len(options))).cast("int"))


def _number(h: Column, digits: int, salt: int) -> Column:
    """So many digits, by a hash, the first not 0."""
    return F.concat((1 + F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(9))).cast("string"), F.lpad(F.pmod(F.xxhash64(h, F.lit(salt + 1)), F.lit(10 ** (digits - 1))).cast("string"), digits - 1, "0"))


def _fours(d: Column, by: str) -> Column:
    return F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1" + by)


def drawn_spans(spark: SparkSession, n: int) -> DataFrame:
    """Spans like examples()': n of each kind, drawn by hash, so that trees can be fitted where a corpus has few."""
    h = F.xxhash64("id", F.lit("drawn"))
    pick = lambda salt, *x: _pick(F.xxhash64("id", F.lit(salt)), *x)
    name = lambda salt: F.concat(pick(salt, "jo", "ana", "kim", "lee", "sales", "info", "max", "eva"), pick(salt + 1, "", ".", "_", "7"), pick(salt + 2, "doe", "kay", "office", "stone", "wolf"))
    email = F.concat(name(1), F.lit("@"), pick(5, "mail", "post", "inbox", "example", "uni-west"), pick(6, "", ".dept"), F.lit("."), pick(7, "com", "org", "net", "de", "co.uk", "io"))
    octet = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(256)).cast("string")
    body = _number(h, 15, 20)
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    phone = F.concat(F.lit("+"), pick(30, "1", "44", "49", "34"), pick(31, " ", "-", " ("), _number(h, 3, 32), pick(31, " ", "-", ") "), _number(h, 3, 34), pick(36, " ", "-"), _number(h, 4, 37))
    values = {"email": email, "ip": F.concat_ws(".", *[octet(k) for k in range(10, 14)]), "card": F.concat(body, check), "phone": phone}
    rows = spark.range(n).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), h.alias("h")) for k, v in values.items()])).alias("x")).select("x.*")
    return rows.withColumns({"before": _pick(F.xxhash64("h", F.lit(50)), "", "it was sent on ", "please call ", "mail ", "reach me at ", "the card ", "login from ", "the total is "),
                             "after": _pick(F.xxhash64("h", F.lit(51)), "", " as before", ". The rest", ", or later")})


def examples(spanned: DataFrame) -> DataFrame:
    """kind, value, h, before, after: each distinct value of a base span with the text around one of its places."""
    rows = spanned.select("text", F.explode("base").alias("b"))
    before = F.substring("text", F.greatest(F.col("b.start") - 29, F.lit(1)), F.least(F.col("b.start"), F.lit(30)))
    rows = rows.select("b.kind", "b.value", before.alias("before"), F.substring(F.col("text"), F.col("b.end") + 1, F.lit(20)).alias("after"))
    around = rows.groupBy("kind", "value").agg(F.min(F.struct("before", "after")).alias("m"))
    return around.select("kind", "value", F.xxhash64("kind", "value").alias("h"), "m.before", "m.after")


def _rewritten(kind: str) -> Column:
    """Array of (said, label) of a span's value: ways to write it that strict patterns miss, and near misses."""
    v, h = F.col("value"), F.col("h")
    d = _digits(v)
    yes = lambda *x: [F.struct(c.alias("said"), F.lit(1.0).alias("label")) for c in x]
    no = lambda *x: [F.struct(c.alias("said"), F.lit(0.0).alias("label")) for c in x]
    part = lambda salt, n, least=0: (least + F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(n))).cast("string")
    two = lambda salt, n, least: F.lpad(part(salt, n, least), 2, "0")
    if kind == "email":
        local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
        word, label = F.regexp_replace(F.lower(local), "[^a-z]", ""), F.substring_index(domain, ".", 1)
        told = lambda at, dot: F.concat(local, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot)))
        return F.array(*yes(told(" at ", " dot "), told("[at]", "[dot]"), told(" (at) ", " (dot) "), told("(at)", "."), told(" [at] ", "."), told(" @ ", ".")),
                       *no(F.concat(word, F.lit(" at "), label, F.lit("."), F.initcap(word)), F.concat(word, F.lit(" at "), part(1, 90), F.lit("."), part(2, 90)),
                           F.concat(word, F.lit(" @ "), part(3, 9), F.lit("."), part(4, 99)), F.concat(F.initcap(word), F.lit(" at "), F.initcap(label), F.lit("."), F.initcap(word), F.lit("-"), word)))
    if kind == "ip":
        told = lambda dot: F.replace(v, F.lit("."), F.lit(dot))
        wrong = F.concat(F.substring_index(v, ".", 3), F.lit("."), part(1, 700, 256))
        other = F.concat_ws(".", part(2, 700, 256), part(3, 90), part(4, 90), part(5, 900))
        return F.array(*yes(told("[.]"), told(" . "), told(" dot "), told("(.)"), told("[dot]")), *no(wrong, other, F.replace(wrong, F.lit("."), F.lit("[.]")), F.replace(other, F.lit("."), F.lit(" . "))))
    if kind == "card":
        wrong = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), F.pmod(F.substring(d, -1, 1).cast("int") + part(1, 9, 1).cast("int"), F.lit(10)).cast("string"))
        stamp = F.concat(part(2, 50, 1980), two(3, 12, 1), two(4, 28, 1), two(5, 24, 0), two(6, 60, 0), two(7, 60, 0))
        return F.array(*yes(d, _fours(d, "-"), _fours(d, " "), _fours(d, "."), _fours(d, "_"), _fours(d, "  ")),
                       *no(wrong, _fours(wrong, " "), _fours(wrong, "."), stamp, F.concat(F.lit("1"), _number(h, 12, 8)), _number(h, 16, 10)))
    bare = F.ltrim(F.regexp_replace(v, r"^\+", ""))
    day = [two(1, 28, 1), two(2, 12, 1), part(3, 130, 1900)]
    return F.array(*yes(bare, F.regexp_replace(bare, r"[^0-9]+", "."), F.concat(F.lit("00"), F.regexp_replace(bare, r"[^0-9]+", " ")), F.concat(F.lit("0"), F.rtrim(F.regexp_replace(F.substring(d, 1, 9), "([0-9])([0-9])", "$1$2 "))),
                        F.concat(F.lit("("), F.substring(d, 2, 3), F.lit(") "), F.substring(d, 5, 3), F.lit("-"), F.substring(F.rpad(d, 11, "7"), 8, 4)), F.concat(F.substring(d, 2, 3), F.lit("-"), F.substring(d, 5, 3), F.lit("-"), F.substring(F.rpad(d, 11, "3"), 8, 4))),
                   *no(F.concat_ws("-", *day[::-1]), F.concat_ws(".", *day), F.concat_ws("/", *day), F.concat(F.concat_ws("-", *day[::-1]), F.lit(" "), two(4, 24, 0)), _number(h, 7, 5), _number(h, 8, 7), _number(h, 10, 16),
                       F.concat(_number(h, 4, 9), F.lit("."), _number(h, 5, 11)), F.concat_ws(" ", part(12, 90, 1), part(13, 900, 100), part(14, 900, 100)), F.concat(F.concat_ws("-", part(15, 90, 1900), part(16, 90, 1900)), F.lit(" "), part(17, 90, 1900)), F.concat(F.lit("978-"), part(18, 9), F.lit("-"), _number(h, 4, 19), F.lit("-"), _number(h, 4, 21), F.lit("-"), part(22, 9))))


def labelled(spans_: DataFrame) -> DataFrame:
    """Candidates of known truth: kind, label, h and the features, from spans that are rewritten and put back into
    the text around them. A candidate counts if it is the rewritten span, or overlaps a near miss or a span of another kind."""
    said = F.coalesce(*[F.when(F.col("kind") == k, _rewritten(k)) for k in KINDS])
    made = spans_.select("h", "before", "after", F.col("kind").alias("own"), F.explode(said).alias("s"))
    at = F.length("before")
    made = made.select("h", "own", F.col("s.label").alias("truth"), at.alias("from_"), (at + F.length("s.said")).alias("to_"), F.concat("before", "s.said", "after").alias("text"))
    rows = candidates(made, "h", "own", "truth", "from_", "to_")
    touching, exact = (F.col("start") < F.col("to_")) & (F.col("end") > F.col("from_")), (F.col("start") == F.col("from_")) & (F.col("end") == F.col("to_"))
    same = F.col("kind") == F.col("own")
    label = F.when(same & (F.col("truth") == 1) & exact, 1.0).when(touching & ((F.col("truth") == 0) | ~same), 0.0)
    return rows.select("kind", "h", label.alias("label"), *FEATURES).where("label IS NOT NULL")


def fit(rows: DataFrame, held: DataFrame, settings: Settings) -> tuple | None:
    """Trees of a kind from rows, and the least score from which the held-out candidates (all of them, by a histogram)
    reach the precision; None without enough of both classes or where no score does."""
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2 or min(counts.values()) < 20:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, seed=settings.seed, labelCol="label")
    model = trees.fit(assembler.transform(rows.coalesce(2)))
    scored = model.transform(assembler.transform(held)).select("label", F.round(vector_to_array("probability")[1], 3).alias("score"))
    steps = scored.groupBy("score").agg(F.sum("label").alias("hits"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # at most 1,001 rows
    steps = steps.select("score", (F.sum("hits").over(w) / F.sum("n").over(w)).alias("precision"))
    best = steps.where(F.col("precision") >= settings.precision).agg(F.min("score")).first()[0]
    return None if best is None else (assembler, model, max(best, 0.5))


def trained(spanned: DataFrame, settings: Settings = Settings()) -> dict[str, tuple]:
    """Kind to fit(): a fifth of the spans by hash calibrates, of the others a bounded share by hash trains."""
    corpus = stored(examples(spanned), "examples")
    counts = {r.kind: r["count"] for r in corpus.groupBy("kind").count().collect()}  # a row a kind
    share = F.coalesce(*[F.when(F.col("kind") == k, F.lit(min(1.0, settings.train_spans / max(counts.get(k, 0), 1)))) for k in KINDS])
    held = F.pmod("h", F.lit(5)) == 0
    drawn = drawn_spans(spanned.sparkSession, settings.drawn_spans)
    names = ["kind", "value", "h", "before", "after"]
    spans_ = corpus.where(held | (F.pmod(F.shiftright("h", 8), F.lit(1_000_000)) < share * 1_000_000)).select(*names).union(drawn.select(*names))
    rows = stored(labelled(spans_.repartition(1 + sum(counts.values()) // 500, "h")), "labelled")
    one = lambda k: fit(rows.where((F.col("kind") == k) & ~held).drop("kind", "h"), rows.where((F.col("kind") == k) & held), settings)
    # one after another: side by side the driver holds the plans, tasks and code of all kinds at once
    return {k: x for k in KINDS if (x := one(k)) is not None}


def _without_overlaps(spans_: Column) -> Column:
    """Of spans by falling score, those that overlap none before."""
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
    plain = lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "value")])
    return F.aggregate(spans_, F.array().cast(NONE), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(plain(x)))).otherwise(acc))


def added_spans(spanned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """_row and extra: candidates that overlap no base span and whose score reaches the threshold of their kind; of
    candidates that overlap the best stays. spanned has _row, text and base."""
    every = candidates(spanned, "_row", "base")
    covered = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    every = stored(every.where(~covered).drop("base").distinct(), "candidates")
    out, models = None, {} if every.isEmpty() else trained(spanned, settings)
    for kind, (assembler, model, least) in models.items():
        scored = model.transform(assembler.transform(every.where(F.col("kind") == kind))).withColumn("score", vector_to_array("probability")[1])
        kept = scored.where(F.col("score") >= least).select("_row", F.struct((-F.col("score")).alias("rank"), "start", "end", "kind", "value").alias("x"))
        out = kept if out is None else out.union(kept)
    if out is None:
        return spanned.sparkSession.createDataFrame([], f"_row long, extra {NONE}")
    return stored(out.groupBy("_row").agg(_without_overlaps(F.array_sort(F.collect_set("x"))).alias("extra")), "added")


def _with_spans(docs: DataFrame, settings: Settings) -> DataFrame:
    """docs (tucked) with base and spans."""
    text = F.coalesce("text", F.lit(""))
    spanned = docs.select("*", F.xxhash64(text).alias("_row"), base_spans(text).alias("base"))
    may = F.lit(False)
    for _, test, _ in WIDE:
        may = may | text.rlike(test)
    # texts without a candidate never leave their scan; copies are one text
    likely = stored(docs.where(may).select(F.xxhash64(text).alias("_row"), text.alias("text")).withColumn("base", base_spans(F.col("text"))), "likely")
    extra = added_spans(likely, settings).withColumnRenamed("_row", "_added")
    joined = spanned.join(broadcast_arrays(extra, "extra"), spanned["_row"] == extra["_added"], "left")
    every = in_order(F.concat("base", F.coalesce("extra", F.array().cast(NONE))))
    return joined.withColumn("spans", every).drop("_row", "_added", "extra")


def spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text, base and spans (arrays of kind, start, end, value in code points, by start and kind) of every row.

    Null texts count as empty and have none; texts are searched whole, however long; equal rows get equal spans; of
    added spans that overlap the one of the higher score stays, then the earlier; an empty table gives an empty result;
    other columns are not read.
    """
    return _with_spans(docs.select("doc_id", "text"), settings)


def redacted(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with every span of the text replaced by its kind in capitals and brackets; n_chars, if there, follows.

    Null and empty texts stay as they are; all other columns pass through, whatever their names.
    """
    names = docs.columns
    docs = tucked(docs)
    text = F.coalesce("text", F.lit(""))

    def cut(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["end"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], gap, F.when(x["start"] >= acc["at"], mark).otherwise(F.lit(""))).alias("out"), x["end"].alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    found_ = _with_spans(docs, settings)
    done = F.aggregate("spans", start, cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = found_.withColumn("_new", F.when(F.size("spans") > 0, done).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return untucked(out.withColumn("text", F.col("_new")), names)


@tidy
def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("base", of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op7_boosted_pii": op7_boosted_pii}
ORACLES: dict[str, str] = {}
