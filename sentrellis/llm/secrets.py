"""Secret scans in DataFrame operations only: fixed patterns, and character Markov models for what they miss.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled samples:
strings made by rule, and as ordinary ones all words of letters alone that the corpus holds outside base spans. A run
of token characters, or what base spans leave of it, is a secret if its log-likelihood ratio is high, in all and per
pair of characters. Words of the corpus have at most half of the weight of the ordinary model, whatever their number,
so that identifiers stay ordinary in a corpus of prose. The trained table has one number for each pair of ASCII
characters and is part of the plan as a literal; it never grows.

Positions come from the gaps and matches of a pattern, so that nothing is matched twice by other rules than those
of the regular expression engine.

Defined cases: a null text is empty and has no spans; positions count code points, ends are exclusive; equal starts
are ordered by kind; repeated rows get the same spans; an empty table gives an empty result; further columns of
any name are kept.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
# Fixed patterns of the base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
TOKEN = "[A-Za-z0-9+/_=-]"
#: Runs that the models judge, and the ratio (nats) that a secret passes, as mean of its pairs and in all.
RUN = TOKEN + "{10,}+"
RATIO, TOTAL = 0.8, 10.0
SAMPLES = 4000
SMOOTHING = 0.05
#: Words of letters alone, with no token character beside them.
WORD = f"(?<!{TOKEN})[A-Za-z]{{2,}}+(?!{TOKEN})"
#: Most weight of the corpus's words in the ordinary model; half of that where a character began so many pairs.
CORPUS_WEIGHT, CORPUS_PAIRS = 0.5, 1000
#: Numbers that are summed up by one fold.
RUN_BLOCK = 128

# Fixed word list: parts of ordinary identifiers.
PARTS = (
    "get set add remove update create delete read write load save open close start stop init parse format print "
    "user name file path line text data list item node tree map key value index count size length width height "
    "time date day hour year state status error message request response server client handler manager service "
    "factory builder config option default public private static final string number integer boolean array object "
    "table column row query result cache buffer stream reader writer thread process queue event listener callback "
    "function method class module package import export version source target output input window button label "
    "image color font style theme layout margin border header footer content license document application"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """text and label (1 random, 0 ordinary), made by rule: digests in several alphabets; joined words, with numbers, dates."""
    base = spark.range(n, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    random = base.select(F.explode(F.array(b64, F.translate(b64, "+/=", "-_"), F.col("h"), F.upper(F.translate(b64, "+/=", "XYZ")))).alias("text"), F.lit(1).alias("label"))
    words = F.split(F.lit(" ".join(PARTS)), " ")  # folds to one literal
    pick = lambda k: F.element_at(words, (F.conv(F.substring("h", 1 + 6 * k, 6), 16, 10).cast("int") % len(PARTS)) + 1)
    w = [pick(k) for k in range(5)]
    camel = F.concat(w[0], *(F.initcap(x) for x in w[1:4]))
    digits = F.translate("h", "abcdef", "012345")
    part = lambda at, n: F.substring(digits, at, n)
    numbers = [F.concat_ws("-", part(31, 4), part(35, 2), part(37, 2)), F.concat(w[0], F.lit("_"), part(39, 2), F.lit("-"), w[1], part(41, 4)), F.concat_ws("-", part(45, 3), part(48, 3), part(51, 4)), part(31, 16)]
    ordinary = base.select(F.explode(F.array(F.concat_ws("_", *w[:4]), camel, F.concat_ws("-", *w), F.upper(F.concat_ws("_", *w[:3])), F.concat(*w), F.concat_ws("/", *w), *numbers)).alias("text"), F.lit(0).alias("label"))
    return random.union(ordinary)


def _codes(text: Column) -> Column:
    """Character codes below 128 of a text; others count as 0."""
    return F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c)).otherwise(0))


def _pairs(text: Column) -> Column:
    codes = _codes(text)
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: a * 128 + b)


def corpus_pairs(docs: DataFrame) -> DataFrame:
    """pair and n: how often letters follow each other in the words of ``docs`` outside base spans; 2,704 rows at most."""
    words = F.array_join(F.regexp_extract_all(_free(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(0)), " ")
    pairs = docs.select(F.explode(F.regexp_extract_all(words, F.lit("(?=([A-Za-z]{2}))"), F.lit(1))).alias("p")).groupBy("p").count()
    return pairs.select((F.ascii("p") * 128 + F.ascii(F.substring("p", 2, 1))).alias("pair"), F.col("count").alias("n"))


def train(samples: DataFrame, corpus: DataFrame | None = None) -> list[float]:
    """Log-likelihood ratio of each pair of characters, 128 * first + second, from text and label (1 or 0).

    ``corpus`` (pair, n) joins the ordinary model.
    """
    counts = samples.filter("length(text) > 1").select("label", F.explode(_pairs(F.col("text"))).alias("pair")).groupBy("label", "pair").count().collect()
    pair = {(r["label"], r["pair"]): r["count"] for r in counts}
    first: dict[tuple[int, int], int] = {}
    for (label, p), n in pair.items():
        first[label, p // 128] = first.get((label, p // 128), 0) + n
    chance = lambda label, p: (pair.get((label, p), 0) + SMOOTHING) / (first.get((label, p // 128), 0) + 96 * SMOOTHING)
    words = {r["pair"]: r["n"] for r in corpus.collect()} if corpus is not None else {}
    begun: dict[int, int] = {}
    for p, n in words.items():
        begun[p // 128] = begun.get(p // 128, 0) + n

    def ordinary(p: int) -> float:
        n = begun.get(p // 128, 0)
        weight = CORPUS_WEIGHT * n / (n + CORPUS_PAIRS)
        return (1 - weight) * chance(0, p) + weight * words.get(p, 0) / max(n, 1)

    return [round(log(chance(1, p)) - log(ordinary(p)), 6) for p in range(128 * 128)]


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (start, kind, end, match) of all matches, from the gaps between them."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))

    def spans(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda x: x["gap"] + F.length(x["match"])))
        begin = lambda x, end: end - F.length(x["match"])
        out = F.zip_with(pairs, ends, lambda x, end: F.struct(begin(x, end).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match")))
        return F.filter(out, lambda s: keep(s["match"])) if keep else out

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(pairs, spans)).otherwise(empty)


def _long_enough(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE


def _blanked(text: Column, pattern: str, keep=None) -> Column:
    """The text with a space for each character of its matches."""
    blank = lambda m: F.repeat(F.lit(" "), F.length(m))
    either = (lambda m: F.when(keep(m), blank(m)).otherwise(m)) if keep else blank
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.zip_with(gaps, F.concat(found, F.array(F.lit(""))), lambda g, m: F.concat(g, either(m))), "")
    return F.when(F.regexp_like(text, F.lit(pattern)), joined).otherwise(text)


def _free(text: Column) -> Column:
    """The text with a space for each character of its base spans, so that no run goes through one."""
    without = lambda t, *pattern: _let(t, lambda t: _blanked(t, *pattern))
    return without(without(without(text, ASSIGN, _long_enough), ACCESS), HEX)


def _let(x: Column, use) -> Column:
    """``use`` of ``x``, which is evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _running(steps: Column) -> Column:
    """Running sums of an array that is not empty, in blocks: what is copied grows little faster than the array."""

    def sums(values: Column, start: Column) -> Column:
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])

    def by_block(blocks: Column) -> Column:
        after = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)), F.lit(0))
        return F.flatten(F.zip_with(blocks, F.concat(F.array(F.lit(0)), F.slice(after, F.lit(1), F.size(blocks) - 1)), sums))

    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN_BLOCK).cast("int")), lambda k: F.slice(s, k * RUN_BLOCK + 1, F.lit(RUN_BLOCK)))
    return _let(steps, lambda s: F.when(F.size(s) <= RUN_BLOCK, sums(s, F.lit(0))).otherwise(_let(cut(s), by_block)))


def _touches(spans: Column, r: Column) -> Column:
    """Whether the span ``r`` overlaps one of ``spans``, which are in order and apart: the last that starts before its end."""
    few = F.exists(spans, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        before = (acc["low"] < acc["high"]) & (F.get(spans, middle)["start"] < r["end"])
        return F.struct(F.when(before, middle + 1).otherwise(acc["low"]).alias("low"), F.when(before | (acc["low"] >= acc["high"]), acc["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve, lambda acc: F.get(spans, acc["low"] - 1)["end"])
    return F.when(F.size(spans) <= 16, few).otherwise(F.coalesce(last > r["start"], F.lit(False)))


def find_secrets(docs: DataFrame, model: list[float] | None = None, ratio: float = RATIO) -> DataFrame:
    """``row`` (the document's own columns), base and added: arrays of (start, kind, end, match) in order."""
    model = train(labelled_samples(docs.sparkSession), corpus_pairs(docs)) if model is None else model
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folds to one literal
    text = F.coalesce(F.col("row.text"), F.lit(""))

    def likely(m: Column) -> Column:
        total = F.aggregate(_pairs(m), F.lit(0.0), lambda acc, p: acc + F.element_at(table, p + 1))
        return total > F.greatest(ratio * (F.length(m) - 1), F.lit(TOTAL))

    kinds = [_spans(text, ASSIGN, 0, _long_enough).alias("k0"), _spans(text, ACCESS, 1).alias("k1"), _spans(text, HEX, 2).alias("k2")]
    runs = _let(_free(text), lambda t: _spans(t, RUN, 3, likely))
    own = docs.select(F.struct("*").alias("row")).select("row", *kinds, runs.alias("runs"))
    apart = F.filter("runs", lambda r: ~(_touches(F.col("k0"), r) | _touches(F.col("k1"), r) | _touches(F.col("k2"), r)))
    return own.select("row", F.array_sort(F.concat("k0", "k1", "k2")).alias("base"), apart.alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
