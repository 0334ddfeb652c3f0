"""Source divergence audit: how differently sources of one language use its words, in exact whole numbers.

Each task counts terms by language and source. A term that enough documents of its language hold is kept, as one row
with its counts by source. For two sources, tasks tally how often each pair of counts occurs among terms that both
hold; counts of terms that only one of them or none holds follow from each source's own counts. The divergence f is
then evaluated once for each pair of counts, and multiplied by how often it occurs.

A kept term's row holds a number for each source of its language; the result has a row for each pair of sources, so
the number of sources is far smaller than its square. No other group is gathered.

Defined cases: null text, lang and source are empty strings; each row is a document, repeated ids included; a long text
is counted in pieces; a language without kept terms has pairs of value 0 and no terms; a language of one source has
no pairs; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import encoded, materialise, partitions_for, prepare

MIN_DOCS = 10
TOP_TERMS = 10
#: Entries that a task counts before it sends them, bytes of a text that it cuts at a time, cells of a block of counts.
ENTRIES, PIECE_BYTES, CELLS = 400_000, 4 << 20, 4 << 20
#: Probabilities are in these parts; how many digits of a long division are taken at a time.
PARTS, DIGITS = 1_000_000_000, 1000

_SEPARATORS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TO_TERMS = bytes(32 if c in _SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number of bytes at a time, except for longer terms."""
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        while end < len(text) and text[end] not in _SEPARATORS:
            end += 1
        yield text[start:end].translate(_TO_TERMS).split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), summed up within tasks only."""

    def rows(held: dict) -> pa.RecordBatch:
        keys, names, n, docs = [], [], [], []
        for key, (counts, holders) in held.items():
            keys += [key] * len(counts)
            names += counts
            n += counts.values()
            docs += map(holders.__getitem__, counts)
        lang, source = (pa.array([k[i] for k in keys], pa.string()) for i in range(2))
        held.clear()
        return pa.RecordBatch.from_arrays([lang, source, pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), encoded(batch["text"]), strict=True):
                counts, holders = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in _pieces(text or b""):
                    counts.update(terms)
                    seen.update(terms)
                holders.update(seen)
            if sum(len(counts) for counts, _ in held.values()) > ENTRIES:
                yield rows(held)
        if held:
            yield rows(held)

    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    return own.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total, and counts: array of (source, n) in the order of sources, n above 0."""
    counted = term_counts(docs)
    dealt = counted.repartition(partitions_for(docs.select("text")), "lang", "term")  # serves both groupings
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return by_term.filter(F.col("docs") >= min_docs).select("lang", "term", "total", "counts")


def _div(a: Column, b: Column) -> Column:
    """The whole quotient of two longs."""
    return F.call_function("div", a, b)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(PARTS * n / total) for n <= total, by long division, so that nothing overflows below 9e15."""
    out, rest, scale = F.lit(1).cast("long"), n, PARTS
    while scale > 1:
        scale //= DIGITS
        step = rest * DIGITS
        out, rest = out + _div(step, total) * scale, step % total
    return out


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two longs of at most 1e9 + 1."""
    return _div((p - q) * (p - q), p + q)


def joint_counts(terms: DataFrame) -> DataFrame:
    """lang, a, b, x, y, n: how many terms source a has x times and source b has y times; a < b, x > 0, y > 0.
    Summed up within blocks of terms only."""

    def block(lang: str, which: np.ndarray, source: np.ndarray, n: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        """A block of terms: term number, source number and count of each entry."""
        values, rank = np.unique(n, return_inverse=True)
        table = np.zeros((int(which.max()) + 1, len(names)), np.int64)
        table[which, source] = rank + 1
        k = len(values) + 1
        for a in range(len(names) - 1):
            rows = table[table[:, a] > 0]
            term, b = np.nonzero(rows[:, a + 1 :])
            key, times = np.unique((b * k + rows[term, a]) * k + rows[term, a + 1 + b], return_counts=True)
            other, x, y = key // (k * k) + a + 1, key // k % k, key % k
            if len(key):
                text = pa.array(names)
                columns = [pa.array([lang]).take(pa.array(np.zeros(len(key), np.int32))), text.take(pa.array(np.full(len(key), a))), text.take(pa.array(other)), values[x - 1], values[y - 1], times]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["lang", "a", "b", "x", "y", "n"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            for lang in table["lang"].unique().to_pylist():
                part = table.filter(pc.equal(table["lang"], lang))
                counts = part["counts"].combine_chunks()
                sizes = pc.list_value_length(counts).to_numpy()
                flat = counts.flatten()
                coded = flat.field("source").dictionary_encode()
                names = coded.dictionary.to_pylist()
                order = sorted(range(len(names)), key=lambda i: names[i].encode())
                place = np.empty(len(names), np.int64)
                place[order] = np.arange(len(names))
                source, n, which = place[coded.indices.to_numpy()], flat.field("n").to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                names = [names[i] for i in order]
                step = max(1, CELLS // max(1, len(names)))
                for start in range(0, len(sizes), step):
                    lo, hi = np.searchsorted(which, [start, start + step])
                    if hi > lo:
                        yield from block(lang, which[lo:hi] - start, source[lo:hi], n[lo:hi], names)

    return terms.select("lang", "counts").mapInArrow(tally, "lang string, a string, b string, x long, y long, n long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of several batches, by the counts that they hold."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch["counts"].flatten())
        if size > CELLS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def group_sizes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, n (kept terms' occurrences there), v (kept terms of the language), total (their occurrences)."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    every = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return groups.join(own, ["lang", "source"], "left").join(every, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("total"))


def pair_cells(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, a, b, x, y, n: how many kept terms of the language source a has x times and source b has y times, zero
    counts included; for each pair a < b of ``pairs`` (lang, a, b, v)."""
    key, zero = ["lang", "a", "b"], F.lit(0).cast("long")
    joint = joint_counts(terms).groupBy(*key, "x", "y").agg(F.sum("n").alias("n"))
    own = terms.select("lang", F.inline("counts")).groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    one = own.select("lang", F.col("source").alias("a"), F.col("n").alias("x"), "times").join(pairs.select(*key), ["lang", "a"])
    two = own.select("lang", F.col("source").alias("b"), F.col("n").alias("y"), "times").join(pairs.select(*key), ["lang", "b"])
    # What both hold leaves what one of them holds, and that leaves what none holds.
    cell = lambda x, y, n: F.struct(F.expr(x).cast("long").alias("x"), F.expr(y).cast("long").alias("y"), F.expr(n).cast("long").alias("n"))
    spread = lambda df, *cells: df.select(*key, F.inline(F.array(*cells)))
    every = spread(joint, cell("x", "y", "n"), cell("x", "0", "-n"), cell("0", "y", "-n"), cell("0", "0", "n"))
    every = every.union(spread(one, cell("x", "0", "times"), cell("0", "0", "-times")))
    every = every.union(spread(two, cell("0", "y", "times"), cell("0", "0", "-times")))
    every = every.union(pairs.select(*key, zero, zero, F.col("v").cast("long")))
    return every.groupBy(*key, "x", "y").agg(F.sum("n").alias("n")).filter("n <> 0")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` holds each other source of the language with its
    divergence, part ``term`` the ``top`` terms that the source has more than its language, by divergence."""
    prepare(docs.sparkSession)
    terms = materialise(kept_terms(docs, min_docs))
    sizes = materialise(group_sizes(docs, terms))
    side = lambda name, n: sizes.select("lang", F.col("source").alias(name), F.col("n").alias(n), "v")
    pairs = side("a", "n_a").join(side("b", "n_b").drop("v"), "lang").filter("a < b")
    cells = pair_cells(terms, pairs).join(pairs, ["lang", "a", "b"])
    share = lambda count, n: _share(F.col(count) + 2, F.col(n) + 2 * F.col("v"))
    p_q = cells.select("lang", "a", "b", "n", share("x", "n_a").alias("p"), share("y", "n_b").alias("q"))
    sums = p_q.groupBy("lang", "a", "b").agg(F.sum(F.col("n") * _f(F.col("p"), F.col("q"))).alias("value"))
    both = pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left")
    turned = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    between = both.select("lang", F.coalesce("value", F.lit(0)).alias("value"), F.inline(turned)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    held = terms.select("lang", "term", F.col("total").alias("y"), F.inline("counts")).withColumnRenamed("n", "x").join(sizes.withColumnRenamed("n", "n_a"), ["lang", "source"])
    of = held.select("lang", "source", "term", share("x", "n_a").alias("p"), share("y", "total").alias("q")).filter("p > q")
    own = of.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(between).union(ranked(own).filter(F.col("rank") <= top))
