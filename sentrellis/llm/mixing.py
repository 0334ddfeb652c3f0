"""Mixing sources to target weights, in DataFrame operations only.

Words are counted per source, each source gets a share of all words by its weight, capped at ``max_repeats``
times what it holds (the excess goes to the others by weight until none is above), and every document is taken
floor(rate) times plus once more with the fraction as probability, decided by a hash of its id and a seed.

Defined cases: a null text has no words; null is a source of its own, last in order; a null id hashes as the
empty string; repeated rows are decided alike; a source without words has target 0; an empty table gives an
empty mix; further columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, materialise

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
#: Sources up to which their table, a row of about 100 bytes each, is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source, source_size, target. The windows see one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((order - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumn("level", left / F.sum("weight").over(from_here))
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    per = per.withColumn("level", F.max(free).over(everything))
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target and copies, beside ``row``, the document's own columns."""
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    targets = materialise(source_targets(own.select("source", "size"), weights, max_repeats))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    targets = targets.withColumnRenamed("source", "of")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    joined = own.join(targets, F.col("source").eqNullSafe(F.col("of")), "inner")
    return joined.select("row", "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    return mix_plan(docs, **options).select("row", F.explode(F.expr("array_repeat(1, int(copies))"))).select("row.*")
