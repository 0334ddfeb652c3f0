"""Limits, samples, padding, chunks and length-grouped batches, all reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def keyed_hash(seed: str, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key)))


def sample(df: DataFrame, n: int, seed: str, *key: str) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same for a seed."""
    return df.orderBy(keyed_hash(seed, *key), *key).limit(n)


def shuffle(df: DataFrame, seed: str, *key: str) -> DataFrame:
    return df.orderBy(keyed_hash(seed, *key), *key)


def first_rows(df: DataFrame, n: int, *order: str, legacy: bool = False) -> DataFrame:
    """The first ``n`` rows by a stated order; -1 means all (``legacy``: all but the last)."""
    if n < 0:
        return df.orderBy(*[F.col(c).desc() for c in order]).offset(1) if legacy else df
    return df.orderBy(*order).limit(n)


#: Rows of a range of an ordinal, ranges at most, and sampled keys for each range.
RANGE_ROWS, RANGES, SAMPLED = 100_000, 4096, 16


def _place(bounds: Column, key: Column) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``, by halving."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        open_, under = acc["low"] < acc["high"], F.get(bounds, middle) <= key
        return F.struct(F.when(open_ & under, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~under, middle).otherwise(acc["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(RANGES.bit_length())), start, halve, lambda acc: acc["low"])


def ordinal(df: DataFrame, name: str, *order: str, rows: int | None = None) -> DataFrame:
    """``name``: each row's place by ``order``, from 0, without a window over the whole table.

    Keys of a hashed sample cut the order into ranges of about ``RANGE_ROWS`` rows each; all columns of the order count, so
    that equal first ones are no single range. A row's place is the count of all ranges before its own and its rank within
    it. Nulls come first; equal rows share their places in any way. ``rows`` is the table's size, if it is known.
    """
    n = min(RANGES, -(-(df.count() if rows is None else rows) // RANGE_ROWS))
    key = F.struct(*order)
    if n < 2:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)) - F.lit(1).cast("long"))
    keys = df.select(key.alias("k"), F.xxhash64(*order).alias("h")).orderBy("h", "k").limit(n * SAMPLED)  # a bounded sample
    bounds = keys.agg(F.array_sort(F.collect_set("k")).alias("b")).select(F.filter("b", lambda x, i: i % SAMPLED == SAMPLED - 1).alias("_bounds"))
    placed = df.join(F.broadcast(bounds)).withColumn("_range", _place(F.col("_bounds"), key)).drop("_bounds")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return placed.join(F.broadcast(counts), "_range").withColumn(name, F.col("_before") + rank).drop("_range", "_before")


def pad_to(df: DataFrame, n: int, seed: str, *key: str) -> DataFrame:
    """At least ``n`` rows: extra ones are drawn with replacement by hash, from an ordinal of the rows."""
    have = df.count()
    if not 0 < have < n:
        return df
    rows = ordinal(df, "_ord", *key, rows=have)
    picks = df.sparkSession.range(n - have).select((F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % have).alias("_ord"))
    return df.unionByName(picks.join(rows, "_ord").drop("_ord"))


def chunks(df: DataFrame, n: int, total: int, *order: str) -> DataFrame:
    """chunk: contiguous parts of ceil(total / n) rows by order; there may be fewer than ``n``."""
    size = -(-total // n)
    return ordinal(df, "_ord", *order, rows=total).withColumn("chunk", F.floor(F.col("_ord") / size).cast("int")).drop("_ord")


def length_groups(df: DataFrame, length: str, batch: int, world: int, seed: str, *key: str) -> DataFrame:
    """megabatch, rank (longest first in it) and worker: batches of similar length after a seeded shuffle.

    A signed length marks the modality: each is grouped on its own, and their incomplete last megabatches are one.
    Positions come from a count per hash prefix and a rank within it, so no window sees the whole table.
    """
    mega = batch * world
    hashed = df.withColumns({"_h": keyed_hash(seed, *key), "_kind": F.col(length) > 0, "_len": F.abs(length)})
    hashed = hashed.withColumn("_bucket", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_kind", "_bucket").agg(F.count("*").alias("_n"))
    by = W.partitionBy("_kind").orderBy("_bucket")
    counts = counts.withColumn("_before", F.sum("_n").over(by.rowsBetween(W.unboundedPreceding, -1))).withColumn("_all", F.sum("_n").over(W.partitionBy("_kind")))
    pos = F.coalesce("_before", F.lit(0)) + F.row_number().over(W.partitionBy("_kind", "_bucket").orderBy("_h", *key)) - 1
    placed = hashed.join(counts, ["_kind", "_bucket"]).withColumn("_mega", F.floor(pos / mega))
    last = (F.col("_mega") + 1) * mega > F.col("_all")
    placed = placed.withColumn("megabatch", F.when(last, "last").otherwise(F.concat(F.when(F.col("_kind"), "a").otherwise("b"), F.col("_mega").cast("string"))))
    rank = F.row_number().over(W.partitionBy("megabatch").orderBy(F.col("_len").desc(), *key)) - 1
    return placed.withColumn("rank", rank.cast("int")).withColumn("worker", (F.col("rank") % world).cast("int")).drop("_h", "_kind", "_len", "_bucket", "_n", "_before", "_all", "_mega")


def balanced(lengths: Column, n: int) -> Column:
    """Workers of the items of one megabatch, longest first: each goes to the one with the least so far that has room."""
    room = F.floor(F.size(lengths) / n)
    start = F.struct(F.array().cast("array<int>").alias("out"), F.array_repeat(F.lit(0).cast("long"), n).alias("load"), F.array_repeat(F.lit(0), n).alias("held"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda w: F.get(acc["held"], w) < room)
        least = F.array_min(F.transform(free, lambda w: F.struct(F.get(acc["load"], w).alias("load"), w.alias("w"))))["w"]
        return F.struct(
            F.concat(acc["out"], F.array(least)).alias("out"),
            F.transform(acc["load"], lambda v, i: F.when(i == least, v + x).otherwise(v)).alias("load"),
            F.transform(acc["held"], lambda v, i: F.when(i == least, v + 1).otherwise(v)).alias("held"),
        )

    even = F.aggregate(F.transform(lengths, lambda x: x.cast("long")), start, step, lambda acc: acc["out"])
    dealt = F.transform(lengths, lambda _, i: (i % n).cast("int"))
    return F.when(F.size(lengths) % n == 0, even).otherwise(dealt)
