"""Joins with defaults, resume, set operations and regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def resume(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is not done yet, by key."""
    return todo.join(done.select(*key), key, "left_anti")


def left_default(left: DataFrame, right: DataFrame, key: list[str], defaults: dict[str, object]) -> DataFrame:
    """All of the left with columns of the right, or their defaults."""
    out = left.join(right.select(*key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def checked_lookup(left: DataFrame, right: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a partner, and those without, which a strict lookup would raise on."""
    return left.join(right, key), left.join(right.select(*key), key, "left_anti")


def first_match(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """An inner join that takes the first partner only, by a stated order."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return left.join(right.withColumn("_rank", rank).filter("_rank = 1").drop("_rank"), key)


def zip_join(left: DataFrame, right: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The i-th of the left with the i-th of the right in each group, as far as both go."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order)).alias("rank")
    a = left.select(*group, rank, F.struct(*[c for c in left.columns if c not in group]).alias("left"))
    b = right.select(*group, rank, F.struct(*[c for c in right.columns if c not in group]).alias("right"))
    return a.join(b, [*group, "rank"])


def in_set(objects: DataFrame, members: DataFrame, lemma: str = "lemma") -> DataFrame:
    """Objects whose representative, or that of whose lemma, is among an image's members; two equi-joins, no OR."""
    sides = objects.select("image_id", "object", F.explode(F.array_distinct(F.array("rep", lemma))).alias("rep"))
    return sides.join(members.select("image_id", "rep").distinct(), ["image_id", "rep"], "left_semi").select("image_id", "object").distinct()


def original_value(df: DataFrame, group: list[str], is_original: Column, value: str, name: str) -> DataFrame:
    """A group's original value beside every row of it."""
    return df.withColumn(name, F.max(F.when(is_original, F.col(value))).over(W.partitionBy(*group)))


def prompt_counts(df: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rows for each prompt of a list, zero included."""
    n = df.groupBy("prompt").agg(F.count("*").alias("n"))
    return prompts.join(n, "prompt", "left").select("prompt", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rename_keys(df: DataFrame, key: str, field: str, order: str) -> DataFrame:
    """Rows by base name of key and field; of equal names the last stays."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    named = df.withColumn(key, base(key)).withColumn(field, base(field))
    return named.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def dedupe_requests(df: DataFrame, key: list[str]) -> DataFrame:
    """Each provider request once; answers are joined back by the key."""
    return df.dropDuplicates(key)
