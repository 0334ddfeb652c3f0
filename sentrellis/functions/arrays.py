"""Sequences of tokens and lists as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repeat_each(items: Column, n: int) -> Column:
    return F.flatten(F.transform(items, lambda x: F.array_repeat(x, n)))


def split_even(items: Column, n: int) -> Column:
    """``n`` parts of equal size; what is left over is dropped."""
    size = F.floor(F.size(items) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(items, i * size + 1, size))


def padded(ids: Column, pad: int, width: Column, left: bool = False) -> Column:
    """Padded or cut to a width."""
    fill = F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)))
    kept = F.slice(ids, F.lit(1), F.least(width, F.size(ids)))
    return F.concat(fill, kept) if left else F.concat(kept, fill)


def attention(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: x != pad)


def joined_by(chunks: Column, separator: int) -> Column:
    """Chunks of ids with a separator's id between them."""
    return F.flatten(F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.array(F.lit(separator)), c))))


def find(items: Column, part: Column) -> Column:
    """First place (from 1) where ``part`` stands in ``items``; 0 if nowhere."""
    last = F.size(items) - F.size(part) + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(places, lambda i: F.slice(items, i, F.size(part)) == part), F.lit(0)), F.lit(0))


def ignore_through(ids: Column, labels: Column, context: Column, ignored: int = -100) -> Column:
    """Labels with everything up to and through the first place of a context ignored."""
    at = find(ids, context)
    upto = F.when(at > 0, at + F.size(context) - 1).otherwise(0)
    cut = lambda n: F.concat(F.array_repeat(F.lit(ignored), n), F.slice(labels, n + 1, F.greatest(F.size(labels) - n, F.lit(0))))
    return F.element_at(F.transform(F.array(F.least(upto, F.size(labels))), cut), 1)  # the place is looked for once


def cut_after_last(ids: Column, mark: int) -> Column:
    """Up to the last mark; unchanged without one."""
    back = F.array_position(F.reverse(ids), mark).cast("int")
    return F.when(back > 0, F.slice(ids, F.lit(1), F.size(ids) - back + 1)).otherwise(ids)


def first_counted(labels: Column, ignored: int = -100) -> Column:
    """Place (from 1) of the first label that counts; 0 if none does."""
    return F.array_position(F.transform(labels, lambda x: x != ignored), True)


def counted(labels: Column, ignored: int = -100) -> Column:
    return F.filter(labels, lambda x: x != ignored)


def masked_turns(lengths: Column, human: Column, ids: Column, ignored: int = -100) -> Column:
    """Labels of a tokenised conversation: the ids, with every turn of a human ignored."""
    ends = F.transform(F.sequence(F.lit(1), F.size(lengths)), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x))
    spans = F.zip_with(ends, F.zip_with(lengths, human, lambda n, h: F.struct(n.alias("n"), h.alias("h"))), lambda e, z: F.struct((e - z["n"]).alias("a"), e.alias("b"), z["h"].alias("h")))
    return F.transform(ids, lambda x, i: F.when(F.exists(spans, lambda s: s["h"] & (i >= s["a"]) & (i < s["b"])), ignored).otherwise(x))


def generated_length(ids: Column, pad: int) -> Column:
    at = F.array_position(ids, pad).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(ids))


def without_prompt(ids: Column, n: Column) -> Column:
    return F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))


def noun_phrases(tokens: Column) -> Column:
    """Runs of nouns among (word, noun) tokens, each joined to a phrase."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside"))

    def step(acc: Column, t: Column) -> Column:
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc["out"], F.lit(-1)), t["word"])))
        out = F.when(~t["noun"], acc["out"]).when(acc["inside"], longer).otherwise(F.concat(acc["out"], F.array(t["word"])))
        return F.struct(out.alias("out"), t["noun"].alias("inside"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def get_or(map_: Column, key: Column) -> Column:
    """A map's value, the key itself without one."""
    return F.coalesce(F.try_element_at(map_, key), key)


def token_estimate(conversation: Column) -> Column:
    """Words of all turns of a conversation."""
    return F.aggregate(F.transform(conversation, lambda t: F.size(F.split(F.trim(t["value"]), r"\s+"))), F.lit(0), lambda s, n: s + n)
