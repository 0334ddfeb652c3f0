"""Scores and losses as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_accuracy(answer: Column, given: Column) -> Column:
    """Leave-one-out accuracy of an answer among ten given ones, in closed form over the number that agree."""
    k = F.size(F.filter(given, lambda g: g == answer))
    return (k * F.least(F.lit(1.0), (k - 1) / 3) + (10 - k) * F.least(F.lit(1.0), k / 3)) / 10


def anls(answer: Column, given: Column, least: float = 0.5) -> Column:
    """Best normalised edit similarity to any given answer; below ``least`` it counts as 0."""
    trim = lambda x: F.trim(F.lower(x))
    longest = lambda g: F.greatest(F.length(trim(answer)), F.length(trim(g)))
    near = F.array_max(F.transform(given, lambda g: 1 - F.levenshtein(trim(answer), trim(g)) / F.greatest(longest(g), F.lit(1))))
    return F.when(near >= least, near).otherwise(0.0)


def exact_match(answer: Column, given: Column) -> Column:
    return F.when(F.array_contains(given, answer), 1.0).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def f_score(precision: Column, recall: Column, epsilon: float) -> Column:
    return 2 * precision * recall / (precision + recall + epsilon)


def dpo(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    """Loss, rewards, margin and accuracy of a preference pair from sequence log-probabilities."""
    logit = (policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)
    chosen, rejected = beta * (policy_chosen - ref_chosen), beta * (policy_rejected - ref_rejected)
    x = beta * logit
    loss = F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return F.struct(loss.alias("loss"), chosen.alias("chosen"), rejected.alias("rejected"), (chosen - rejected).alias("margin"), F.when(chosen > rejected, 1.0).otherwise(0.0).alias("accuracy"))


def sequence_logprob(logprobs: Column, labels: Column, ignored: int = -100, mean: bool = False) -> Column:
    """Sum, or mean, of the log-probabilities of the labels that count."""
    used = F.filter(F.arrays_zip(logprobs.alias("p"), labels.alias("l")), lambda z: z["l"] != ignored)
    total = F.aggregate(F.transform(used, lambda z: z["p"].cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(total, F.size(used)) if mean else total


def accumulation_steps(global_batch: int, devices: Column, batch: Column) -> Column:
    return F.floor(F.lit(global_batch) / (devices * batch))
