"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing, each on what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the shared
folder and reads them back for the next. All stages but the last return the columns of ``documents``; the last
returns each document as often as the mix takes it.

Defined cases, in all stages: a null text counts as an empty one and stays null where the stage does not cut it; further
columns of any name are kept; an empty table gives an empty result. Quality: without any label that can be learned from,
every document stays. Lines: a row without an id stays as it is. Copies: texts without words are copies of each other,
and rows with equal ids and texts stay or go together. Leaks: an empty benchmark rejects nothing. Mix: null is a source
of its own, and a source without words is not taken. Each stage's docstring says more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentrellis.llm import copies, decontam, lines, mixing, quality
from sentrellis.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.line_dedup(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.copy_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("copies", drop_copies),
    ("leaks", drop_leaks),
    ("mix", mix),
]

#: The classifier, fingerprints and latent space have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
