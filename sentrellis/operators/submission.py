"""Benchmark files: questions and answers as submitted, parts of a benchmark, captions scored by n-grams, tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import writers


def question_rows(df: DataFrame) -> DataFrame:
    """image (``filename`` without "./", null if it is empty) and question first, all other fields after them."""
    image = F.when(F.col("filename") != "", F.replace("filename", F.lit("./"), F.lit(""))).otherwise(F.col("filename"))
    return df.select(image.alias("image"), "question", *[c for c in df.columns if c not in ("question", "image")])


def submission_entries(df: DataFrame) -> DataFrame:
    """key, v1_ and the question's or else the image's id, and value, the text or else the caption."""
    first = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in df.columns))
    return df.select(F.concat(F.lit("v1_"), first("question_id", "image_id")).alias("key"), first("text", "caption").alias("value"))


def caption_rows(df: DataFrame) -> DataFrame:
    """image_id as a whole number and caption, of rows with question_id and text."""
    return df.select(F.col("question_id").cast("long").alias("image_id"), F.col("text").alias("caption"))


def split_complete(df: DataFrame, column: str, values: list[str]) -> list[DataFrame]:
    """The rows of each value; raises if a row has another one, so that the parts are the whole."""
    if other := df.filter(F.col(column).isNull() | ~F.col(column).isin(values)).limit(1).count():
        raise ValueError(f"{column}: {other} row or more is none of {values}")
    return [df.filter(F.col(column) == v) for v in values]


#: Parts of the evaluation that each type asks for.
EVALUATION_PARTS = {"a": ("g", "de", "da", "dr"), "g": ("g",), "d": ("de", "da", "dr"), "de": ("de",), "da": ("da",), "dr": ("dr",)}
#: Levels of the discriminative scores in each part; all answers are one if every part is asked for.
PART_LEVELS = {"de": ("existence",), "da": ("attribute", "attribute-state", "attribute-number", "attribute-action"), "dr": ("relation",)}


def selected_scores(scores: DataFrame, kind: str) -> DataFrame:
    """Rows of the discriminative scores (``level``) that an evaluation type asks for."""
    parts = EVALUATION_PARTS[kind]
    levels = [x for p in parts for x in PART_LEVELS.get(p, ())]
    return scores.filter(F.col("level").isin([*levels, "overall"] if set(PART_LEVELS) <= set(parts) else levels))


def _counted(words: list[str] | None, n: int) -> Counter:
    """How often each run of ``n`` words is in a text, joined by blanks; nulls are left out."""
    words = words or []
    return Counter(" ".join(w for w in words[i : i + n] if w is not None) for i in range(len(words) - n + 1))


def bleu(captions: DataFrame, most: int = 4) -> DataFrame:
    """BLEU of all captions, for up to ``most`` words, from ``predicted`` and ``truths`` (arrays of words).

    An n-gram counts as often as the reference that has it most often; lengths are held against the closest reference,
    the shorter of two. Counts are made caption by caption, so a task holds one batch of captions; captions are dealt evenly, n-grams are not shuffled.
    """
    near = F.array_min(F.transform("truths", lambda t: F.struct(F.abs(F.size(t) - F.size("predicted")).alias("by"), F.size(t).alias("n"))))["n"]
    kind = ", ".join(f"right{n} long, all{n} long" for n in range(1, most + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"{side}{n}" for n in range(1, most + 1) for side in ("right", "all")]
        for batch in batches:
            sums = dict.fromkeys(names, 0)
            for predicted, truths in zip(batch["predicted"].to_pylist(), batch["truths"].to_pylist(), strict=True):
                for n in range(1, most + 1):
                    mine, theirs = _counted(predicted, n), [_counted(t, n) for t in truths or ()]
                    sums[f"all{n}"] += sum(mine.values())
                    sums[f"right{n}"] += sum(min(k, max((t[g] for t in theirs), default=0)) for g, k in mine.items())
            yield pa.RecordBatch.from_pydict({c: pa.array([v], pa.int64()) for c, v in sums.items()})

    lengths = captions.agg(F.sum(F.size("predicted")).alias("length"), F.sum(near).alias("closest"))
    spread = captions.select("predicted", "truths").repartition(int(captions.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # one file is one task
    sums = spread.mapInArrow(count, kind)
    sums = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns))
    sums = sums.join(lengths)  # one row each
    # What keeps empty counts from dividing by zero.
    tiny, small = F.lit(1e-15), F.lit(1e-9)
    ratio = (F.col("length") + tiny) / (F.col("closest") + small)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    logs = [F.log((F.col(f"right{n}") + tiny) / (F.col(f"all{n}") + small)) for n in range(1, most + 1)]
    return sums.select(*((F.exp(reduce(lambda a, b: a + b, logs[:n]) / n) * penalty).alias(f"bleu{n}") for n in range(1, most + 1)))


def rendered(df: DataFrame, order: list[str]) -> DataFrame:
    """place and line: a small table as text, columns padded to their widest value, the header and a rule first."""
    text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    wide = text.agg(*(F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in df.columns)).first()
    wide = {c: wide[c] or len(c) for c in df.columns}
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = line([F.lit(c.ljust(wide[c])) for c in df.columns])
    rule = F.lit("|" + "|".join("-" * (wide[c] + 2) for c in df.columns) + "|")
    rows = df.withColumn("_key", F.concat_ws("\x01", *(F.col(c).cast("string") for c in order)))
    body = rows.select(F.lit(2).alias("place"), "_key", line([F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), wide[c], " ") for c in df.columns]).alias("line"))
    top = df.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("_key"), head.alias("line")), F.struct(F.lit(1).alias("place"), F.lit("").alias("_key"), rule.alias("line")))).alias("r")).select("r.*")
    return top.unionByName(body).orderBy("place", "_key").select("place", "line")


def metric_line(percent: list[Column], counts: list[Column], mean: Column) -> Column:
    """Percentages with one digit, whole counts and a mean, tab-separated."""
    return F.concat_ws("\t", *(F.format_string("%.1f", c * 100) for c in percent), *(F.format_string("%d", c) for c in counts), F.format_string("%.1f", mean))


def result_documents(sentences: DataFrame, overall: DataFrame, folder: str, tag: str, name: str = "Object_HalBench") -> tuple[str, str]:
    """The two result files of an evaluation: rows of all sentences, and of the overall metrics."""
    paths = f"{folder}/{tag}_eval_{name}.jsonl", f"{folder}/{tag}_eval_{name}_overall.jsonl"
    for df, path in zip((sentences, overall), paths, strict=True):
        writers.snapshot(df, path)
    return paths
