"""What models would answer, as tables: a provider is any function from a request table to an answer table.

``CONTRACTS`` states the columns of each kind of request and answer, ``bound`` holds a provider to them.
``TableProvider`` looks requests up in a stored table. ``batched`` runs a Python callable over Arrow batches, as a model
that is in the task would be, and ``pooled`` calls one for each request, many at a time, as a service would be.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X


class Provider(Protocol):
    """Answers of a generator, detector, parser, resolver or judge for the rows of a request table."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


class TableProvider:
    """Stored answers, joined by key; requests without an answer give no row."""

    def __init__(self, answers: DataFrame, key: list[str]):
        self.answers, self.key = answers, key

    def __call__(self, requests: DataFrame) -> DataFrame:
        """A null in a key is a value like any other."""
        asked = requests.dropDuplicates(self.key)
        known = self.answers.withColumnsRenamed({k: f"{k}_known" for k in self.key})
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}_known")) for k in self.key))
        out = asked.join(known, same).drop(*(f"{k}_known" for k in self.key))
        return out.select(*self.key, *(c for c in out.columns if c not in self.key))


def batched(answer: Callable[[list[dict]], list[dict]], schema: str, retries: int = 3) -> Provider:
    """A provider that calls ``answer`` on lists of rows; it is called again, so many times at most, if it raises."""

    def provider(requests: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for attempt in range(retries + 1):
                    try:
                        rows = answer(batch.to_pylist())
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                yield pa.RecordBatch.from_pylist(rows, schema=target)

        from pyspark.sql import types as T
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(T.StructType.fromDDL(schema))
        return requests.mapInArrow(run, schema)

    return provider


def pooled(answer: Callable[[dict], dict], schema: str, workers: int = 16, attempts: int = 5, wait: float = 0.5, longest: float = 30.0) -> Provider:
    """A provider that calls ``answer`` on single requests, ``workers`` of them at a time in each task.

    A request that raises is asked again after a pause that doubles from ``wait`` seconds to ``longest``, while others go on, ``attempts``
    times in all. Its answer has the columns of ``schema`` and ``error``, null if it came; a request that failed gives a
    row with its own columns, no answer, and the last error. ``failures`` and ``answers`` tell them apart. Answers
    come in the order of their requests; a task that is lost asks its own again.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType.fromDDL(schema).add("error", "string")
    target = to_arrow_schema(kind)

    def ask(request: dict) -> dict:
        for attempt in range(attempts):
            try:
                return {**answer(request), "error": None}
            except Exception as failed:  # whatever a model's client raises
                error = f"{type(failed).__name__}: {failed}"
                if attempt + 1 < attempts:
                    share = zlib.crc32(f"{attempt}{sorted(request.items(), key=repr)}".encode()) / (1 << 33)  # up to half more, so that not all come at once
                    time.sleep(min(longest, wait * 2**attempt) * (1 + share))
        return {**request, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                rows = list(pool.map(ask, batch.to_pylist()))
                yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in target} for r in rows], schema=target)

    return lambda requests: requests.mapInArrow(run, kind)


def failures(pooled_answers: DataFrame) -> DataFrame:
    """Requests that got no answer, with the last error."""
    return pooled_answers.filter(F.col("error").isNotNull())


def answers(pooled_answers: DataFrame) -> DataFrame:
    return pooled_answers.filter(F.col("error").isNull()).drop("error")


@dataclass(frozen=True)
class Contract:
    """Columns of requests and of answers, and the key by which an answer belongs to its request."""

    requests: str
    answers: str
    key: tuple[str, ...]


BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
CONTRACTS = {
    # Several sentences that may follow the context.
    "generator": Contract("image_id string, image_path string, step int, prompt string, context string, n int, temperature double", "image_id string, step int, cand_idx int, sentence string", ("image_id", "step")),
    # All objects of a fixed list of labels; centre and size are shares of the image.
    "closed_detector": Contract("image_id string, image_path string", "image_id string, label string, ord int, conf double, x double, y double, w double, h double", ("image_id",)),
    # The objects that a caption "a.b." names; boxes in pixels.
    "open_detector": Contract("image_id string, image_path string, caption string", f"image_id string, label string, ord int, conf double, box {BOX}", ("image_id",)),
    "graph_parser": Contract("sentence string", "sentence string, graph string", ("sentence",)),
    "resolver": Contract("context string, sentence string", "context string, sentence string, resolved string", ("context", "sentence")),
    "tagger": Contract("sentence string", "sentence string, tokens array<struct<text:string,pos:string,lemma:string>>", ("sentence",)),
    "judge": Contract("prompt string", "prompt string, answer string", ("prompt",)),
    "answerer": Contract("question_id string, image_path string, question string", "question_id string, answer string", ("question_id",)),
}


def _as(df: DataFrame, columns: str, what: str) -> DataFrame:
    """The columns of a contract, with its types."""
    fields = StructType.fromDDL(columns).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{what} without {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))


def bound(provider: Provider, contract: Contract) -> Provider:
    """The provider with its requests and answers held to a contract: equal requests are asked once."""

    def ask(requests: DataFrame) -> DataFrame:
        return _as(provider(_as(requests, contract.requests, "requests").distinct()), contract.answers, "answers")

    return ask


def generator_requests(images: DataFrame, n: int = 10, temperature: float = 0.7) -> DataFrame:
    """Requests for the next sentences of (image_id, image_path, step, prompt, context)."""
    return images.select("image_id", "image_path", "step", "prompt", "context", F.lit(n).alias("n"), F.lit(temperature).alias("temperature"))


def open_requests(objects: DataFrame, images: DataFrame) -> DataFrame:
    """One request for an image and all objects named of it, from (image_id, rep)."""
    captions = objects.groupBy("image_id").agg(X.pack_objects(F.collect_set("rep")).alias("caption"))
    return captions.join(images.select("image_id", "image_path"), "image_id").select("image_id", "image_path", "caption")


def resolved(sentences: DataFrame, resolver: Provider, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sentences of (context, sentence) with their references resolved; one without an answer stays as it is. ``keep``
    stores the answers and reads them back: the resolver is asked once, and few answers are sent to the sentences, not
    all sentences dealt to the answers."""
    key = ["context", "sentence"]
    answers = bound(resolver, CONTRACTS["resolver"])(sentences).dropDuplicates(key).select(*(F.col(k).alias(f"{k}_") for k in key), F.col("resolved").alias("resolved_"))
    answers = keep(answers) if keep else answers
    same = F.col("context").eqNullSafe(F.col("context_")) & F.col("sentence").eqNullSafe(F.col("sentence_"))
    return sentences.join(answers, same, "left").select(sentences["*"], F.coalesce("resolved_", "sentence").alias("resolved"))
