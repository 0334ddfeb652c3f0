"""Per-image state over a stream of candidate steps, and windows on event time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


#: Images whose rows are made at a time.
PART = 512


class Step(NamedTuple):
    """A step of an image: candidates in parallel lists, and the labels that each detector found so far."""

    step: int
    cand_idx: list[int]
    sentences: list[str]
    reps: list[list[str]]
    closed: list[str]
    open: list[str]


_STRINGS = pa.list_(pa.string())
#: The columns of ``ContextState.OUTPUT``.
ARROW = pa.schema([
    ("image_id", pa.string()), ("step", pa.int32()), ("cand_idx", pa.int32()), ("sentence", pa.string()), ("context", pa.string()), ("context_objects", _STRINGS), ("win", pa.list_(pa.int32())),
    ("lose", pa.list_(pa.int32())), ("nonhallu_objects", _STRINGS), ("hallu_objects", _STRINGS), ("uncertain_objects", _STRINGS), ("ended", pa.bool_()),
])


def _listed(values: pa.Array) -> list:
    """What ``to_pylist`` gives, whole levels at a time."""
    if not pa.types.is_list(values.type):
        return values.to_numpy(zero_copy_only=False).tolist() if not values.null_count else values.to_pylist()
    inner = iter(_listed(values.flatten()))
    return [None if n is None else list(islice(inner, n)) for n in values.value_lengths().to_pylist()]


class ContextState(StatefulProcessor):
    """Keeps an image's context and the verdicts of its objects over its steps, and chooses and pairs candidates as
    ``pairs.fold_steps`` does.

    A row is a step: the candidates' numbers, sentences and representatives in parallel lists, and the labels that each
    detector found so far. Candidates are the distinct sentences that are not empty, each under its first number. An
    object is ruled once for an image, by the labels of the first step that mentions it. A step whose sentences are
    mostly empty or repeated ends the image: what is left of that step still counts, its row says that it is the last,
    what is kept of the image but that is cleared, and later steps of it are ignored. An image's steps must come in
    order. The state grows with the image's objects and chosen sentences, which are few.
    """

    OUTPUT = (
        "image_id string, step int, cand_idx int, sentence string, context string, context_objects array<string>, win array<int>, lose array<int>, "
        "nonhallu_objects array<string>, hallu_objects array<string>, uncertain_objects array<string>, ended boolean"
    )

    def __init__(self, vocabulary: list[str], seed: str = "s", stop_share: float = 0.5):
        self.vocabulary, self.seed, self.stop_share = frozenset(vocabulary), seed, stop_share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("image", "said array<string>, context array<string>, real array<string>, hallu array<string>, unsure array<string>, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        out, held = self._advance(key[0], pd.concat(list(rows)).sort_values("step").itertuples(), held)
        self.state.update(held)
        names = [field.split()[0] for field in self.OUTPUT.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"step": "Int32", "cand_idx": "Int32"})

    def over_images(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All steps of images (image_id, steps in order), which need no state between batches."""
        for batch in batches:
            for k in range(0, len(batch), PART):
                part = batch.slice(k, PART)
                sizes, flat = part["steps"].value_lengths().to_pylist(), part["steps"].flatten()
                steps = map(Step, *(_listed(flat.field(c)) for c in Step._fields))
                out = [row for image, n in zip(part["image_id"].to_pylist(), sizes, strict=True) for row in self._advance(image, list(islice(steps, n)))[0]]
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)

    def _advance(self, image: str, steps: Iterable[Any], held: tuple | None = None) -> tuple[list[tuple], tuple]:
        """A row for each step of an image until its last, and what is then held of it."""
        *lists, done = held or ([], [], [], [], [], False)
        said, context, (real, hallu, unsure) = list(lists[0]), set(lists[1]), map(set, lists[2:])
        out = []
        for row in steps:
            if done:
                break
            cands = self._candidates(row)
            done = not len(row.sentences) or 1 - len(cands) / len(row.sentences) > self.stop_share
            for rep in {r for c in cands for r in c[2]} - real - hallu - unsure:
                closed, opened = rep not in self.vocabulary or rep in row.closed, rep in row.open
                (real if closed and opened else unsure if closed or opened else hallu).add(rep)
            before, objects = " ".join(said), sorted(context)
            index, sentence, win, lose = None, None, [], []
            if cands:
                index, sentence, reps, win, lose = self._choose(image, row.step, cands, context, hallu, unsure)
                said.append(sentence)
                context |= real & reps
            out.append((image, row.step, index, sentence, before, objects, win, lose, sorted(real), sorted(hallu), sorted(unsure), done))
        return out, ([], [], [], [], [], True) if done else (said, sorted(context), sorted(real), sorted(hallu), sorted(unsure), False)

    @staticmethod
    def _candidates(row: Any) -> list[tuple[int, str, set[str]]]:
        """Number, sentence and representatives of a step's distinct sentences, by number."""
        first: dict[str, tuple[int, str, set[str]]] = {}
        for c in sorted(zip(map(int, row.cand_idx), row.sentences, map(set, row.reps), strict=True), key=lambda c: c[0]):
            if c[1]:
                first.setdefault(c[1], c)
        return list(first.values())

    def _choose(self, image: str, step: int, cands: list, context: set[str], hallu: set[str], unsure: set[str]) -> tuple[int, str, set[str], list[int], list[int]]:
        """The chosen candidate, and the winners and losers of the step's pairs."""
        clean = [c for c in cands if c[2] and not c[2] & hallu and not c[2] & unsure]
        explore, normal = [c for c in clean if not c[2] & context], [c for c in clean if c[2] & context]
        pairs = list(zip(normal, (c for c in cands if c[2] & hallu), strict=False)) if len(cands) > 1 else []
        pool = (explore or normal or cands) if len(cands) > 1 else cands
        draw = lambda c: (hashlib.md5(f"{self.seed}|{image}|{step}|{c[0]}".encode()).hexdigest(), c[0])
        return *min(pool, key=draw), [w[0] for w, _ in pairs], [b[0] for _, b in pairs]

    def close(self) -> None:
        pass


def context_stream(steps: DataFrame, vocabulary: list[str], seed: str = "s", stop_share: float = 0.5) -> DataFrame:
    """One row for each step of (image_id, step, cand_idx, sentences, reps, closed, open) as it comes, on a stream or a table.

    A table has all steps of an image at once, so they are gathered and the same processor goes over them from first to
    last; a state store, which is asked over a socket for each image, is for what comes in several batches."""
    processor = ContextState(vocabulary, seed, stop_share)
    if steps.isStreaming:
        return steps.groupBy("image_id").transformWithStateInPandas(processor, ContextState.OUTPUT, "Append", "None")
    gathered = steps.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*Step._fields))).alias("steps"))
    return gathered.mapInArrow(processor.over_images, ContextState.OUTPUT)


def append_once(stream: DataFrame, path: str, checkpoint: str, key: list[str], name: str = "out"):
    """Append each micro-batch's rows to ``path`` exactly once, one row for each key of a batch.

    A batch is a folder of its own, named by the query and the batch's number; after its rows a line of the manifest says that it is whole.
    A batch that comes again overwrites what was left of it, or does nothing if the manifest has it, so that its
    cost does not depend on what is there. ``appended`` reads what the manifest names. Keys that several batches hold
    are all kept; which rows are new is the stream's own matter (``dropDuplicatesWithinWatermark``).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not _lines(spark, f"{path}/_manifest/{name}/{number:012d}").isEmpty():
            return
        batch.dropDuplicates(key).write.mode("overwrite").json(f"{path}/{name}/batch={number:012d}")
        said = spark.createDataFrame([(f"{name}/batch={number:012d}",)], "value string")
        said.coalesce(1).write.mode("overwrite").text(f"{path}/_manifest/{name}/{number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files in a folder, none if there is no such folder."""
    try:
        return spark.read.text(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "value string")


def appended(spark: SparkSession, path: str, schema: StructType | str, name: str = "out") -> DataFrame:
    """The rows of all batches that are whole; the names of their folders are all that the driver reads."""
    folders = [r["value"] for r in _lines(spark, f"{path}/_manifest/{name}/*").collect()]
    return spark.read.schema(schema).json([f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and their values per window and type, late ones up to a bound; the same on a stream and on a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events with gaps below a bound."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
