"""The whole run: a generator is asked for each image's next sentences with the context chosen so far, step by step.

Every step is a few Spark jobs over the images that are still active: their requests, the answers, the objects that no
earlier step ruled, what the detectors find of them, verdicts, pairs and the choice. Answers, boxes and states of a step are written
as tables of their own, and a row in ``commits`` says that one is whole. A run that starts again on the same
folder takes up what is committed and asks no model twice for it; what was written without a commit is overwritten.

A step's candidates are the distinct sentences that are not empty, each under its first number. An image leaves once
more than ``stop_share`` of its answers were empty or repeated, or none came; what was left of that last step still
counts. An object is ruled once for an image, by the first step that mentions it. State rows hold an image's objects
and sentences, which are few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import Lexicon
from . import pairs, providers, verdict

STRINGS = pairs.STRINGS
STATE = ("image_id", "image_path", "prompt", "closed", "said", "ctx", "real", "hallu", "unsure")


@dataclass(frozen=True)
class Models:
    """The providers that a run asks; sentences are taken as they are without a resolver, read by lexicon alone
    without a graph parser."""

    generator: providers.Provider
    closed_detector: providers.Provider
    open_detector: providers.Provider
    resolver: providers.Provider | None = None
    graph_parser: providers.Provider | None = None


def _none(c: str) -> Column:
    return F.coalesce(c, F.array().cast(STRINGS))


def beside(rows: DataFrame, more: DataFrame, key: str | list[str] = "image_id", how: str = "left") -> DataFrame:
    """Rows of images joined by image: both sides grow with the images and a run joins them in every step, so none is
    broadcast, which would gather it on the driver each time."""
    return rows.join(more.hint("merge"), key, how)


class Run:
    """A run whose tables are in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, models: Models, lexicon: Lexicon, vocabulary: list[str], seed: str = "s", n: int = 10, stop_share: float = 0.5, mode: str = "both", exact: bool = True):
        self.spark, self.path, self.models, self.lexicon, self.vocabulary = spark, path, models, lexicon, vocabulary
        self.seed, self.n, self.stop_share, self.mode, self.exact = seed, n, stop_share, mode, exact

    def _place(self, name: str, step: int) -> str:
        return f"{self.path}/{name}/step={step:05d}"

    def _committed(self) -> set[tuple[str, int]]:
        """What is whole: a few rows for each step."""
        try:
            rows = self.spark.read.schema("name string, step int").json(f"{self.path}/commits").collect()
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return set()
        return {(r["name"], r["step"]) for r in rows}

    def _once(self, name: str, step: int, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step, made and committed unless it is there."""
        if (name, step) not in self.done:
            make().write.mode("overwrite").parquet(self._place(name, step))
            self.spark.createDataFrame([(name, step)], "name string, step int").coalesce(1).write.mode("append").json(f"{self.path}/commits")
            self.done.add((name, step))
        return self.spark.read.parquet(self._place(name, step))

    def _start(self, images: DataFrame) -> DataFrame:
        """The state of all images before the first step, with what the closed detector finds: it is asked once."""
        asked = providers.bound(self.models.closed_detector, providers.CONTRACTS["closed_detector"])(images.select("image_id", "image_path"))
        labels = asked.groupBy("image_id").agg(F.array_sort(F.collect_set("label")).alias("closed"))
        empty = [F.array().cast(STRINGS).alias(c) for c in STATE[4:]]
        return beside(images.select("image_id", "image_path", "prompt"), labels).select("image_id", "image_path", "prompt", _none("closed").alias("closed"), *empty, *self._outcome())

    @staticmethod
    def _outcome() -> list[Column]:
        none = pairs.context_state()
        return [F.lit(False).alias("ended"), none["pairs"].alias("pairs"), none["chosen"].alias("chosen")]

    def _candidates(self, answers: DataFrame, active: DataFrame) -> DataFrame:
        """Each image that said something: image_id, image_path, cands (cand_idx, sentence, reps by number, references
        resolved by the context) and fresh, the representatives that no earlier step ruled."""
        # An image's answers are dealt once, all that follows finds them together.
        first = answers.filter("sentence <> ''").repartition("image_id").groupBy("image_id", "sentence").agg(F.min("cand_idx").alias("cand_idx"))
        if self.models.resolver is not None:
            with_context = beside(first, active.select("image_id", F.array_join("said", " ").alias("context")), how="inner")
            first = providers.resolved(with_context, self.models.resolver).select("image_id", "cand_idx", F.col("resolved").alias("sentence"))
        if self.models.graph_parser is not None:
            rows = first.withColumn("step", F.lit(0))
            graphs = providers.bound(self.models.graph_parser, providers.CONTRACTS["graph_parser"])(rows).dropDuplicates(["sentence"])
            rows = rows.join(graphs, "sentence", "left").withColumn("graph", F.coalesce("graph", F.lit("")))
            found = verdict.mentions(rows, self.lexicon, "graph")
            reps = found.groupBy("image_id", "cand_idx").agg(F.array_sort(F.collect_set("rep")).alias("reps"))
            rows = beside(first, reps, ["image_id", "cand_idx"])
        else:  # sampled sentences repeat: each distinct one is read once
            rows = first.join(first.select("sentence").distinct().withColumn("reps", verdict.objects_of("sentence", self.lexicon)), "sentence", "left")
        cands = F.array_sort(F.collect_list(F.struct("cand_idx", "sentence", _none("reps").alias("reps"))))
        images = active.select("image_id", "image_path", F.concat("real", "hallu", "unsure").alias("known"))
        gathered = beside(rows.groupBy("image_id").agg(cands.alias("cands")), images, how="inner")
        fresh = F.array_except(F.flatten(F.transform("cands", lambda c: c["reps"])), F.col("known"))
        return gathered.select("image_id", "image_path", "cands", fresh.alias("fresh"))

    def _step(self, active: DataFrame, step: int) -> DataFrame:
        """The state of the active images after a step."""
        context = active.select("image_id", "image_path", F.lit(step).alias("step"), "prompt", F.array_join("said", " ").alias("context"))
        ask = providers.bound(self.models.generator, providers.CONTRACTS["generator"])
        answers = self._once("answers", step, lambda: ask(providers.generator_requests(context, self.n)))
        gathered = self._once("gathered", step, lambda: self._candidates(answers, active))
        look = providers.bound(self.models.open_detector, providers.CONTRACTS["open_detector"])
        asked = gathered.filter(F.size("fresh") > 0).select("image_id", "image_path", X.pack_objects(F.col("fresh")).alias("caption"))
        boxes = self._once("boxes", step, lambda: look(asked))
        some = answers.groupBy("image_id").agg(F.count("*").alias("n_said"))
        opened = boxes.groupBy("image_id").agg(F.collect_set("label").alias("opened"))
        rows = beside(beside(beside(active.select(*STATE), some), gathered.drop("image_path")), opened)
        ruled = lambda r: verdict.verdict_among(r, F.col("closed"), _none("opened"), self.vocabulary, self.mode, self.exact)
        rows = rows.withColumn("ruled", F.transform(_none("fresh"), lambda r: F.struct(r.alias("rep"), ruled(r).alias("verdict"))))
        pick = lambda name: F.transform(F.filter("ruled", lambda x: x["verdict"] == name), lambda x: x["rep"])
        for name, told in (("real", "real"), ("hallu", "hallucinated"), ("unsure", "uncertain")):
            rows = rows.withColumn(name, F.array_sort(F.concat(name, pick(told))))
        draw = lambda c: pairs.draw(self.seed, F.col("image_id"), F.lit(step), c["cand_idx"])
        full = lambda c: F.struct(
            c["cand_idx"].alias("cand_idx"), c["sentence"].alias("sentence"), c["reps"].alias("reps"), F.array_intersect(c["reps"], F.col("hallu")).alias("hallu"),
            F.array_intersect(c["reps"], F.col("unsure")).alias("unsure"), F.array_intersect(c["reps"], F.col("real")).alias("real"), draw(c).alias("draw"),
        )
        rows = rows.withColumn("kept", F.coalesce(F.size("cands"), F.lit(0))).withColumn("s", F.struct(F.lit(step).alias("step"), F.transform("cands", full).alias("cands")))
        rows = rows.withColumn("acc", pairs.context_state(F.col("ctx"), F.col("said")))
        rows = rows.withColumn("acc", F.when(F.col("kept") > 0, pairs.advance(F.col("acc"), F.col("s"))).otherwise(F.col("acc")))
        ended = F.coalesce(1 - F.try_divide(F.col("kept"), F.col("n_said")) > self.stop_share, F.lit(True))
        return rows.select(*STATE[:4], "acc.said", "acc.ctx", "real", "hallu", "unsure", ended.alias("ended"), "acc.pairs", "acc.chosen")

    def run(self, images: DataFrame, most: int = 100) -> Run:
        """Steps until no image of (image_id, image_path, prompt) is active, ``most`` at most."""
        self.done = self._committed()
        state, step = self._once("state", 0, lambda: self._start(images)), 0
        while step < most and not (active := state.filter("not ended")).isEmpty():
            step += 1
            state = self._once("state", step, lambda a=active, k=step: self._step(a, k))
        return self

    def states(self) -> DataFrame:
        """All images after all their steps that are whole, one row for each step that they took part in."""
        whole = max(k for name, k in self._committed() if name == "state")
        return self.spark.read.parquet(f"{self.path}/state").filter(F.col("step") <= whole)

    def chosen(self) -> DataFrame:
        return pairs.chosen_rows(self.states().filter("step > 0").drop("step"))

    def pair_rows(self) -> DataFrame:
        return pairs.pair_rows(self.states().filter("step > 0").drop("step"))

    def images(self) -> DataFrame:
        """Each image as its last step left it: its objects by verdict, its sentences, whether it ended."""
        last = self.states().groupBy("image_id").agg(F.max_by(F.struct("step", *STATE[1:], "ended"), "step").alias("x"))
        return last.select("image_id", "x.*").withColumnsRenamed({"real": "nonhallu_objects", "hallu": "hallu_objects", "unsure": "uncertain_objects"})
