"""The run loop: what it asks for, what it keeps, and how it goes on after a loss."""

import pytest
from pyspark.sql import functions as F

from sentrellis.functions.lexicon import Lexicon
from sentrellis.operators import providers, run, verdict
from sentrellis.plans import bindings

LEX = Lexicon({w: w for w in ("dog", "cat", "bus", "tree", "ball")})
SAID = {
    ("a", 1): ["a dog", "a cat", "a dog"], ("a", 2): ["it and a dog", "a cat", "a bus"], ("a", 3): ["a dog and a tree", "", "", "a cat"],
    ("b", 1): ["a tree", "", ""], ("c", 1): ["a ball", "a bus"], ("c", 2): ["", ""],
}
SEEN = {"a": (["dog"], ["dog", "bus", "tree"]), "b": ([], []), "c": ([], ["ball"])}


class Asked:
    """Providers that note what they are asked for on the driver, and fail once at a given step."""

    def __init__(self, spark, fail=None):
        self.spark, self.fail, self.contexts, self.objects, self.looked = spark, fail, {}, {}, 0

    def say(self, asked):
        for r in asked.collect():
            assert (r["image_id"], r["step"]) not in self.contexts and r["n"] == 10
            self.contexts[r["image_id"], r["step"]] = r["context"]
        rows = [(i, k, n, t) for (i, k), texts in SAID.items() for n, t in enumerate(texts)]
        return asked.select("image_id", "step").join(self.spark.createDataFrame(rows, "image_id string, step int, cand_idx int, sentence string"), ["image_id", "step"])

    def closed(self, asked):
        self.looked += 1
        rows = [(i, label, k) for i, (labels, _) in SEEN.items() for k, label in enumerate(labels)]
        return asked.join(self.spark.createDataFrame(rows, "image_id string, label string, ord int"), "image_id").select("*", *(F.lit(0.5).alias(c) for c in ("conf", "x", "y", "w", "h")))

    def open(self, asked):
        if self.fail and any(step == self.fail for _, step in self.contexts):
            self.fail = None
            raise RuntimeError("lost")
        for r in asked.collect():
            for label in filter(None, r["caption"].split(".")):
                assert (r["image_id"], label) not in self.objects
                self.objects[r["image_id"], label] = True
        rows = [(i, label, k) for i, (_, labels) in SEEN.items() for k, label in enumerate(labels)]
        return asked.join(self.spark.createDataFrame(rows, "image_id string, label string, ord int"), "image_id").select("*", F.lit(0.5).alias("conf"), F.lit(None).cast(providers.BOX).alias("box"))

    def resolve(self, asked):
        return asked.select("context", "sentence", F.regexp_replace("sentence", r"\bit\b", "the dog").alias("resolved"))

    def models(self):
        return run.Models(self.say, self.closed, self.open, self.resolve)


def result(r):
    chosen = {(x["image_id"], x["step"]): x["sentence"] for x in r.chosen().collect()}
    pairs = sorted((x["image_id"], x["step"], x["y_win"], x["y_lose"], x["context"]) for x in r.pair_rows().collect())
    return chosen, pairs, {x["image_id"]: x for x in r.images().collect()}


@pytest.mark.parametrize("lost", [None, 1, 2])
def test_run(spark, tmp_path, lost):
    images = spark.createDataFrame([(i, f"p/{i}", "Describe.") for i in "abc"] + [("d", "p/d", "No answers.")], "image_id string, image_path string, prompt string")
    asked = Asked(spark, lost)
    path = f"file://{tmp_path}/run"
    start = lambda: run.Run(spark, path, asked.models(), LEX, ["dog", "cat"]).run(images)
    if lost:
        with pytest.raises(RuntimeError, match="lost"):
            start()
        # What a lost writer left of a step without its commit does not count.
        spark.createDataFrame([("a", 1)], "image_id string, wrong int").write.parquet(f"{path}/boxes/step={lost:05d}")
    chosen, pairs, images_ = result(start())
    # The dog is real, the cat hallucinated, the bus and the tree are real too, for the closed detector does not know them.
    assert chosen == {("a", 1): "a dog", ("a", 2): "a bus", ("a", 3): chosen["a", 3], ("b", 1): "a tree", ("c", 1): "a ball"}
    assert pairs == [("a", 2, "the dog and a dog", "a cat", "a dog"), ("a", 3, "a dog and a tree", "a cat", "a dog a bus")]
    assert asked.contexts == {("a", 1): "", ("a", 2): "a dog", ("a", 3): "a dog a bus", ("a", 4): asked.contexts.get(("a", 4)), ("b", 1): "", ("c", 1): "", ("c", 2): "a ball", ("d", 1): ""}
    assert asked.looked == 1 and set(asked.objects) == {("a", w) for w in ("dog", "cat", "bus", "tree")} | {("b", "tree"), ("c", "ball"), ("c", "bus")}
    a, b, c, d = (images_[i] for i in "abcd")
    assert (a["nonhallu_objects"], a["hallu_objects"], a["uncertain_objects"]) == (["bus", "dog", "tree"], ["cat"], [])
    assert (b["uncertain_objects"], b["hallu_objects"], b["step"]) == (["tree"], [], 1) and (c["step"], d["step"], d["said"]) == (2, 1, [])
    assert all(x["ended"] for x in images_.values())
    again = Asked(spark)
    assert result(run.Run(spark, path, again.models(), LEX, ["dog", "cat"]).run(images))[:2] == (chosen, pairs) and not again.contexts


def test_most_steps(spark, tmp_path):
    images = spark.createDataFrame([("a", "p/a", "Describe.")], "image_id string, image_path string, prompt string")
    r = run.Run(spark, f"file://{tmp_path}/run", Asked(spark).models(), LEX, ["dog"]).run(images, most=1)
    assert [x["ended"] for x in r.images().collect()] == [False]
    more = run.Run(spark, f"file://{tmp_path}/run", Asked(spark).models(), LEX, ["dog"]).run(images, most=2)
    assert sorted(x["step"] for x in more.chosen().collect()) == [1, 2]


def test_joins_by_image(spark, tmp_path):
    """No step's own joins by image gather a side on the driver, however small it is."""
    plans = {}

    class Watched(run.Run):
        def _once(self, name, step, make):
            def watched():
                df = make()
                plans[name, step] = df._jdf.queryExecution().executedPlan().toString()
                return df

            return super()._once(name, step, watched)

    images = spark.createDataFrame([(i, f"p/{i}", "Describe.") for i in "abc"], "image_id string, image_path string, prompt string")
    Watched(spark, f"file://{tmp_path}/run", Asked(spark).models(), LEX, ["dog", "cat"]).run(images)
    own = {k: p for k, p in plans.items() if k[0] not in ("answers", "boxes") and k[1] > 0}  # the others hold joins of the providers above
    assert ("state", 3) in own and all("SortMergeJoin [image_id" in p for k, p in own.items())
    assert not [k for k, p in own.items() if "BroadcastHashJoin [image_id" in p]


@pytest.mark.parametrize("mode", ["both", "open", "closed"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("vocabulary", [[], ["dog", "cat"]])
def test_verdict_among(spark, mode, exact, vocabulary):
    """Verdicts from arrays of labels are those from tables of them."""
    seen = {"a": (["dog", "hot cat"], ["dog", "bus"]), "b": ([], ["big dog", "cat"]), "c": (["cat"], [])}
    found = spark.createDataFrame([(i, r) for i in "abcd" for r in ("dog", "cat", "bus")], "image_id string, rep string")
    boxes = spark.createDataFrame([(i, k, label) for i, x in seen.items() for k, labels in zip(("closed", "open"), x, strict=True) for label in labels], "image_id string, detector string, label string")
    arrays = spark.createDataFrame([(i, *seen.get(i, ([], []))) for i in "abcd"], "image_id string, closed array<string>, opened array<string>")
    told = found.join(arrays, "image_id").select("image_id", "rep", verdict.verdict_among(F.col("rep"), F.col("closed"), F.col("opened"), vocabulary, mode, exact).alias("verdict"))
    want = verdict.verdicts(found, boxes, vocabulary, mode, exact).select("image_id", "rep", "verdict")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))


def test_lines_by_order(spark):
    """Lines and their orders are dealt by order, no orders are gathered on the driver."""
    plan = bindings.lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_orderkey" in plan and "BroadcastHashJoin [l_orderkey" not in plan
