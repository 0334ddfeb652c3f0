"""Masked counterexamples: detections merged by overlap, gates, mask geometry and the majority test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import boxes as B
from ..functions import text as X
from ..functions.lexicon import Lexicon
from ..sources.writers import masked_name
from .providers import Provider
from .relational import resume


def merged_detections(detections: DataFrame, overlap: float = 0.2) -> DataFrame:
    """Boxes and scores per image and label: all of the closed detector, and those of the open one that overlap none
    taken before, in order of ``ord``. The source is "both" whenever both found the label."""
    row = F.struct("ord", "box", "conf")
    kept = lambda d: F.array_sort(F.collect_list(F.when(F.col("detector") == d, row)))
    per = detections.groupBy("image_id", "label").agg(kept("closed").alias("c"), kept("open").alias("o"))
    taken = F.aggregate("o", F.col("c"), lambda acc, b: F.when(F.exists(acc, lambda a: B.iou(a["box"], b["box"]) > overlap), acc).otherwise(F.concat(acc, F.array(b))))
    source = F.when((F.size("c") > 0) & (F.size("o") > 0), "both").when(F.size("c") > 0, "closed").otherwise("open")
    return per.select("image_id", "label", F.transform(taken, lambda t: t["box"]).alias("boxes"), F.transform(taken, lambda t: t["conf"]).alias("scores"), source.alias("source"))


def confident(merged: DataFrame, least: float = 0.8) -> DataFrame:
    """Objects with one confident box keep all their boxes."""
    return merged.filter((F.size("boxes") > 0) & F.exists("scores", lambda s: s >= least))


def box_threshold(boxes: Column, scores: Column, least: float = 0.0) -> Column:
    both = F.arrays_zip(boxes.alias("b"), scores.alias("s"))
    return F.transform(F.filter(both, lambda z: z["s"] >= least), lambda z: z["b"])


def mask_boxes(boxes: Column, width: Column, height: Column, margin: float = 0.05) -> Column:
    return F.transform(boxes, lambda b: B.expand(b, margin, width, height))


def majority(responses: DataFrame, lexicon: Lexicon, key: list[str]) -> DataFrame:
    """Per masked object: responses that still mention it, of how many, and if these are half of them (rounded down)."""
    hit = X.mentions(F.col("response"), F.col("masked_object"), lexicon)
    per = responses.groupBy(*key).agg(F.count_if(hit).alias("n_hallu"), F.count("*").alias("n"))
    return per.withColumn("ratio", F.try_divide("n_hallu", "n")).withColumn("passes", (F.col("n") > 0) & (F.col("n_hallu") >= F.floor(F.col("n") / 2)))


def object_detections(objects: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections of an image by its objects (image_id, object), as ``label``.

    The closed detector's label is the object's lemma, or the object where no label is its lemma; a label of the open one
    contains either, in any case. An object of which nothing was found gives no row.
    """
    lemma = F.lower(X.phrase_lemma(F.col("object")))
    rows = detections.withColumnRenamed("label", "seen").join(objects.withColumn("lemma", lemma), "image_id")
    closed, seen = F.col("detector") == "closed", F.lower("seen")
    rows = rows.filter((closed & F.col("seen").isin(F.col("lemma"), F.col("object"))) | (~closed & (F.contains(seen, F.lower("object")) | F.contains(seen, F.col("lemma")))))
    by_lemma = F.max(closed & (F.col("seen") == F.col("lemma"))).over(W.partitionBy("image_id", "object"))
    rows = rows.withColumn("by_lemma", by_lemma).filter(~closed | ~F.col("by_lemma") | (F.col("seen") == F.col("lemma")))
    return rows.drop("seen", "lemma", "by_lemma").withColumnRenamed("object", "label")


def mask_run(images: DataFrame, detections: DataFrame, generate: Provider, lexicon: Lexicon, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole run on masked images: its counterexamples, and the images that are done.

    ``images``: image_id, image_path, question and ground_truth; those in ``done`` are left out. Objects of the ground
    truth that a detector is sure of are masked one at a time; ``generate`` answers (image_id, image_path, question,
    masked_object, boxes) with (image_id, masked_object, cand_idx, response), several for each. An object is a
    counterexample if half of its responses (rounded down) still mention it, and so without any. An image without a
    sure object is not done: it is tried again.
    """
    images = images if done is None else resume(images, done, ["image_id"])
    objects = images.select("image_id", F.explode(X.distinct_objects(F.col("ground_truth"), lexicon)).alias("object"))
    sure = confident(merged_detections(object_detections(objects, detections))).withColumnRenamed("label", "masked_object")
    rows = sure.join(images, "image_id")
    key = ["image_id", "masked_object"]
    said = generate(rows.select("image_id", "image_path", "question", "masked_object", box_threshold(F.col("boxes"), F.col("scores")).alias("boxes")))
    hit = X.mentions(F.col("response"), F.col("masked_object"), lexicon)
    per = said.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(hit, F.struct("cand_idx", "response")))).alias("hits"))
    n, hits = F.coalesce("n", F.lit(0)), F.coalesce(F.size("hits"), F.lit(0))
    judged = rows.join(per, key, "left").filter(hits >= F.floor(n / 2))
    pairs = judged.select(
        "image_id", "image_path", "question", "masked_object", masked_name(F.col("image_path"), F.col("masked_object")).alias("masked_image"),
        F.col("scores").alias("detection_scores"), F.col("source").alias("detection_source"), F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias("hallu_ratio"), n.alias("total_samples"),
        F.coalesce(F.transform("hits", lambda h: h["response"]), F.array().cast("array<string>")).alias("hallu_responses"), "ground_truth",
    )
    return pairs, sure.select("image_id").distinct().join(images.select("image_id", "image_path"), "image_id")
