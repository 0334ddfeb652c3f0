"""Preference pairs, the recurrence of the context, and image summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

STRINGS = "array<string>"


def is_clean(c: Column) -> Column:
    """One object at least, none hallucinated, none uncertain."""
    return (F.size(c["reps"]) >= 1) & (F.size(c["hallu"]) == 0) & (F.size(c["unsure"]) == 0)


def is_hallucinated(c: Column) -> Column:
    return F.size(c["hallu"]) >= 1


def draw(seed: str, *key: Column) -> Column:
    """A hash that replaces a random draw, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in key)))


PAIR = (
    "struct<step:int,rank:int,win:int,lose:int,y_win:string,y_lose:string,context:string,"
    "context_objects:array<string>,win_objects:array<string>,lose_hallu:array<string>>"
)
CHOSEN = "struct<step:int,cand_idx:int,sentence:string,hallu:array<string>>"


def context_state(ctx: Column | None = None, said: Column | None = None) -> Column:
    """What is known of an image before a step: objects and sentences of its context, no pairs and choices yet."""
    none = F.array().cast(STRINGS)
    return F.struct(
        (none if ctx is None else ctx).alias("ctx"), (none if said is None else said).alias("said"),
        F.array().cast(f"array<{PAIR}>").alias("pairs"), F.array().cast(f"array<{CHOSEN}>").alias("chosen"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def advance(acc: Column, s: Column) -> Column:
    """The state after a step (step, cands): its pairs and its choice added."""
    many = F.size(s["cands"]) > 1
    explores = lambda c: ~F.arrays_overlap(c["reps"], acc["ctx"])

    def split(clean: Column) -> Column:
        return F.struct(F.filter(clean, explores).alias("explore"), F.filter(clean, lambda c: ~explores(c)).alias("normal"), F.filter(s["cands"], is_hallucinated).alias("bad"))

    def paired(k: Column) -> Column:
        n = F.when(many, F.least(F.size(k["normal"]), F.size(k["bad"]))).otherwise(0)
        build = lambda context: lambda w, i: _let(F.get(k["bad"], i), lambda x: F.struct(
            s["step"].cast("int").alias("step"), i.cast("int").alias("rank"), w["cand_idx"].cast("int").alias("win"), x["cand_idx"].cast("int").alias("lose"),
            w["sentence"].alias("y_win"), x["sentence"].alias("y_lose"), context.alias("context"), acc["ctx"].alias("context_objects"),
            w["reps"].alias("win_objects"), x["hallu"].alias("lose_hallu"),
        ))
        return F.when(n > 0, _let(F.array_join(acc["said"], " "), lambda context: F.transform(F.slice(k["normal"], F.lit(1), n), build(context)))).otherwise(F.array().cast(f"array<{PAIR}>"))

    def best(k: Column) -> Column:
        pool = F.when(~many, s["cands"]).when(F.size(k["explore"]) > 0, k["explore"]).when(F.size(k["normal"]) > 0, k["normal"]).otherwise(s["cands"])
        return _let(pool, lambda p: F.array_min(F.transform(p, lambda c: F.struct(c["draw"].alias("d"), c["cand_idx"].alias("i"), c.alias("c"))))["c"])

    def after(x: Column) -> Column:
        c = x["best"]
        choice = F.struct(s["step"].cast("int").alias("step"), c["cand_idx"].cast("int").alias("cand_idx"), c["sentence"].alias("sentence"), c["hallu"].alias("hallu"))
        return F.struct(
            F.array_sort(F.array_union(acc["ctx"], c["real"])).alias("ctx"),
            F.concat(acc["said"], F.array(c["sentence"])).alias("said"),
            F.concat(acc["pairs"], x["pairs"]).alias("pairs"),
            F.concat(acc["chosen"], F.array(choice)).alias("chosen"),
        )

    kinds = _let(F.filter(s["cands"], is_clean), split)
    return _let(_let(kinds, lambda k: F.struct(paired(k).alias("pairs"), best(k).alias("best"))), after)


def fold_steps(judged: DataFrame, seed: str = "s") -> DataFrame:
    """image_id and, for each step, its context so far, pairs and chosen candidate, folded over an image's steps.

    The context of a step is what was chosen before, so no window can say it: an image's steps are gathered (they are
    few) and folded. A clean candidate without an object of the context explores; pairs are the other clean ones, each
    with a hallucinated one, in order. The choice goes to an exploring, else a clean, else any candidate,
    the one with the smallest hash; a lone candidate is chosen without a pair.
    """
    cand = F.struct("cand_idx", "sentence", "reps", "hallu", "unsure", "real", draw(seed, F.col("image_id"), F.col("step"), F.col("cand_idx")).alias("draw"))
    steps = judged.groupBy("image_id", "step").agg(F.array_sort(F.collect_list(cand)).alias("cands"))
    images = steps.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("step", "cands"))).alias("steps"))
    folded = images.select("image_id", F.aggregate("steps", context_state(), advance).alias("acc"))
    return folded.select("image_id", "acc.pairs", "acc.chosen", F.col("acc.ctx").alias("context_objects"))


def pair_rows(folded: DataFrame) -> DataFrame:
    return folded.select("image_id", F.inline("pairs")).withColumn("type", F.lit("y+"))


def chosen_rows(folded: DataFrame) -> DataFrame:
    return folded.select("image_id", F.inline("chosen"))


def running_context(chosen: DataFrame) -> DataFrame:
    """Chosen sentences with the text before each, once the choices are known."""
    before = W.partitionBy("image_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    return chosen.withColumn("context", F.array_join(F.collect_list("sentence").over(before), " ")).withColumn("context_hallu", F.array_sort(F.array_distinct(F.flatten(F.collect_list("hallu").over(before)))))


def stops(texts: Column, distinct: bool = True, share: float = 0.5) -> Column:
    """If too few of a step's candidates are left: empty ones, and with ``distinct`` repeats, do not count."""
    kept = F.filter(texts, lambda s: s != "")
    kept = F.array_distinct(kept) if distinct else kept
    return F.coalesce(1 - F.try_divide(F.size(kept), F.size(texts)) > share, F.lit(True))


def hard_positives(detections: DataFrame, found: DataFrame) -> DataFrame:
    """Detected labels that no sentence of the image mentions."""
    labels = detections.select("image_id", F.col("label").alias("rep")).distinct()
    return labels.join(found.select("image_id", "rep"), ["image_id", "rep"], "left_anti")


def placed_objects(boxes: DataFrame, found: DataFrame, small: float = 0.02, edge: float = 0.1) -> DataFrame:
    """Mentioned labels that are small (area of the largest box) or at an edge (the box farthest from any)."""
    seen = boxes.join(found.select("image_id", F.col("rep").alias("label")).distinct(), ["image_id", "label"], "left_semi")
    reach = F.least("x", 1 - F.col("x"), "y", 1 - F.col("y"))
    per = seen.groupBy("image_id", "label").agg(F.max(F.col("w") * F.col("h")).alias("largest"), F.max(reach).alias("farthest"))
    return per.select("image_id", "label", (F.col("largest") < small).alias("small"), (F.col("farthest") < edge).alias("edge"))


def extreme_boxes(boxes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Of each label's boxes (ord, x, y, w, h), the largest and smallest, that closest to an edge and that farthest
    from any; of equal ones the first. Measures are compared in nine digits."""
    size = F.round(F.col("w") * F.col("h"), 9)
    edge = F.round(F.least("x", 1 - F.col("x"), "y", 1 - F.col("y")), 9)
    least = lambda m: F.min_by("ord", F.struct(m, "ord"))
    most = lambda m: F.max_by("ord", F.struct(m, -F.col("ord")))
    return boxes.groupBy(*(key or ["image_id", "label"])).agg(most(size).alias("largest"), least(size).alias("smallest"), least(edge).alias("closest"), most(edge).alias("farthest"))


def image_summary(folded: DataFrame, judged: DataFrame, hard: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per image: its caption, its objects by verdict, hard positives, small and edge objects."""
    from .verdict import image_objects

    names = lambda flag: F.array_sort(F.collect_set(F.when(F.col(flag), F.col("label"))))
    out = folded.select("image_id", F.array_join(F.transform("chosen", lambda c: c["sentence"]), " ").alias("caption"), F.size("chosen").alias("sentences_cnt"))
    for part in (image_objects(judged), hard.groupBy("image_id").agg(F.array_sort(F.collect_set("rep")).alias("hard_positive")), placed.groupBy("image_id").agg(names("small").alias("small_objects"), names("edge").alias("edge_objects"))):
        out = out.join(part, "image_id", "left")
    return out.select(*(F.coalesce(c, F.array().cast(STRINGS)).alias(c) if t == STRINGS else F.col(c) for c, t in out.dtypes))
