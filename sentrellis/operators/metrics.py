"""Benchmark metrics: one partial and final aggregation each, ratios from sums, no rows on the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths as M


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn of yes/no answers and accuracy, precision, recall, f1 and yes_ratio."""
    p, a = predicted == "yes", actual == "yes"
    cells = df.groupBy(*(by or [])).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return cells.withColumns({
        "accuracy": _ratio(tp + tn, n), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "yes_ratio": _ratio(tp + fp, n),
    })


def chair_rows(captions: DataFrame) -> DataFrame:
    """Per caption from ``objects`` (representatives, repeats kept), ``truth`` and ``caption``: what CHAIR counts."""
    hallu = F.filter("objects", lambda o: ~F.array_contains("truth", o))
    return captions.select(
        "image_id",
        F.size("objects").alias("n_objects"),
        F.size(hallu).alias("n_hallu"),
        F.size(F.array_distinct(F.array_intersect("objects", "truth"))).alias("n_found"),
        F.size("truth").alias("n_truth"),
        F.size(F.split(F.trim("caption"), " ")).alias("n_words"),
    )


def chair(rows: DataFrame) -> DataFrame:
    """Sentence and instance rates of hallucination, recall and length over all captions."""
    bad, any_ = F.count_if(F.expr("n_hallu > 0")), F.count_if(F.expr("n_objects > 0"))
    s = lambda c: F.sum(c)
    out = rows.agg(
        F.count("*").alias("sentences"), any_.alias("object_sentences"), _ratio(bad, F.count("*")).alias("chair_s"), _ratio(bad, any_).alias("chair_s_refined"),
        _ratio(s("n_hallu"), s("n_objects")).alias("chair_i"), _ratio(s("n_found"), s("n_truth")).alias("object_recall"), _ratio(s("n_words"), F.count("*")).alias("mean_words"),
    )
    return out.withColumn("correct_rate", 1 - F.col("chair_s_refined")).withColumn("object_correct_rate", 1 - F.col("chair_i"))


def truth_objects(*sources: DataFrame) -> DataFrame:
    """Distinct objects of an image from several sources of (image_id, rep)."""
    rows = reduce(DataFrame.unionByName, [s.select("image_id", "rep") for s in sources])
    return rows.groupBy("image_id").agg(F.array_sort(F.collect_set("rep")).alias("truth"))


def _check_words(answers: DataFrame, words: str, associations: DataFrame) -> DataFrame:
    """id, idx, place and word: what stands for each of an answer's words, first those associated with it, in order, then the words themselves."""
    own = answers.select("id", F.posexplode(words).alias("idx", "word"))
    near = own.join(associations.withColumnRenamed("word", "key"), F.col("word") == F.col("key")).select("id", "idx", F.posexplode("associated").alias("k", "word"))
    place = lambda section, k: F.struct(F.lit(section).alias("section"), "idx", k.cast("int").alias("k")).alias("place")
    return near.select("id", "idx", place(0, F.col("k")), "word").unionAll(own.select("id", "idx", place(1, F.lit(0)), "word"))


def amber_generative(answers: DataFrame, associations: DataFrame, safe_words: DataFrame, similar: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """CHAIR, Cover, Hal and Cog in percent, from answers (id, nouns, truth, hallu), associations (word, associated), words that are always
    safe (word), and similar words (noun, word), or what leaves those rows whose noun and word are similar: of many words few
    pairs meet in an answer, and ``similarity.similar_among`` compares no others.

    Only nouns that some association knows are counted. A noun that is one of the safe words of its answer covers that
    word's truth. Any other covers what it is and what it is similar to among the answer's misleading words (both, if
    it is one of them), and, if it is similar to a safe word, that word's truth; else it is a hallucination. Of several
    words the first decides. An answer without truth words has nothing to cover."""
    known = associations.select(F.explode(F.array_append("associated", F.col("word"))).alias("noun")).distinct()
    nouns = answers.select("id", F.posexplode("nouns").alias("pos", "noun")).join(known, "noun", "left_semi")
    nouns = nouns.join(safe_words.select(F.col("word").alias("noun"), F.lit(True).alias("fine")).distinct(), "noun", "left")
    asked = nouns.filter("fine is null").select("id", "noun").distinct()
    # An answer's own nouns and words first, then what is similar: a noun can be similar to a large share of all words.
    words = [_check_words(answers, kind, associations).withColumn("kind", F.lit(kind)) for kind in ("truth", "hallu")]
    beside = asked.join(words[0].unionAll(words[1]), "id")
    same = beside.filter(F.col("noun") == F.col("word")).withColumn("how", F.concat("kind", F.lit("_same")))
    alike = similar(beside) if callable(similar) else beside.join(similar.select("noun", "word"), ["noun", "word"], "left_semi")
    like = alike.withColumn("how", F.concat("kind", F.lit("_like")))
    first = same.unionByName(like)
    pick = lambda how: F.min_by(F.when(F.col("how") == how, F.col("idx")), F.when(F.col("how") == how, F.col("place"))).alias(how)
    hits = first.groupBy("id", "noun").agg(*(pick(f"{k}_{h}") for k in ("truth", "hallu") for h in ("same", "like")))
    rows = nouns.join(hits, ["id", "noun"], "left")
    open_ = F.col("fine").isNull() & F.col("truth_same").isNull()
    rows = rows.select("id", (open_ & F.col("truth_like").isNull()).alias("wrong"), F.coalesce("truth_same", "truth_like").alias("truth"), *(F.when(open_, F.col(f"hallu_{h}")).alias(h) for h in ("same", "like")))
    covered = F.size(F.array_union(F.collect_set("same"), F.collect_set("like")))
    per = rows.groupBy("id").agg(F.count("*").alias("n_nouns"), F.count_if("wrong").alias("wrong"), F.count_distinct("truth").alias("covered"), covered.alias("seen"))
    one = answers.select("id", F.size("truth").alias("n_truth"), F.size("hallu").alias("n_hallu")).join(per, "id", "left").fillna(0)
    pct = lambda a, b: F.round(_ratio(a, b) * 100, 1)
    return one.agg(
        pct(F.sum("wrong"), F.sum("n_nouns")).alias("chair"), pct(F.sum("covered"), F.sum("n_truth")).alias("cover"),
        F.round(100 - _ratio(F.count_if(F.expr("wrong = 0")), F.count("*")) * 100, 1).alias("hal"), pct(F.sum("seen"), F.sum("n_hallu")).alias("cog"),
    )


AMBER_TYPES = {"attribute-state": "attribute", "attribute-number": "attribute", "attribute-action": "attribute", "hallucination": "existence", "relation": "relation"}


def amber_discriminative(answers: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 in percent for all answers, the three groups and each type, from ``type``,
    ``truth`` and ``response``; "no" is the positive class, and F1 uses the rounded precision and recall."""
    no, said = F.col("truth") == "no", F.col("response").isin("No", "no")
    right = F.when(F.col("truth") == "yes", F.col("response").isin("Yes", "yes")).otherwise(said)
    named = F.create_map(*[F.lit(x) for pair in AMBER_TYPES.items() for x in pair])
    levels = F.array(F.lit("overall"), F.try_element_at(named, F.col("type")), F.col("type"))
    rows = answers.select(F.explode(F.array_distinct(F.filter(levels, lambda x: x.isNotNull()))).alias("level"), right.alias("right"), no.alias("no"), said.alias("said"))
    pct = lambda a, b: F.round(_ratio(a, b) * 100, 1)
    both = F.count_if(F.col("no") & F.col("said"))
    out = rows.groupBy("level").agg(F.count("*").alias("n"), pct(F.count_if("right"), F.count("*")).alias("accuracy"), pct(both, F.count_if("said")).alias("precision"), pct(both, F.count_if("no")).alias("recall"))
    p, r = F.col("precision") / 100, F.col("recall") / 100
    # What keeps the score of two zeros from dividing by zero; that of existence is another.
    f1 = F.when(F.col("level") == "existence", M.f_score(p, r, 0.001)).otherwise(M.f_score(p, r, 0.0001))
    return out.withColumn("f1", F.round(f1 * 100, 1))


def multiple_choice(answers: DataFrame) -> DataFrame:
    """Accuracy of predicted against right options, for all questions and those with an image."""
    ok = F.col("predicted") == F.col("answer")
    return answers.agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"), _ratio(F.count_if(ok), F.count("*")).alias("accuracy"), _ratio(F.count_if(ok & F.col("has_image")), F.count_if("has_image")).alias("image_accuracy"))


FIGURE = ["category", "subcategory", "set_id", "figure_id"]
PAIR = ["category", "subcategory", "set_id", "question_id"]


def with_correct(data: DataFrame) -> DataFrame:
    """correct: verdict "1"; without a figure "2" (uncertain) is right as well."""
    blind = (F.col("category") == "VS") & (F.col("figure_id") == 0)
    return data.withColumn("correct", F.when(F.col("verdict") == "1", 1).when(blind & (F.col("verdict") == "2"), 1).otherwise(0))


def figure_scores(data: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Figures all right, all wrong and mixed, and the mean share of right answers."""
    per = data.filter(~((F.col("category") == "VS") & (F.col("figure_id") == 0))).groupBy(*FIGURE).agg(F.sum("correct").alias("c"), F.count("*").alias("t"))
    return per.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(F.expr("c = t")).alias("correct"), F.count_if(F.expr("c = 0")).alias("wrong"), F.count_if(F.expr("c > 0 and c < t")).alias("inconsistent"), F.avg(F.col("c") / F.col("t")).alias("score"))


def question_scores(data: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Questions right and wrong, and what wrong ones show: language, vision or either."""
    v, vd = F.col("verdict"), F.col("category") == "VD"
    blind = F.when(vd, F.col("figure_id") == 0).otherwise(F.col("visual_input") == 0)
    lh = ~vd & blind & (v == "0")
    vi = (vd & blind & v.isin("0", "2")) | (~blind & (v == "2"))
    mix = ~blind & (v == "0")
    return data.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.sum("correct").alias("correct"), (F.count("*") - F.sum("correct")).alias("wrong"), F.count_if(lh).alias("lh"), F.count_if(vi).alias("vi"), F.count_if(mix).alias("mix"))


def _kind(original: Column) -> Column:
    """lh, vi, mix or none of an answer, by its verdict, that of its original and if both say the same."""
    v, same, o = F.col("verdict"), F.col("same") == "1", original
    vd, first = F.col("category") == "VD", F.col("figure_id") == 0
    bad, unsure = v == "0", v == "2"
    kind = (
        F.when(first & vd, F.when(bad | unsure, "vi"))
        .when(first, F.when(bad, "lh"))
        .when(vd, F.when((o == "1") & bad & same, "mix").when(bad | unsure, "vi"))
        .when(o == "0", F.when(bad & same, "lh").when(bad | unsure, "mix"))
        .when(o == "2", F.when(bad | unsure, "vi"))
        .otherwise(F.when(unsure, "vi").when(bad, F.when((F.col("visual_input") == 2) & same, "lh").otherwise("vi")))
    )
    return F.coalesce(kind, F.lit("none"))


def attribution(data: DataFrame) -> DataFrame:
    """lh and vi (0 or 1) of each answer, from its verdict, that of its original (figure 0) and if both say the same."""
    from pyspark.sql.window import Window as W

    original = F.max(F.when(F.col("figure_id") == 0, F.col("verdict"))).over(W.partitionBy(*PAIR))
    rows = data.withColumn("original", original).withColumn("kind", _kind(F.col("original"))).drop("original")
    return rows.withColumn("lh", F.col("kind").isin("lh", "mix").cast("int")).withColumn("vi", F.col("kind").isin("vi", "mix").cast("int"))


def pair_scores(data: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Groups of a question over all figures: right if all are, else attributed by what its answers show.

    What an answer shows hangs on its group's original, so groups sum up what it would show by each verdict of that, in
    numbers of fixed width, and no group is held as rows. Of several originals the greatest verdict counts."""
    told = {"0": 1, "1": 2, "2": 3}  # in the order of the verdicts; 0 stands for any other or none, which attribute alike
    of = lambda o: F.lit(None).cast("string") if o is None else F.lit(o)
    shows = lambda o, kinds: F.max(_kind(of(o)).isin(*kinds).cast("int"))
    verdicts = [None, *told]
    flags = [shows(o, kinds).alias(f"{name}{k}") for k, o in enumerate(verdicts) for name, kinds in (("lh", ("lh", "mix")), ("vi", ("vi", "mix")))]
    original = F.max(F.when(F.col("figure_id") == 0, F.coalesce(*(F.when(F.col("verdict") == o, k) for o, k in told.items()), F.when(F.col("verdict") > "2", 4), F.lit(0)))).alias("original")
    per = data.groupBy(*PAIR).agg(F.min("correct").alias("c"), F.count("*").alias("n"), original, *flags)
    pick = lambda name: F.coalesce(*(F.when(F.col("original") == k, F.col(f"{name}{k}")) for k in (1, 2, 3)), F.col(f"{name}0"))
    per = per.select(*PAIR, "c", "n", pick("lh").alias("lh"), pick("vi").alias("vi"))
    return per.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.sum("n").alias("questions"), F.count_if(F.expr("c = 1")).alias("correct"), F.count_if(F.expr("c = 0")).alias("wrong"), F.count_if(F.expr("lh > 0 and vi = 0")).alias("lh"), F.count_if(F.expr("lh = 0 and vi > 0")).alias("vi"), F.count_if(F.expr("lh > 0 and vi > 0")).alias("mix"))


def subset_scores(data: DataFrame, hard: bool) -> DataFrame:
    """Groups of easy (original figure) or hard (changed figure) questions that are all right."""
    part = data.filter(F.col("visual_input") == 2 if hard else F.col("visual_input") != 2)
    per = part.groupBy(*PAIR).agg(F.min("correct").alias("c"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("total"), F.sum("n").alias("questions"), F.count_if(F.expr("c = 1")).alias("correct"), F.count_if(F.expr("c = 0")).alias("wrong"))


def yes_bias(data: DataFrame) -> DataFrame:
    """Share of yes among answers less that among the truth, and of false positives among wrong answers."""
    yes = (F.col("correct") == F.col("gt_answer")).cast("int")
    wrong = F.col("correct") == 0
    return data.agg((F.avg(yes) - F.avg("gt_answer")).alias("diff"), _ratio(F.count_if(wrong & (F.col("gt_answer") == 0)), F.count_if(wrong)).alias("fp"))


def metric_tree(data: DataFrame) -> DataFrame:
    """Accuracy by question, pair and figure, for each category and all, by one rollup each."""
    per_pair = data.groupBy(*PAIR).agg(F.min("correct").alias("c"))
    per_figure = data.filter(~((F.col("category") == "VS") & (F.col("figure_id") == 0))).groupBy(*FIGURE).agg(F.min("correct").alias("c"))
    parts = [(data.select("category", F.col("correct").alias("c")), "question"), (per_pair, "pair"), (per_figure, "figure")]
    rolled = [p.rollup("category").agg(F.count("*").alias("n"), F.avg("c").alias("accuracy")).select(F.lit(name).alias("metric"), F.coalesce("category", F.lit("overall")).alias("category"), "n", "accuracy") for p, name in parts]
    return reduce(DataFrame.unionByName, rolled)


def preference_metrics(pairs: DataFrame, beta: float) -> DataFrame:
    """Mean loss, rewards, margin and accuracy of preference pairs."""
    one = pairs.select(M.dpo(F.col("policy_chosen"), F.col("policy_rejected"), F.col("ref_chosen"), F.col("ref_rejected"), beta).alias("d")).select("d.*")
    return one.agg(*(F.avg(c).alias(c) for c in one.columns))


def usage(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*(F.sum(c).alias(c) for c in columns))
