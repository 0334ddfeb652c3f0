"""What plans of queries over lines read and shuffle: lines once, and an image's lines once for all that is done by image."""

import pytest

from sentrellis.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["win5_context_fold", "pair1_pairs", "win3_4_running_context", "vrd6_7_sentence_lists", "str2_context_state"])
def test_images_are_judged_in_place(spark, name):
    said = plan(registry.queries()[name](spark, SF))
    assert said.count("lineitem.parquet") == 1
    assert said.count("Exchange hashpartitioning(image_id") == 1 and said.count("SortMergeJoin [image_id") == 0


def test_lists_of_verdicts_are_joined_once(spark):
    assert plan(registry.queries()["jn8_zip_join"](spark, SF)).count("lineitem.parquet") == 2  # a side each


def test_summary_reads_what_was_kept(spark):
    assert "lineitem.parquet" not in plan(registry.queries()["pair3_image_summary"](spark, SF))


def test_sentences_stay_where_answers_are_few(spark):
    assert "SortMergeJoin [coalesce" not in plan(registry.queries()["prv5_resolved"](spark, SF))


def test_groups_of_questions_are_not_sorted(spark):
    said = plan(registry.queries()["agg17_pair_scores"](spark, SF))
    assert "Window" not in said and "Sort" not in said


def test_bleu_shuffles_no_grams(spark):
    assert "hashpartitioning" not in plan(registry.queries()["agg24_bleu"](spark, SF))
