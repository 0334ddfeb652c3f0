"""The similarity join against all pairs, how many it compares, and AMBER's similar words."""

import re

import numpy as np
import pyarrow as pa
import pytest

from sentrellis.operators import metrics, similarity
from sentrellis.plans import registry


def pairs(a, b, least):
    out = set()
    for i, x in a:
        for j, y in b:
            if x is None or y is None or not all(v is not None and np.isfinite(v) for v in (*x, *y)):
                continue
            n = max(len(x), len(y))
            x_, y_ = (np.pad(np.array(v, float), (0, n - len(v))) for v in (x, y))
            if np.abs(x_).max(initial=0) > 0 and np.abs(y_).max(initial=0) > 0:
                x_, y_ = x_ / np.abs(x_).max(), y_ / np.abs(y_).max()
                if x_ @ y_ / np.sqrt(x_ @ x_ * (y_ @ y_)) > least:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("least,cell,block", [(0.3, 4096, 8192), (0.8, 20, 16), (0.95, 7, 5)])
def test_all_pairs(spark, monkeypatch, least, cell, block):
    monkeypatch.setattr(similarity, "CELL_ROWS", cell)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 24))
    rows = [(i, (centres[i % 9] + rng.normal(size=24) * (0.1, 0.4, 2)[i % 3]).tolist()) for i in range(240)]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [1.0, None]), (304, [float("nan")] * 24), (305, [1e300] * 24), (306, [1e-300, 2e-300]), (307, [3.0, 6.0]), (1, rows[1][1])]
    kind = "id long, vector array<double>"
    left, right = spark.createDataFrame(rows[::2] + rows[240:], kind).repartition(3), spark.createDataFrame(rows, kind).repartition(4)
    seen = similarity.seen_counter(spark)
    got = similarity.similar_pairs(left, right, least, seen=seen).collect()
    assert {(r["l_id"], r["r_id"]) for r in got} == pairs(rows[::2] + rows[240:], rows, least)
    every, met, *levels, found = seen.value.tolist()
    assert found == len(got) and [every, met, *levels, found] == sorted([every, met, *levels, found], reverse=True)
    assert similarity.similar_pairs(left.limit(0), right, least).collect() == [] and similarity.similar_pairs(left, right.limit(0), least).collect() == []


def test_compares_few(spark):
    """Whole vectors of the driver's table, which have no structure, and clustered ones: under a tenth get the exact cosine."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    seen = similarity.seen_counter(spark)
    n = similarity.similar_pairs(rows, rows, 0.4, seen=seen).count()
    every, *_, exact, found = seen.value.tolist()
    assert n == found > 2000 and exact < every / 10
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    words = spark.createDataFrame([(i, (centres[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(4000)], "id long, vector array<double>")
    similarity.CELL_ROWS, held = 100, similarity.CELL_ROWS
    try:
        seen = similarity.seen_counter(spark)
        similarity.similar_pairs(words, words, 0.9, seen=seen).count()
        every, met, *_, found = seen.value.tolist()
        assert found >= 40 * 100 * 90 and met < every / 3  # cells far away are not met at all
    finally:
        similarity.CELL_ROWS = held


def test_amber_words(spark):
    associations = spark.createDataFrame([("dog", ["puppy"]), ("car", ["taxi", "cab"]), ("tree", []), ("ball", [])], "word string, associated array<string>")
    similar = spark.createDataFrame([("taxi", "ball"), ("tree", "puppy"), ("tree", "cab"), ("cab", "cab")], "noun string, word string")
    score = lambda rows, safe=(): metrics.amber_generative(spark.createDataFrame(rows, "id int, nouns array<string>, truth array<string>, hallu array<string>"), associations, spark.createDataFrame([(w,) for w in safe], "word string"), similar).first()
    # The puppy stands for the dog; the sky is no known noun; the tree is near the puppy, and near the cab, a misleading word.
    r = score([(1, ["puppy", "sky", "tree"], ["dog", "ball"], ["car"])])
    assert (r["chair"], r["cover"], r["hal"], r["cog"]) == (0.0, 50.0, 0.0, 100.0)
    # The cab is misleading and near no safe word; the taxi is misleading, but near the ball, which is safe.
    r = score([(1, ["cab", "taxi", "cab"], ["ball"], ["car", "tree"])])
    assert (r["chair"], r["cover"], r["hal"], r["cog"]) == (66.7, 100.0, 100.0, 50.0)
    # Always safe nouns count, but cover nothing; an answer without truth has nothing to cover.
    r = score([(1, ["cab"], [], ["car"]), (2, [], ["dog"], [])], ["cab"])
    assert (r["chair"], r["cover"], r["hal"], r["cog"]) == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("first", [(4096, 16384), (3, 5), (1, 1)])
def test_first_similar(spark, monkeypatch, first):
    """The first partner of a group, from whichever round it comes, against all pairs."""
    monkeypatch.setattr(similarity, "FIRST_ROWS", first)
    rng = np.random.default_rng(4)
    rows = [(i, i % 4 if i % 11 else None, rng.normal(size=8).tolist()) for i in range(160)] + [(200, 1, None), (201, 1, [0.0] * 8), (7, 3, rng.normal(size=8).tolist()), (202, 2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    got = {(r["label"], r["vec_id"]): r["match"] for r in similarity.similar_first(df, df, ["label"], "embedding", 0.6, "vec_id").collect()}
    want = {}
    for g in range(4):
        own = [(i, x) for i, label, x in rows if label == g]
        for i, j in pairs(own, own, 0.6):
            if i != j:
                want[g, i] = min(j, want.get((g, i), j))
    assert got == want


def test_first_similar_compares_few(spark, monkeypatch):
    """No pairs of all rows where first partners are early."""
    monkeypatch.setattr(similarity, "similar_pairs", None)
    rows = spark.range(30000).selectExpr("id", "id % 5 AS g", "array(1.0D, CAST(id % 7 AS DOUBLE)) AS v")
    assert similarity.similar_first(rows, rows, ["g"], "v", 0.5, "id").count() == 30000


def test_amber_joins_answers_first(spark):
    """Similar words of a noun that its answer does not hold make no rows: the pairs are joined by both of their words."""
    associations = spark.createDataFrame([("dog", ["puppy"])], "word string, associated array<string>")
    answers = spark.createDataFrame([(1, ["puppy"], ["dog"], ["dog"])], "id int, nouns array<string>, truth array<string>, hallu array<string>")
    similar = spark.range(1000).selectExpr("concat('n', id % 7) AS noun", "concat('w', id) AS word")
    said = metrics.amber_generative(answers, associations, spark.createDataFrame([], "word string"), similar)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi, \(\(noun#\d+ = noun#\d+\) AND \(word#\d+ = word#\d+\)\)", said)


@pytest.mark.parametrize("block,at_once", [(65536, 8192), (20, 7)])
def test_among_given_pairs(spark, monkeypatch, block, at_once):
    """What a semi-join with all pairs leaves: asked twice or never, unknown and null ids, ids of several vectors or none."""
    monkeypatch.setattr(similarity, "AMONG_ROWS", block)
    monkeypatch.setattr(similarity, "AMONG_PAIRS", at_once)
    rng = np.random.default_rng(3)
    rows = [(f"w{i % 70}", rng.normal(size=6).tolist()) for i in range(90)] + [("w80", None), ("w81", [0.0] * 6), ("w82", [float("nan")] * 6), (None, [1.0] * 6), ("w83", [1.0, 2.0])]
    ids = [*(f"w{i}" for i in range(75)), "w80", "w81", "w82", "w83", "x", None]
    asked = [(k, a, b, {"k": k}) for k, (a, b) in enumerate((a, b) for a in ids for b in ids if a != "w9" and (a is None or a != b or a == "w3"))] + [(-1, "w3", "w3", {"k": 1})] * 2
    words, table = spark.createDataFrame(rows, "id string, vector array<double>").repartition(3), spark.createDataFrame(asked, "k int, noun string, word string, more struct<k: int>").repartition(2)
    near = pairs(rows, rows, 0.3)
    want = [(k, a, b) for k, a, b, _ in asked if a and b and (a, b) in near]
    got = similarity.similar_among(table, words, 0.3, ("noun", "word"))
    assert got.schema == table.schema
    said = got.collect()
    assert sorted((r["k"], r["noun"], r["word"]) for r in said) == sorted(want) and len(want) > 500 and all(r["more"]["k"] == abs(r["k"]) for r in said)
    assert similarity.similar_among(table, words.limit(0), 0.3, ("noun", "word")).collect() == [] and similarity.similar_among(table.limit(0), words, 0.3, ("noun", "word")).collect() == []
    held = [(pa.array([i for i, _ in rows[:90]]), similarity._unit(np.array([v for _, v in rows[:90]])))]
    sides = [pa.array([x[k] for x in asked]) for k in (1, 2)]
    known = similarity._by_id(held)
    first = {(i, j) for i, j in pairs(rows[:90], rows[:90], 0.3)}
    assert similarity._alike(known, known, *sides, 0.3).tolist() == [(a, b) in first for _, a, b, _ in asked]


def test_dealt_batches_are_small(spark, monkeypatch):
    """A batch does not grow with the number of cells that its vectors go to."""
    monkeypatch.setattr(similarity, "DEALT", 1000)
    rng = np.random.default_rng(5)
    pivots, vectors = similarity._unit(rng.normal(size=(50, 8))), rng.normal(size=(1300, 8))

    class Rows:
        sparkSession, dtypes, mapInArrow = spark, [("id", "bigint")], staticmethod(lambda deal, kind: deal)  # noqa: N815

    deal = similarity._cells(Rows, pivots, 3.0, np.full(50, 3.0))
    batches = list(deal(iter([pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(vectors.tolist())], ["id", "v"])])))
    assert max(map(len, batches)) == 1000 and sum(map(len, batches)) == 1300 * 50
    assert len({(i, c) for b in batches for i, c in zip(b["id"].to_pylist(), b["cell"].to_pylist(), strict=True)}) == 1300 * 50


def test_amber_compares_what_answers_ask(spark, monkeypatch):
    """The query makes no pairs of all words."""
    monkeypatch.setattr(similarity, "similar_pairs", None)
    assert registry.queries()["agg11_amber_generative"](spark, "/root/testdata/sf0.001").count() == 1
