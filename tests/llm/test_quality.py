"""The quality classifier's votes against all neighbours in plain loops, one document at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrellis.llm import quality

SF = "/root/testdata/sf0.01"


def plain(x, model, neighbours):
    cos = [float(np.dot(x, v)) for v in model["vectors"]]
    near = sorted(range(len(cos)), key=lambda i: -cos[i])[:neighbours]
    weight = {i: max(cos[i], 1e-6) * model["rarity"][i] for i in near}
    return sum(w * model["labels"][i] for i, w in weight.items()) / sum(weight.values())


@pytest.mark.parametrize("neighbours", [1, quality.NEIGHBOURS, 10**6])
def test_votes_are_those_of_all_neighbours(spark, neighbours):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.fit(docs, labels, ~quality.held_out(F.col("of")), 200)
    assert len(model["vectors"]) == 200
    texts = [(r["text"] or "").encode() for r in docs.orderBy("doc_id").select("text").collect()][:300] + [b"", b" ", b"unheard-of words", b"w " * 50_000]
    got = quality.votes(texts, model, neighbours)
    row, term, count = quality.text_terms(texts, quality.WIDTH)
    x = quality.project(row, term, quality.tf_idf(row, term, count, model["idf"], len(texts)), model["v"], len(texts))
    assert got == pytest.approx([np.clip(plain(v, model, neighbours), 0, 1) for v in x], abs=1e-5)


def test_score_of_the_query_is_the_vote(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.fit(docs, labels, ~quality.held_out(F.col("of")))
    rows = quality.score(docs.select("doc_id", "text"), labels).orderBy("row.doc_id").collect()
    want = quality.votes([(r["row"]["text"] or "").encode() for r in rows], model)
    assert [r["score"] for r in rows] == pytest.approx(want.tolist(), abs=1e-6)
