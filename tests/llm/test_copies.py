"""Near copies: every pair with a five-word Jaccard similarity of 0.8 or more is linked, and no other."""

import corpus_pipeline
import numpy as np
import pytest

from sentrellis.llm import copies


def plain(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def edited(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 5000)}"
    rows = [(900, None), (901, " \t"), (902, "One two"), (903, "one  TWO"), (904, "one three")]
    for i in range(30):
        text = [word() for _ in range(int(rng.integers(60, 200)))]
        rows.append((4 * i, " ".join(text)))
        for k in range(1, 4):
            copy = list(text)
            for at in rng.choice(len(text), int(rng.integers(1, 6)), replace=False):
                copy[at] = word()
            rows.append((4 * i + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("bucket_rows,bucket_bytes", [(2048, 32 << 20), (2, 32 << 20), (2048, 2000)])
def test_against_plain_version(spark, bucket_rows, bucket_bytes):
    rows = edited()
    got = copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows, bucket_bytes)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == plain(rows)


def test_stage_drops_edited_copies(spark):
    rows = edited(5)
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == set(plain(rows).values())
    assert corpus_pipeline.drop_copies(spark, kept.limit(0), "").collect() == []


def test_recall_on_the_larger_table(spark):
    """All pairs of different texts at 0.8 or more that share a shingle held by 200 documents at most, by an inverted index, lie in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets, of = {}, {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {hash(tuple(w[k : k + 5])) for k in range(max(len(w) - 4, 1))}
        for s in sets[r["doc_id"]]:
            of.setdefault(s, []).append(r["doc_id"])
    pairs = set()
    for some in of.values():
        if 1 < len(some) <= 200:
            for i, a in enumerate(some):
                x = len(sets[a])
                pairs.update((a, b) for b in some[i + 1 :] if 0.8 * x <= len(sets[b]) <= x / 0.8)
    near = [(a, b) for a, b in pairs if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs).collect()}
    missed = [p for p in near if label[p[0]] != label[p[1]]]
    print(f"{len(near)} pairs, {len(missed)} missed")
    assert len(near) > 250 and not missed


def test_linked_fingerprints_share_a_bucket(spark):
    """Nodes without a common MinHash bucket are compared if their fingerprints are in one SimHash component."""
    rows = [(1, 1, 1, 9, 0, [1]), (2, 2, 2, 9, 7, [2]), (3, 3, 3, 9, 63, [3]), (4, 4, 4, 9, -1, [4]), (5, 5, 5, 9, -1, [5])]
    nodes = spark.createDataFrame(rows, "fp long, first long, holder long, size long, sim long, bands array<long>")
    got = {r["fp"]: r["bands"] for r in copies._with_sim_bucket(nodes).collect()}
    assert [got[k][0] for k in range(1, 6)] == [1, 2, 3, 4, 5] and {len(b) for b in got.values()} == {2}
    assert got[1][1] == got[2][1] == got[3][1] != got[4][1] == got[5][1]
