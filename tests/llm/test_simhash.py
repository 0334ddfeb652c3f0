"""SimHash: fingerprints and components against a plain version, and odd rows."""

import numpy as np
import pytest
import xxhash

from sentrellis.llm import simhash

SF = "/root/testdata/sf0.001"


def plain(rows, shingle=3, max_bits=3):
    prints = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints[doc] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    label = {d: d for d in prints}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= max_bits:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (f"{prints[d]:016x}", root(d)) for d in ids}


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, cell int") if len(rows[0]) == 4 else spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.near_duplicates(docs, **options)
    return {r["doc_id"]: (r["h"], r["component_id"]) for r in out.withColumn("h", simhash.hex_digits(out["fp"])).collect()}


def test_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "a b c d " * 5000), (7, "a b c d " * 5000 + "e"), (8, "É é")]
    got = run(spark, rows)
    assert got == plain(rows)
    assert got[3] == ("0" * 16, 1)
    clash = [(*r, "x", 1) for r in rows]
    assert run(spark, clash) == got


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("max_bits,cell_rows", [(3, 16384), (3, 20), (5, 16384)])
def test_all_links_between_fingerprints(spark, max_bits, cell_rows):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            prints.add(int(c) ^ sum(1 << int(i) for i in flips))
    prints = np.array(sorted(prints), np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    edges = simhash.fingerprint_links(nodes, max_bits, cell_rows).collect()
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= max_bits
    want = _labels(len(prints), list(zip(*np.nonzero(near), strict=True)))
    at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    assert all((int(prints[at[e["a"]]]) ^ int(prints[at[e["b"]]])) >= 0 for e in edges)
    assert _labels(len(prints), [(at[e["a"]], at[e["b"]]) for e in edges]) == want


def _labels(n, pairs):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(int(a)), root(int(b))))
        label[y] = x
    return [root(i) for i in range(n)]
