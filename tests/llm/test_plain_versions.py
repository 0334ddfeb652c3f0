"""Operators against plain versions on small tables, with odd rows: nulls, empty and long texts, ties, clashing names."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrellis.llm import decontam, language, lines, mixing, quality, queries, search, substrings

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, source string, size long, row string, copies int, n_words string, goes int"


def odd(spark, rows):
    """A table of (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s" if i and i % 2 else None, 7, "r", 1, "x", 2) for i, t in rows], KIND)


TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "One\x0btwo  three"), (5, "é É ü"), (6, "w " * 30_000), (7, "same text"), (8, "same text"), (8, "same text"), (None, "no id")]


def test_mix_of_odd_rows(spark):
    docs = odd(spark, TEXTS)
    out = mixing.mix_plan(docs).collect()
    assert len(out) == len(TEXTS)
    size = {r["row"]["text"]: r["size"] for r in out}
    assert (size[None], size[""], size[" \t\n"], size["One\x0btwo  three"], size["é É ü"]) == (0, 0, 0, 3, 2)
    assert all(0 <= r["copies"] <= 3 and r["target"] <= 3 * r["source_size"] for r in out)
    assert sum({r["row"]["source"]: r["target"] for r in out}.values()) == pytest.approx(sum(r["size"] for r in out))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 500), (None, 100)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    left, cap, weight = 1620.0, {"a": 3000, "b": 30, "c": 30, "d": 1500, None: 300}, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    free, want = set(cap), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            want |= share
            break
        want |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    assert got == pytest.approx(want)


def plain_lines(rows, least=40, docs=5):
    strip = " \t\n\x0b\f\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None:
                held[x.strip(strip).translate(low)].add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        goes = [i is not None and len(k := x.strip(strip).translate(low)) >= least and len(held[k]) >= docs and i != max(held[k]) for x in parts]
        out.append((i, len(parts), sum(goes), "\n".join(x for x, g in zip(parts, goes, strict=True) if not g)))
    return sorted(out, key=repr)


def test_lines(spark):
    shared, accents = "A line that a good many Documents share here", "É" * 39 + "x"
    rows = [(i, f"own {i}\n {shared.upper() if i % 2 else shared}\t\n{shared}\n{accents}\n{'é' * 39}\nend") for i in range(1, 8)] + TEXTS + [(3, shared)]
    docs = odd(spark, rows)
    got = lines.drop_shared_lines(docs).collect()
    assert sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got), key=repr) == plain_lines(rows)
    kept = lines.line_dedup(docs)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 1
    assert lines.line_dedup(docs.limit(0)).collect() == []


def plain_repeats(rows, n):
    held = collections.defaultdict(set)
    split = {k: (i, (t or "").encode().split()) for k, (i, t) in enumerate(rows)}
    for i, w in split.values():
        for j in range(len(w) - n + 1):
            if i is not None:
                held[tuple(w[j : j + n])].add(i)
    out = []
    for i, w in split.values():
        goes = set()
        for j in range(len(w) - n + 1):
            if i is not None and min(held[tuple(w[j : j + n])]) < i:
                goes |= set(range(j, j + n))
        out.append((i, len(w), len(goes), b" ".join(x for j, x in enumerate(w) if j not in goes).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 3, 13])
def test_repeats(spark, window):
    rng = np.random.default_rng(1)
    rows = [(i % 17, " ".join(f"w{x}" for x in rng.zipf(1.6, 60).clip(0, 30))) for i in range(40)] + TEXTS + [(20 + i, "the very same passage of words that all of these documents hold in full " * 2) for i in range(6)]
    got = substrings.remove_repeats(odd(spark, rows), window).collect()
    assert sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr) == plain_repeats(rows, window)


def test_repeats_with_equal_hashes(spark):
    words = substrings.Words([b"a b c d", b"e f g h"], hashed=False)
    text = substrings.pack(b"a b c d\ne f g h\na b c d", np.array([1, 2, 3]).tobytes(), np.arange(3, dtype=np.int32).tobytes(), np.array([1, 2, 3]).tobytes(), np.array([1, 2, 3]).tobytes(), np.zeros(3, np.int32).tobytes())
    old = substrings.span_hashes
    substrings.span_hashes = lambda v, a, b: np.zeros(len(a), np.uint64)
    try:
        got = [(int(d), int(a), int(b)) for part in substrings._repeats([text], 2) for d, a, b in zip(part[0], part[2], part[3], strict=True)]
    finally:
        substrings.span_hashes = old
    assert got == [(3, 0, 4)] and len(words.starts) == 8


@pytest.mark.parametrize("window", [3, 13])
def test_repeats_by_a_second_minimiser(spark, monkeypatch, window):
    rng = np.random.default_rng(5)
    rows = [(i % 17, " ".join(f"w{x}" for x in rng.zipf(1.6, 60).clip(0, 30))) for i in range(40)] + TEXTS
    words = substrings.Words([(t or "").encode() for _, t in rows])
    every = np.unique(substrings.super_kmers(words, window)[2])
    monkeypatch.setattr(substrings, "frequent_minimisers", lambda *_: every)
    got = substrings.remove_repeats(odd(spark, rows), window).collect()
    assert sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr) == plain_repeats(rows, window)


def test_one_minimiser_over_many_windows():
    """One gram that is the smallest of 100,000 distinct windows: by the second one they spread over the buckets."""
    rng = np.random.default_rng(6)
    candidates = [b" ".join(b"g%d" % (3 * i + j) for j in range(3)) for i in range(20_000)]
    words = substrings.Words(candidates)
    gram = candidates[int(np.argmin(substrings.super_kmers(words, 3)[2]))]  # windows of three words are grams
    texts = [b" ".join([*(b"u%d" % x for x in rng.integers(0, 1 << 40, 10)), *gram.split(), *(b"u%d" % x for x in rng.integers(0, 1 << 40, 10))]) for _ in range(10_000)]
    words = substrings.Words(texts)
    _, many, least = substrings.super_kmers(words, 13)
    key, at = np.unique(least, return_inverse=True)
    share = np.bincount(at, many)
    assert share.max() > 100_000
    frequent = key[share > share.sum() / 256]
    _, many, least = substrings.super_kmers(words, 13, frequent)
    assert np.bincount((least % np.uint64(64)).astype(int), many, minlength=64).max() < 3 * many.sum() / 64


def test_repeats_of_an_empty_table(spark):
    assert substrings.remove_repeats(odd(spark, TEXTS).limit(0)).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(2)
    good = [(int(i), [float(x) for x in rng.standard_normal(24).round(1)]) for i in range(300)]
    rows = good + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 24), (303, [float("inf")] * 24), (304, [1.0, 2.0]), (305, []), (7, good[7][1]), (7, good[9][1]), (50, good[8][1]), (None, good[3][1])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    takes_part = good + [(304, [1.0, 2.0]), (305, []), (7, good[7][1]), (7, good[9][1]), (50, good[8][1])]
    full = [(i, np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 24 - len(v)))).astype(int)) for i, v in takes_part]
    want = []
    for at, (q, v) in enumerate(full):
        if q % 50 == 0:
            best = sorted((-int(v @ theirs), x) for n, (x, theirs) in enumerate(full) if n != at)[:5]
            want += [(q, k + 1, x, -s) for k, (s, x) in enumerate(best)]
    got = search.top_k(table, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    few = search.top_k(table.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0, 5).collect()
    assert len(few) == 2
    assert search.top_k(table.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_top_k_prunes(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 64)) * 3
    v = np.floor(256 * (centres[np.arange(2000) % 20] + 0.1 * rng.standard_normal((2000, 64)))).astype(np.int64)
    s = search.Searcher(np.arange(40), v[:40].astype(float), 5)
    for a in range(0, 2000, 500):
        s.see(np.arange(a, a + 500), np.arange(a, a + 500), v[a : a + 500].astype(float))
    assert s.seen[-1] < 0.5 * 40 * 2000


def test_top_k_of_many_queries_is_bounded():
    """Equal vectors, so that every pair reaches the bar: what is kept stays k a query."""
    import resource

    n = 16_384
    v = np.tile(np.arange(1.0, 9.0), (n, 1))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    s = search.Searcher(np.arange(n), v, 5)
    s.see(np.arange(2048), np.arange(2048), v[:2048])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 * 1024
    q, ids, _ = s.found
    assert len(q) == 5 * n and ids[:5].tolist() == [1, 2, 3, 4, 5] and ids[-5:].tolist() == [0, 1, 2, 3, 4]


def test_top_k_of_large_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0]), (3, [1e12, 3.0]), (4, [1e12, 5.0]), (50, [1e12, 7.0])]
    got = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 3).collect()
    big = (1 << 63) - 1
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0] == [(1, big), (3, big), (4, big)]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 50] == [(0, big), (1, big), (3, big)]
    small = [(i, [float(a), 1.0]) for i, a in ((50, 3e6), (1, 3e6), (2, 3e6 + 1))]
    got = search.top_k(spark.createDataFrame(small, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 3).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 65536 * (3000000 * 3000001 + 1)), (1, 65536 * (3000000**2 + 1))]


def test_language_scores(spark):
    rows = [(i, t) for i, t in ((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())] + [(1000 + (i or 0), t) for i, t in TEXTS if i]
    got = language.score(odd(spark, rows)).collect()
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    unseen = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language.score(odd(spark, rows).limit(0)).collect() == []


def test_language_scores_use_every_context(spark):
    """Infrequent words after infrequent words: the right context says which comes next, however many there are."""
    word = lambda i: f"w{i:05d}x"
    train = [(i, " ".join(f"{word(k)} {word(k + 10_000)}" for k in range(i * 100, i * 100 + 100))) for i in range(100)] * 3
    inside = [i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    right, wrong = (" ".join(f"{word(k)} {word((k + by) % 10_000 + 10_000)}" for k in range(0, 10_000, 50)) for by in (0, 5000))
    got = {r["doc_id"]: r for r in language.score(odd(spark, [*train, (inside[0], right), (inside[1], wrong)])).collect() if r["held_out"]}
    a, b = got[inside[0]], got[inside[1]]
    assert a["base_score"] == pytest.approx(b["base_score"])
    assert a["score"] > b["score"] + 0.5 * 200


def test_quality_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs, labels).join(labels, F.col("row.doc_id") == labels["doc_id"]).select("row.doc_id", "score", "quality").collect()
    unseen = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    low, high = ([r["score"] for r in unseen if r["quality"] == k] for k in (0, 1))
    assert np.mean([a < b for a in low for b in high]) > 0.95
    assert np.mean([s >= quality.THRESHOLD for s in high]) > 0.98
    mixed = quality.score(odd(spark, TEXTS), labels).collect()
    assert len(mixed) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in mixed)
    assert quality.score(odd(spark, TEXTS), labels.limit(0)).first()["score"] == 0.5
    assert quality.quality_filter(odd(spark, TEXTS).limit(0), labels).collect() == []


def test_leaks(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    vocabulary = [word() for _ in range(3000)]
    say = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    items = [(k, " ".join(say(12) + ["end."] + say(12) + ["end."] + say(6))) for k in range(20)]
    rows, want = [], {}
    for i in range(200):
        text = say(int(rng.integers(0, 300)))
        if i % 10 == 0:
            leak = items[i // 10][1].split()
            if i % 20 == 0:  # an edited copy
                for at in range(3, len(leak) - 8, 9):
                    leak[at] = word()
            cut = int(rng.integers(0, len(text) + 1))
            text[cut:cut] = leak
            want[i] = [i // 10]
        rows.append((i, " ".join(text)))
    benchmark = spark.createDataFrame([*items, (99, None), (98, "the"), (97, "")], "item_id long, text string")
    got = {r["row"]["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.find_leaks(odd(spark, rows + [(500, None), (501, "")]), benchmark).collect()}
    assert {i: x for i, x in got.items() if x} == want
    assert decontam.decontaminate(odd(spark, rows), benchmark).count() == 180
    assert decontam.decontaminate(odd(spark, rows).limit(0), benchmark).collect() == []
    assert decontam.decontaminate(odd(spark, rows), benchmark.limit(0)).count() == 200


def test_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = (rng.integers(0, 6, rng.integers(0, 30)).tolist() for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontam.common_subsequence(a, b) == t[-1, -1]


def test_digests(spark):
    text = [(1, "x y"), (2, None)]
    out = lines.drop_shared_lines(odd(spark, text)).select(F.sha2(F.col("kept"), 256).alias("h")).collect()
    assert {r["h"] for r in out} == {hashlib.sha256(b"x y").hexdigest(), hashlib.sha256(b"").hexdigest()}
    assert set(queries.oracle_sql()) <= set(queries.queries())
