"""The divergence audit and the quality rules against plain versions."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrellis.llm import divergence, rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least, top):
    held, docs, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOW) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        held.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    kept = {lang: sorted(t for (x, t), n in docs.items() if x == lang and n >= least) for lang, _ in groups}
    every = collections.Counter()
    for (lang, source, t), n in held.items():
        if docs[lang, t] >= least:
            every[lang, t] += n

    def p(lang, of):
        total = sum(of(t) for t in kept[lang])
        return {t: 1 + 10**9 * (of(t) + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}

    own = {(lang, s): p(lang, lambda t, lang=lang, s=s: held[lang, s, t]) for lang, s in groups}
    whole = {lang: p(lang, lambda t, lang=lang: every[lang, t]) for lang in kept}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, s in groups:
        pairs = [(sum(f(own[lang, s][t], own[lang, o][t]) for t in kept[lang]), o) for x, o in groups if x == lang and o != s]
        terms = [(f(own[lang, s][t], whole[lang][t]), t) for t in kept[lang] if held[lang, s, t] and own[lang, s][t] > whole[lang][t]]
        for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
            for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                out.append((lang, s, part, item, value, k))
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_audit(spark, monkeypatch, least):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 30)  # texts are cut between terms; workers see the module afresh
    rng = np.random.default_rng(3)
    word = [f"Word{chr(97 + i)}é" if i % 3 else f"w{chr(97 + i)}" for i in range(26)]
    rows = [("en" if i % 4 else None, [None, "", "s1", "s2", "s10"][i % 5], "9".join(word[int(k) % 26] for k in rng.zipf(1.4, 40))) for i in range(90)]
    rows += [("xx", "alone", "wa wa"), ("yy", "none", None), ("yy", "other", "123"), ("en", "s1", "wa " * 5000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, n int, term int").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(docs, least, 4).collect())
    assert got == plain_audit(rows, least, 4)


def test_cells_are_all_terms(spark):
    docs = spark.createDataFrame([("en", f"s{i % 3}", f"{chr(97 + i % 7) * 3} {chr(98 + i % 5) * 3}") for i in range(60)], "lang string, source string, text string")
    terms = divergence.kept_terms(docs, 2)
    pairs = spark.createDataFrame([("en", "s0", "s1"), ("en", "s0", "s2"), ("en", "s1", "s2")], "lang string, a string, b string").withColumn("v", F.lit(terms.count()))
    cells = divergence.pair_cells(terms, pairs)
    assert cells.filter("n < 0 or x < 0 or y < 0").count() == 0
    assert {r["n"] for r in cells.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()} == {terms.count()}


def test_share_of_large_numbers(spark):
    rows = [(1, 3), (10**15, 9 * 10**15), (7 * 10**14 + 1, 10**15), (5, 5), (2, 10**15)]
    df = spark.createDataFrame(rows, "n long, total long")
    got = [r[0] for r in df.select(divergence._share(F.col("n"), F.col("total"))).collect()]
    assert got == [1 + 10**9 * n // total for n, total in rows]


CLEAN = " ".join(f"word{i} of{i} text{i}." for i in range(40))
RULED = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, CLEAN), (5, CLEAN.upper()), (6, "one two three " * 40), (7, " ".join(f"w{i}###" for i in range(60))), (8, "\n".join([CLEAN] + ["again and again"] * 5)),
    (9, "\n".join(f"- item{i} thing{i} more{i} yet{i} longer{i}" for i in range(30))), (10, "\n".join(f"line{i} goes{i} further{i} on{i}..." for i in range(30))), (11, " ".join(str(i) for i in range(80))), (12, " ".join("é" * 30 + str(i) for i in range(60))), (4, CLEAN), (13, "x y z " * 30_000),
]


def test_ledger(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in RULED], "doc_id long, text string, failed int").repartition(3)
    entries = rules.ledger(docs)
    got = {r["row"]["doc_id"]: r for r in entries.collect()}
    name = lambda bits: {n for k, n in enumerate(rules.RULES) if bits >> k & 1}
    want = {1: {"few_words"}, 2: {"few_words"}, 3: {"few_words"}, 4: set(), 5: {"capitals"}, 6: {"repeated_windows"}, 7: {"symbols"}, 8: {"repeated_lines"}, 9: {"bullets"}, 10: {"ellipses"}, 11: {"short_words", "few_letters"}, 12: {"long_words"}, 13: {"repeated_windows", "short_words"}}
    assert {i: name(r["failed"]) for i, r in got.items()} == want
    for i, text in RULED:
        words = (text or "").encode().split()
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"]) == (len(words), len(covered), sum(len(w.decode()) for w in words))
    kept = rules.quality_rules(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [4, 4]
    assert {r["doc_id"] for r in rules.quality_rules(docs, "v1").collect()} == {4, 8, 9, 10, 11, 12}


def test_ablations(spark):
    docs = spark.createDataFrame([(*r, "s" if r[0] % 2 else None) for r in RULED], "doc_id long, text string, source string")
    entries = rules.ledger(docs)
    bits = [r["failed"] for r in entries.collect()]
    got = {(r["policy"], r["rule"]): (r["n_docs"], r["n_rejected"], r["n_failed"], r["n_only"]) for r in rules.ablations(entries).collect()}
    names = list(rules.RULES)
    want = {}
    for policy, used in rules.POLICIES.items():
        lost = [{names[k] for k in range(len(names)) if b >> k & 1} & set(used) for b in bits]
        for rule in used:
            want[policy, rule] = (len(bits), sum(map(bool, lost)), sum(rule in x for x in lost), sum(x == {rule} for x in lost))
    assert got == want
    assert rules.ablations(entries.filter("false")).collect() == []
    any_of = {r["source"]: (r["n_docs"], r["any_failed"], r["all_failed"]) for r in rules.profiles(entries, "row.source").collect()}
    odd = [b for b, (i, _) in zip(bits, RULED, strict=True) if i % 2]
    assert any_of["s"] == (len(odd), int(np.bitwise_or.reduce(odd)), int(np.bitwise_and.reduce(odd)))
