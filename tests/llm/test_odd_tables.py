"""Every operator and stage on tables with clashing or awkward column names, null ids, repeated rows and no rows."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrellis.llm import alignment, common, copies, decontam, divergence, language, lines, mixing, quality, rules, secrets, simhash, substrings, tokens

NAMES = ["my col", "a.b", "stays", "row", "of", "key", "holder_", "leaks", "score", "goes", "n_words", "base", "label", "copies", "kept"]
KIND = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` int" for n in NAMES)
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 2
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (5, LONG), (None, "no id"), (None, None), (6, "w " * 20_000), (7, "password = abcdefgh x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s" if i and i % 2 else None, 7, *range(len(NAMES))) for i, t in TEXTS], KIND)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, LONG), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (4, 1), (7, 1), (None, 1), (9, None)], "doc_id long, quality int")


OPERATORS = {
    "mixing": lambda d, b, q: mixing.mix_plan(d),
    "language": lambda d, b, q: language.score(d),
    "decontam": lambda d, b, q: decontam.find_leaks(d, b),
    "secrets": lambda d, b, q: secrets.find_secrets(d),
    "quality": lambda d, b, q: quality.score(d, q),
    "lines": lambda d, b, q: lines.drop_shared_lines(d),
    "tokens": lambda d, b, q: tokens.token_counts(d),
    "simhash": lambda d, b, q: simhash.near_duplicates(d),
    "near_copies": lambda d, b, q: copies.near_copies(d),
    "substrings": lambda d, b, q: substrings.remove_repeats(d),
    "alignment": lambda d, b, q: alignment.align(d),
    "rules": lambda d, b, q: rules.ledger(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(docs, benchmark, labels, name):
    got = OPERATORS[name](docs, benchmark, labels)
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    if name == "alignment":
        assert got.select("row.*").columns == [c for c in docs.columns if c != "text"]
    elif "row" in got.columns:
        assert got.select("row.*").columns == docs.columns
        assert sorted(map(repr, (r["row"] for r in rows))) == sorted(map(repr, docs.collect()))
    assert OPERATORS[name](docs.limit(0), benchmark, labels).collect() == []


def test_divergence_of_odd_rows(docs):
    # One language of two sources, null being one of them; a term's documents are rows.
    got = divergence.audit(docs, min_docs=2)
    assert {(r["lang"], r["source"], r["item"]) for r in got.filter("part = 'pair'").collect()} == {("en", "s", ""), ("en", "", "s")}
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert divergence.audit(docs.limit(0)).collect() == []


def test_filters(docs, benchmark, labels):
    for out in (simhash.simhash_dedup(docs), copies.copy_dedup(docs)):
        kept = out.collect()
        assert out.columns == docs.columns
        # Texts without words are one group, the copies of LONG another; equal rows stay together.
        assert sorted((r["doc_id"] for r in kept), key=repr) == [1, 4, 6, 7, None][: len(kept)]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, benchmark).filter("doc_id in (4, 5)").collect()] == []


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, benchmark, labels, tmp_path, stage):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    call = dict(corpus_pipeline.STAGES)[stage]
    out = call(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    every = set(map(repr, docs.collect()))
    assert stage == "lines" or set(map(repr, out.collect())) <= every
    assert call(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_word_hashes():
    rng = np.random.default_rng(9)
    words = {rng.bytes(int(n)).translate(bytes(range(33, 127)) + bytes([33]) * 162) for n in rng.integers(1, 40, 5000)} | {b"x" * n for n in range(1, 600)}
    words = sorted(words)
    got = common.Words([b" ".join(words), b" ".join(words[::-1])]).hashes
    assert len(set(got[: len(words)].tolist())) == len(words) and (got[: len(words)] == got[len(words) :][::-1]).all()
    a, b = [b"ab"], [b"ba"]  # Thue-Morse words, which sums of powers modulo 2 ** 64 cannot tell apart
    for _ in range(10):
        a, b = a + b, b + a
    x, y = common.Words([b"".join(a) + b" " + b"".join(b)]).hashes
    assert x != y


def test_discard(spark):
    held = common.materialise(spark.range(5))
    assert held.count() == 5
    common.discard(held)
    with pytest.raises(Exception, match="(?i)exist|not.?found"):
        spark.read.parquet(held.written_to).count()


def test_text_of_stage_keeps_null(spark, docs):
    assert lines.line_dedup(docs).filter(F.col("text").isNull()).count() == 2
