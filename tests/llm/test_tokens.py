"""Token counts against a tokenizer library with the same vocabulary and rules."""

import pytest
from tokenizers import Tokenizer, models

from sentrellis.llm import tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    pieces = tokens.vocabulary()
    # The library finds bytes by their names, which no text here holds, and its unknown piece is no character of them.
    pieces += [("\ufdd0", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    return Tokenizer(models.Unigram(pieces, unk_id=len(pieces) - 257, byte_fallback=True))


def expected(library, text):
    return sum(len(library.encode(tokens.MARK + w.decode(), add_special_tokens=False).ids) for w in (text or "").encode().split())


def test_words(library):
    counter = tokens.Counter(tokens.vocabulary())
    for word in ("a", "the", "▁", "antidisestablishment", "\U0001f600x\U0001f600", "xé中z", "a<s>b", "the<unk>", "</s>", "a" * 3000, "\x00\x01", ""):
        assert counter[word.encode()] == expected(library, word), word


def test_special_pieces_are_no_pieces():
    pieces = {p for p, _ in tokens.vocabulary()}
    assert not pieces & {"<s>", "</s>", "<unk>", "<0x0A>", "<0xFF>"} and len(pieces) > 31_000
    counter = tokens.Counter(tokens.vocabulary())
    assert counter[b"a<s>b"] == 5 and counter["\U00012345".encode()] == 5  # the word mark, then four bytes


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in tokens.token_counts(docs).select("row.text", "n_tokens").collect():
        assert r["n_tokens"] == expected(library, r["text"])


def test_odd_rows(spark, library):
    rows = [(1, None, 1), (1, None, 1), (2, "", 2), (3, " \t\r\n", 3), (4, "two words", 4), (5, "w" * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs).select("row.doc_id", "n_tokens").collect()}
    assert got == {i: expected(library, t) for i, t, _ in rows}
    assert tokens.token_counts(docs.limit(0)).collect() == []
