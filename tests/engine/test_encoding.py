"""The encoder against the public tokenizers, on all conversations; pairs from text against plain lists."""

import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from sentrellis.operators import encoding

FOLDER = "/opt/tokenizers"
SF = "/root/testdata/sf0.01"
ODD = ["", " ", "\n\n  x", "isn't it's we'll", "a" * 3000, "ab" * 2000, "é中文😀😀", "1234.5 %%% --", "\x00\x01", "a b　c", "   three   spaces   ", "<|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_ids(spark, name):
    path = f"{FOLDER}/{name}.tiktoken"
    ranks = encoding.read_ranks(path)
    library = tiktoken.Encoding(name, pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = encoding.Encoder(ranks)
    for text in ODD:
        assert own.encode(text) == library.encode_ordinary(text), text[:40]
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("text")
    for r in encoding.encoded(rows, ["text"], path, ends=True).collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert r["text_ids"] == ids and r["text_ends"] == [len(library.decode_bytes(ids[: k + 1])) for k in range(len(ids))]


def test_pairs_from_text(spark):
    path = f"{FOLDER}/byte_bpe_50k.tiktoken"
    library = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    ids = lambda text: library.encode(text, add_special_tokens=False).ids
    talks = [r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").filter("text is not null").orderBy("conv_id", "turn").limit(120).collect()]
    turn = lambda role, content: {"role": role, "content": content}
    rows = [(i, [turn("user", a)], [turn("assistant", b), turn("assistant", c)], "Be brief." if i % 3 else "", a[: a.find(".") + 1] if i % 2 else "") for i, (a, b, c) in enumerate(zip(talks, talks[1:], talks[2:], strict=False))]
    rows += [(-1, [turn("user", "x"), turn("assistant", "y")], rows[0][2], "", ""), (-2, rows[0][1], [turn("assistant", "alone")], "", "")]  # these drop
    kind = "id int, _prompt array<struct<role:string,content:string>>, _response array<struct<role:string,content:string>>, _system string, _context string"
    got = {r["id"]: r for r in encoding.encode_rows(spark.createDataFrame(rows, kind), path, encoding.Template(end=50256), cutoff=100_000).collect()}
    assert set(got) == set(range(len(rows) - 2))
    period, cut = ids(".")[0], 0
    for i, prompt, response, system, context in rows[:-2]:
        head = (ids(f"{system}\n") if system else []) + ids(f"USER: {prompt[0]['content']} ASSISTANT: ")
        for name, answer in zip(("chosen", "rejected"), response, strict=True):
            said = ids((f"{context} " if context else "") + answer["content"]) + [50256]
            if context and period in said:
                said = said[: len(said) - said[::-1].index(period)]
            every, labels = head + said, [-100] * len(head) + said
            if context:
                mark = ids(context)
                at = next((k for k in range(len(every) - len(mark) + 1) if every[k : k + len(mark)] == mark), None)
                if at is not None:
                    labels[: at + len(mark)] = [-100] * (at + len(mark))
                    cut += 1
            assert got[i][f"{name}_ids"] == every and got[i][f"{name}_labels"] == labels
    assert cut > 10


def test_no_rows(spark):
    rows = spark.createDataFrame([(None, 1), ("", 2)], "text string, row int")
    out = encoding.encoded(rows, ["text"], f"{FOLDER}/byte_bpe_50k.tiktoken", ends=True)
    assert [(r["row"], r["text_ids"], r["text_ends"]) for r in out.orderBy("row").collect()] == [(1, [], []), (2, [], [])]
    assert out.filter(F.lit(False)).collect() == []
