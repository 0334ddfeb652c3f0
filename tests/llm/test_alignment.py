"""Alignment against whole texts encoded by the libraries and compared end by end."""

import collections
import hashlib

import numpy as np
import pytest

from sentrellis.llm import alignment

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "\n", "a▁b", "▁", "<|endoftext|> and <s>x</s> <unk> <0x0A>", "tab\tand\n\nlines \n of  two   spaces ", "  lead", "\x00z \x01",
    "\U0001f600 smile\U0001f600\U0001f680x", "nb\xa0space　wide   line", "é́ ﬁ ", "中文字符没有空格" * 400, "x" * 5000, "word " * 3000, "isn't it's I'll 123 4,567.89 !!! ???", "same text", "same text",
]


@pytest.fixture(scope="module")
def encoders():
    return alignment.Encoders(*(open(p, "rb").read() for p in (alignment.MODEL_A, alignment.MODEL_B)))


def plain(encoders, texts):
    """One dictionary for each text."""
    out, count = [], collections.Counter()
    for text in texts:
        data, groups, pairs, a, b = b" " + (text or "").encode(), [], [], [], []
        if text:
            a = encoders.a.encode(" " + text, add_special_tokens=False).ids
            b = encoders.b.encode(text)
            if any(b"".join(names[i] for i in ids) != data for ids, names in ((a, encoders.bytes_a), (b, encoders.bytes_b))):
                a, b = [], []
        ends = [dict(zip(np.cumsum([len(names[i]) for i in ids]).tolist(), range(1, len(ids) + 1), strict=True)) for ids, names in ((a, encoders.bytes_a), (b, encoders.bytes_b))]
        i = j = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            pairs.append((a[k - 1], b[m - 1]))
            i, j = k, m
        count.update(pairs)
        out.append({"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": len(pairs), "pairs": pairs, "groups_sha256": hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""})
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for r in out:
        pairs = r.pop("pairs")
        r |= {"n_best": sum(count[p] == most[p[1]] for p in pairs), "count_sum": sum(count[p] for p in pairs)}
    return out


@pytest.mark.parametrize("hot", [alignment.HOT, 40, 1])
def test_against_whole_texts(spark, encoders, hot):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["row"]["doc_id"]: r.asDict() for r in alignment.align(docs, hot=hot).collect()}
    for i, want in enumerate(plain(encoders, texts)):
        assert {k: got[i][k] for k in want} == want, texts[i] and texts[i][:60]


def test_pieces_forgotten(encoders, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    texts = [f"a{i} b{i % 5} the same words and ▁ {'' if i % 3 else '▁'}" if i % 4 else f"plain {i % 7} words" for i in range(40)]
    aligner, found = alignment.Aligner(encoders), []
    for lo in range(0, 40, 8):
        part = alignment._aligned(aligner, [t.encode() for t in texts[lo : lo + 8]])
        found += zip(part["counts"].tolist(), part["sha"], strict=True)
    for (counts, sha), want in zip(found, plain(encoders, texts), strict=True):
        assert counts == [want["n_a"], want["n_b"], want["n_links"]] and sha == want["groups_sha256"]


def test_overlaps():
    rng = np.random.default_rng(5)
    a, b = (np.unique(np.append(rng.integers(1, 500, 90), 500)) for _ in range(2))
    starts = [np.concatenate(([0], x[:-1])) for x in (a, b)]
    low, high = alignment.overlaps(starts[0], a, starts[1], b)
    for i in range(len(a)):
        assert list(range(low[i], high[i])) == [k for k in range(len(b)) if starts[1][k] < a[i] and starts[0][i] < b[k]]
