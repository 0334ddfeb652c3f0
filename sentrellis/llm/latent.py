"""Hashed TF-IDF rows of texts in Arrow batches, and randomised SVD of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, encoded, mix

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True


def _term(values: np.ndarray, kind: int, width: int) -> np.ndarray:
    return (mix(values.astype(np.uint64) * np.uint64(8) + np.uint64(kind)) % np.uint64(width)).astype(np.int64)


def text_terms(texts: list[bytes], width: int, shapes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term and count, sorted by row: words in lower case; with ``shapes`` also how words look, if they repeat
    the word before, and the text's length, word length, share of distinct words and of lines, each in coarse steps."""
    words = Words([t.lower() for t in texts])
    rows, terms = [words.text], [_term(words.hashes, 0, width)]
    if shapes:
        n = len(texts)
        raw = np.frombuffer(b"\n".join(texts), np.uint8)  # lower() keeps every byte's place
        first, last = raw[words.starts], raw[words.ends - 1]
        size = words.ends - words.starts
        upper = np.cumsum(np.concatenate(([0], _UPPER[raw])))
        uppers = upper[words.ends] - upper[words.starts]
        look = (uppers * 2 > size).astype(np.uint64) * np.uint64(4) + _UPPER[first] * np.uint64(2) + _DIGIT[first]
        plain = ((last | 32) >= ord("a")) & ((last | 32) <= ord("z")) | (last >= 128)
        look = look * np.uint64(256) + np.where(plain, 0, last).astype(np.uint64)
        rows.append(words.text)
        terms.append(_term(look, 1, width))
        again = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1]))
        count = np.maximum(words.counts, 1)
        echo = np.bincount(words.text[again], minlength=n) / count
        for step in (0, 1, 2, 3):  # a word that repeats the one before it, told apart by how often that happens
            some = again[echo[words.text[again]] * 8 >= step]
            rows.append(words.text[some])
            terms.append(_term(np.full(len(some), step), 6, width))
        own = np.unique(words.text * (1 << 40) + (words.hashes >> np.uint64(24)).astype(np.int64))
        distinct = np.bincount(own >> 40, minlength=n) / count
        length = np.bincount(words.text, size, minlength=n) / count
        breaks = np.array([t.count(b"\n") for t in texts])
        for kind, value in ((2, np.log2(count)), (3, length), (4, distinct * 10), (5, np.log2(1 + 8 * count / (1 + breaks)))):
            for step in (value, value + 0.5):
                rows.append(np.arange(n))
                terms.append(_term(np.floor(step) + 1000 * (step is not value), kind, width))
    key, count = np.unique(np.concatenate(rows) * width + np.concatenate(terms), return_counts=True)
    return key // width, key % width, count


def document_frequencies(docs: DataFrame, width: int, shapes: bool = True) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents: a task's counts are summed before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(width, np.int64), 0
        for batch in batches:
            texts = [t or b"" for t in encoded(batch["text"])]
            for a, b in chunks([len(t) for t in texts]):
                df += np.bincount(text_terms(texts[a:b], width, shapes)[1], minlength=width)
            n += len(texts)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1), pa.int32()), pa.array(np.append(df[term], n))], ["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(width + 1, np.int64)
    df[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return df[:width], int(df[width])


def idf_weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)


def tf_idf(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Weights of the entries, so that each row has length 1."""
    w = (1 + np.log(count.astype(np.float32))) * idf[term]
    norm = np.sqrt(np.bincount(row, w * w, minlength=rows))
    return w / np.maximum(norm, 1e-12)[row].astype(np.float32)


def project(row: np.ndarray, term: np.ndarray, w: np.ndarray, v: np.ndarray, rows: int) -> np.ndarray:
    """Rows times ``v``, each scaled to length 1 (0 stays 0)."""
    out = np.zeros((rows, v.shape[1]), np.float32)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for a in range(0, len(first), 1024):  # of so many rows at a time
            b = first[a + 1024] if a + 1024 < len(first) else len(row)
            part = slice(first[a], b)
            out[row[first[a : a + 1024]]] = np.add.reduceat(v[term[part]] * w[part, None], first[a : a + 1024] - first[a], axis=0)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)
