"""Quality by nearest-neighbour voting over latent-semantic vectors.

Inverse document frequencies come from all documents. A sample of the labelled documents, ``REFERENCE_ROWS`` at most
(the smallest hashes of their ids), gives the latent space by randomised SVD and is the reference set: its vectors
have a fixed size bound and are broadcast. Every document's cosines with all of them are computed exactly, in
blocks; its score is the mean label of the ``NEIGHBOURS`` nearest, weighted by similarity and by how rare a label is
among the references, so that 0.5 says that both labels are as common here as there.

Only the text enters a score. Defined cases: a null or empty text is scored as a text without words; labels that
are null or belong to no document are not learned from; several labels of one document count as their mean; of several documents with a labelled id one is a reference;
without any learnable label every score is 0.5; an empty table gives an empty result; further columns of any name
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, encoded, prepare, with_row
from .latent import document_frequencies, idf_weights, project, text_terms, tf_idf

WIDTH = 1 << 14
DIMENSIONS = 48
REFERENCE_ROWS = 4096
NEIGHBOURS = 24
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _entries(docs: DataFrame) -> DataFrame:
    """of, label and packed terms and counts of the reference rows."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, packed = [t or b"" for t in encoded(batch["text"])], []
            for a, b in chunks([len(t) for t in texts]):
                row, term, count = text_terms(texts[a:b], WIDTH)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                packed += [term[i:j].astype("<u2").tobytes() + count[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch["of"], batch["label"], pa.array(packed, pa.binary())], ["of", "label", "packed"])

    return docs.mapInArrow(one, "of long, label double, packed binary")


def randomised_svd(row: np.ndarray, term: np.ndarray, w: np.ndarray, rows: int, width: int, k: int) -> np.ndarray:
    """The k right singular vectors (width x k) of sparse rows, by subspace iteration on blocks of rows."""
    basis = np.random.default_rng(7).standard_normal((width, k + 12)).astype(np.float32)
    cut = np.searchsorted(row, np.arange(0, rows + 128, 128))
    for _ in range(3):
        basis, _ = np.linalg.qr(basis)
        new = np.zeros_like(basis)
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            block = np.zeros((128, width), np.float32)
            block[row[a:b] - 128 * i, term[a:b]] = w[a:b]
            new += block.T @ (block @ basis)
        basis = new
    q, r = np.linalg.qr(basis)
    left, _, _ = np.linalg.svd(r @ r.T)
    return np.ascontiguousarray((q @ left[:, :k]).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, learns: Column, reference_rows: int = REFERENCE_ROWS) -> dict | None:
    """The broadcastable model: idf, right singular vectors, reference vectors and their labels."""
    prepare(docs.sparkSession)
    df, n = document_frequencies(docs, WIDTH)
    idf = idf_weights(df, n)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("of"), "quality").filter(learns)
    known = known.groupBy("of").agg(F.avg("quality").alias("label")).join(docs.select(F.col("doc_id").alias("own")), F.col("of") == F.col("own"), "left_semi").orderBy(F.xxhash64(F.col("of"), F.lit("quality")), "of").limit(reference_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("of")).select("of", "label", "text")
    got = _entries(sample).groupBy("of").agg(F.first("label").alias("label"), F.min("packed").alias("packed")).orderBy("label", "packed").toArrow()
    if not got.num_rows:
        return None
    rows, terms, counts = [], [], []
    for i, packed in enumerate(got["packed"].to_pylist()):
        m = len(packed) // 6
        rows.append(np.full(m, i, np.int32))
        terms.append(np.frombuffer(packed, "<u2", m))
        counts.append(np.frombuffer(packed, "<u4", m, 2 * m))
    row, term, count = np.concatenate(rows), np.concatenate(terms).astype(np.int32), np.concatenate(counts)
    del rows, terms, counts
    w = tf_idf(row, term, count, idf, got.num_rows)
    v = randomised_svd(row, term, w, got.num_rows, WIDTH, DIMENSIONS)
    labels = got["label"].to_numpy().astype(np.float64)
    high = min(max(labels.mean(), 0.05), 0.95)
    return {"idf": idf, "v": v, "vectors": project(row, term, w, v, got.num_rows), "labels": labels, "rarity": labels / high + (1 - labels) / (1 - high)}


def votes(texts: list[bytes], model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of texts: one block of cosines with all reference vectors."""
    row, term, count = text_terms(texts, len(model["idf"]))
    x = project(row, term, tf_idf(row, term, count, model["idf"], len(texts)), model["v"], len(texts))
    labels, out = model["labels"], np.empty(len(texts))
    k = min(neighbours, len(labels))
    for a in range(0, len(x), 256):
        cos = x[a : a + 256] @ model["vectors"].T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-6).astype(np.float64)
        weight *= model["rarity"][near]
        out[a : a + 256] = (weight * labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, labels: DataFrame, learns: Column | None = None, reference_rows: int = REFERENCE_ROWS) -> DataFrame:
    """``row`` (the document's own columns) and score. ``learns`` says of a label's id, ``of``, if it is learned."""
    learns = ~held_out(F.col("of")) if learns is None else learns
    model = fit(docs, labels, learns, reference_rows)
    own = docs.select(F.struct("*").alias("row"))
    if model is None:
        return own.withColumn("score", F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in encoded(batch["text"])]
            parts = [votes(texts[a:b], sent.value) for a, b in chunks([len(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["row", "score"])

    return own.select("row", F.col("row.text").alias("text")).mapInArrow(each, with_row(own, "score double"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold."""
    return score(docs, labels).filter(F.col("score") >= threshold).select("row.*")
