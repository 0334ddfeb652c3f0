"""Exact top-k by inner product with multi-resolution segment statistics.

Over a segment of l components, the product of two vectors is at most l (m m' + s s') with their means m and
deviations s: the same as the usual lower bound of a distance, once norms are known. Sums of these bounds over a
few long segments, then over many short ones, leave the pairs that can still reach a query's k-th best score;
those get the exact integer product. The bar of each query starts from a bounded hashed sample of candidates.

Queries are a stated set of rows held against all rows, in blocks of ``QUERY_BYTES``: one block at a time is
broadcast, its size fixed, whatever the table holds. A task returns k rows a query at most, and none under the bar.

Defined cases: vectors that are null or hold null, non-finite or (as doubles) components over 1e300 take no part, nor
do rows without an id, which could not be named; every other row is a candidate, and a query if its id says so, so
rows with the same id are each held against each other; shorter vectors are padded with zeros; ties go to the smaller
id; fewer candidates than k give fewer rows; products beyond 2 ** 53 are computed in whole numbers of any size and
those beyond a long are given as the nearest long; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, prepare

#: Bytes of the vectors of a block of queries.
QUERY_BYTES = 16 << 20
SAMPLE = 4096
SEGMENTS = (4, 16)
CHUNK = 2048
#: Queries that are held against a chunk at a time, and the share of pairs from which dense products are cheaper.
PART, DENSE = 1024, 0.05
_EXACT = 2.0**53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """row_id, vec_id and v: components floor(scale * x) as double, of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300))
    own = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(finite)

    def floor(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)  # larger ones are whole

    return own.select(F.monotonically_increasing_id().alias("row_id"), "vec_id", F.transform("embedding", floor).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that their dot product bounds the inner product."""
    width = v.shape[1]
    cuts = np.linspace(0, width, min(segments, width) + 1).astype(int)
    parts = [v[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.hstack([np.stack([p.mean(axis=1) * np.sqrt(p.shape[1]), p.std(axis=1) * np.sqrt(p.shape[1])], axis=1) for p in parts]) if parts else np.zeros((len(v), 1))


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows ``i`` of ``a`` and ``j`` of ``b``: all of them at once where most are wanted anyway."""
    if len(i) > DENSE * len(a) * len(b):
        return (a @ b.T)[i, j]
    return np.einsum("nd,nd->n", a[i], b[j])


def _whole_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products in whole numbers of any size, the nearest long of each."""
    a, b = ([[int(x) for x in row] for row in v] for v in (a, b))
    exact = (sum(x * y for x, y in zip(a[p], b[q], strict=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True))
    return np.array([min(max(x, _LEAST), _MOST) for x in exact], np.int64)


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores, q))  # ~ turns the order of all whole numbers round
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], ids[rank < k], scores[rank < k]


class Searcher:
    """The k best of the candidates seen so far for a block of queries; ``seen`` counts pairs left at each level."""

    def __init__(self, rows: np.ndarray, v: np.ndarray, k: int, bar: np.ndarray | None = None):
        self.rows, self.v, self.k = rows, v, k
        self.levels = [statistics(v, s) for s in SEGMENTS]
        self.norm = _norms(v)
        self.bar = np.full(len(rows), -np.inf) if bar is None else bar.copy()
        self.tied = np.full(len(rows), _MOST)  # the id that a score equal to the bar must be under
        none = np.zeros(0, np.int64)
        self.parts = {a: (none, none, none) for a in range(0, len(rows), PART)}
        self.seen = np.zeros(len(SEGMENTS) + 1, np.int64)

    def see(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        levels, norm = [statistics(v, s) for s in SEGMENTS], _norms(v)
        for a, found in self.parts.items():
            part = slice(a, a + PART)
            bar, tied, own = self.bar[part], self.tied[part], self.v[part]
            most = self.norm[part].max(initial=0) * norm.max(initial=0)
            slack = 1e-6 + 1e-9 * most
            i, j = np.nonzero(self.levels[0][part] @ levels[0].T >= bar[:, None] - slack)
            other = self.rows[part][i] != rows[j]
            i, j = i[other], j[other]
            self.seen[0] += len(i)
            for n, (mine, theirs) in enumerate(zip(self.levels[1:], levels[1:], strict=True)):
                may = _products(mine[part], theirs, i, j) >= bar[i] - slack
                i, j = i[may], j[may]
                self.seen[n + 1] += len(i)
            if most < _EXACT:  # no sum of products passes what a double holds exactly
                score = _products(own, v, i, j)
                high = (score > bar[i]) | (score == bar[i]) & (ids[j] < tied[i])
                i, j, score = i[high], j[high], score[high].astype(np.int64)
            else:
                score = _whole_products(own, v, i, j)
            if not len(i):
                continue
            got = zip(found, (i, ids[j], score), strict=True)
            self.parts[a] = q, best, score = _best(*(np.concatenate(c) for c in got), self.k)
            last = np.flatnonzero(np.diff(q, append=-1))
            last = last[np.bincount(q, minlength=len(own))[q[last]] >= self.k]
            low = score[last].astype(np.float64)
            sure = np.abs(low) < _EXACT
            bar[q[last]] = np.maximum(bar[q[last]], np.where(sure, low, low - 1e-9 * np.abs(low)))
            tied[q[last]] = np.where(sure & (bar[q[last]] == low), best[last], _MOST)

    @property
    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (its place), vec_id and score."""
        parts = [(q + a, ids, score) for a, (q, ids, score) in self.parts.items()]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def _first_bars(queries: DataFrame, sample: pa.Table, width: int, k: int) -> pa.Table:
    """``queries`` with bar, the k-th best score among the sample; found in tasks, of which each holds one batch."""
    rows, ids, theirs = sample["row_id"].to_numpy(), sample["vec_id"].to_numpy(), _matrix(sample["v"], width)
    sent = queries.sparkSession.sparkContext.broadcast((rows, ids, theirs))

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = Searcher(batch["row_id"].to_numpy(), _matrix(batch["v"], width), k)
            for a in range(0, len(sent.value[0]), CHUNK):
                start.see(*(x[a : a + CHUNK] for x in sent.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start.bar)], [*batch.schema.names, "bar"])

    return queries.mapInArrow(bars, "row_id long, vec_id long, v array<double>, bar double").toArrow()


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` other rows with the largest product with each query."""
    spark = vectors.sparkSession
    prepare(spark)
    own = materialise(whole(vectors, scale))
    shape = own.agg(F.max(F.size("v")).alias("width"), F.count_if(is_query).alias("queries")).first()
    width = shape["width"] or 0
    blocks = -(-shape["queries"] * (8 * width + 32) // QUERY_BYTES)
    sample = own.orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE).toArrow()
    found = []
    for block in range(blocks):
        mine = own.filter(is_query & (F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == block))
        mine = _first_bars(mine, sample, width, k)
        whose, named, v = mine["row_id"].to_numpy(), mine["vec_id"].to_numpy(), _matrix(mine["v"], width)
        sent = spark.sparkContext.broadcast((whose, named, v, mine["bar"].to_numpy()))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            whose, named, v, bar = sent.value
            searcher = Searcher(whose, v, k, bar)
            for batch in batches:
                rows, x, theirs = batch["row_id"].to_numpy(), batch["vec_id"].to_numpy(), _matrix(batch["v"], width)
                for a in range(0, len(x), CHUNK):
                    searcher.see(rows[a : a + CHUNK], x[a : a + CHUNK], theirs[a : a + CHUNK])
            q, x, score = searcher.found
            yield pa.RecordBatch.from_arrays([pa.array(whose[q]), pa.array(named[q]), pa.array(x), pa.array(score)], ["row_id", "query_id", "vec_id", "score"])

        part = own.mapInArrow(search, "row_id long, query_id long, vec_id long, score long")
        best = F.row_number().over(W.partitionBy("row_id").orderBy(F.col("score").desc(), "vec_id"))
        part = part.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        found.append(part if blocks == 1 else materialise(part))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found)
