"""Near copies by the exact Jaccard similarity of word shingles: SimHash components and MinHash buckets, exact check, components.

Texts with equal shingle sets are one node. Nodes whose SimHash fingerprints, of the same shingles, link at ``MAX_BITS``
bits by ``simhash``'s grid are one bucket; as no grid reaches all pairs of the similarity, there are others: a node is put into ``BANDS`` buckets, each keyed by ``ROWS`` minima of its
shingle hashes; two nodes of similarity s share none with probability (1 - s ** ROWS) ** BANDS, 2 in 10,000 at 0.8.
Nodes that share a bucket are compared by their whole sets. A bucket with more nodes than ``BUCKET_ROWS``, or whose sets
take more than ``BUCKET_BYTES``, is dealt to many tasks as pairs of chunks, and a task returns a spanning forest of the links it finds, never all pairs of a group.

Defined cases: as in ``simhash``; texts without words are copies of each other, fewer words than a shingle make one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, encoded, materialise, mix, partitions_for, prepare
from .components import components
from .simhash import MAX_BITS, _Links, fingerprint_links, holder, named, text_fingerprints, those_that_stay

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
BUCKET_ROWS, BUCKET_BYTES = 2048, 32 << 20
_STEP = 0x9E3779B97F4A7C15
_SEEDS = np.random.default_rng(17).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text (lower-cased A-Z)."""
    words = Words([t.lower() for t in texts])
    out, at = [], 0
    for n in words.counts.tolist():
        h = words.hashes[at : at + n]
        at += n
        size = min(shingle, n)
        total = np.zeros(n - size + 1 if n else 0, np.uint64)
        for i in range(size):
            total = mix(total * np.uint64(_STEP) + h[i : i + len(total)])
        out.append(np.unique(total))
    return out


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, holder (names the row), fp (the set's hash), size (of the set), sim (the SimHash fingerprint) and bands."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fps, sizes, bands = [t or b"" for t in encoded(batch["text"])], [], [], []
            sims = text_fingerprints(texts, SHINGLE)
            for a, b in chunks([len(t) for t in texts]):
                sets = shingle_sets(texts[a:b])
                size = np.array([len(s) for s in sets])
                fp, keys = np.zeros(b - a, np.uint64), np.zeros((b - a, BANDS), np.uint64)
                some = np.flatnonzero(size)
                if len(some):
                    every, cut = np.concatenate(sets), (np.cumsum(size) - size)[some]
                    fp[some] = mix(np.add.reduceat(mix(every ^ np.uint64(_STEP)), cut) + size[some].astype(np.uint64))
                    for k, (x, by) in enumerate(_SEEDS):
                        least = np.minimum.reduceat((every ^ x) * by, cut)
                        keys[some, k // ROWS] = mix(keys[some, k // ROWS] * np.uint64(_STEP) + least + np.uint64(k))
                fps.append(fp)
                sizes.append(size)
                bands += keys.view(np.int64).tolist()
            fps = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            columns = [batch["doc_id"], batch["holder"], pa.array(fps.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sims.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "holder", "fp", "size", "sim", "bands"])

    return docs.mapInArrow(one, "doc_id long, holder long, fp long, size long, sim long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """fp and the packed set of every row of ``docs`` (fp, text)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, packed = [t or b"" for t in encoded(batch["text"])], []
            for a, b in chunks([len(t) for t in texts]):
                packed += [s.tobytes() for s in shingle_sets(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array(packed, pa.binary())], ["fp", "packed"])

    return docs.select("fp", "text").mapInArrow(one, "fp long, packed binary")


def bucket_links(fp: np.ndarray, sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between nodes of one bucket whose sets have a Jaccard similarity of ``least``."""
    links = _Links()
    order = np.argsort([len(s) for s in sets], kind="stable")
    fp, sets = fp[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    for i in range(len(sets) - 1):
        # Sets that are too large for the similarity are no candidates; sizes rise.
        end = int(np.searchsorted(size, size[i] / least + 1e-9, side="right"))
        if end <= i + 1:
            continue
        other = np.concatenate(sets[i + 1 : end])
        at = np.minimum(np.searchsorted(sets[i], other), size[i] - 1)
        first = np.cumsum(size[i + 1 : end]) - size[i + 1 : end]
        both = np.add.reduceat(sets[i][at] == other, first, dtype=np.int64)
        near = np.flatnonzero(both >= least * (size[i] + size[i + 1 : end] - both) - 1e-9) + i + 1
        links.add(np.full(len(near), fp[i]), fp[near])
    return links.forest()


def links(nodes: DataFrame, docs: DataFrame, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Edges (a, b) between ``nodes`` (fp, holder, size, bands) that connect all links; ``docs`` has holder and text."""
    rows = nodes.filter("fp <> 0").select("fp", "size", F.explode("bands").alias("bucket"))
    needs = F.greatest(F.count("*") / bucket_rows, F.sum("size") * 8 / bucket_bytes)  # chunks of the bucket
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), needs.alias("needs"), F.bit_xor(F.xxhash64("fp")).alias("members")).filter("n > 1")
    # Buckets with the same members are compared once.
    shared = shared.groupBy("n", "members").agg(F.min("bucket").alias("kept"), F.max("needs").alias("needs")).select("kept", F.ceil("needs").alias("parts"))
    rows = materialise(rows.join(materialise(shared), F.col("bucket") == F.col("kept")).select("bucket", "fp", "parts"))
    held = nodes.select("fp", "holder").join(rows.select("fp").distinct(), "fp", "left_semi")
    texts = docs.join(held, "holder").select("fp", "text")
    sets = materialise(_sets(texts).dropDuplicates(["fp"]))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    key = F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions_for(sets))
    dealt = rows.select(key.alias("bucket"), "fp").join(sets, "fp").repartition(n, "bucket").sortWithinPartitions("bucket")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, packed = None, [], []

        def found() -> pa.RecordBatch:
            a, b = bucket_links(np.array(fps, np.int64).view(np.uint64), [np.frombuffer(x, np.uint64) for x in packed])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            for bucket, fp, x in zip(*(batch[k].to_pylist() for k in ("bucket", "fp", "packed")), strict=True):
                if bucket != now:
                    if len(fps) > 1:
                        yield found()
                    now, fps, packed = bucket, [], []
                fps.append(fp)
                packed.append(x)
        if len(fps) > 1:
            yield found()

    return dealt.mapInArrow(join, "a long, b long")


def _with_sim_bucket(nodes: DataFrame) -> DataFrame:
    """``nodes`` with one more bucket: the component of their SimHash fingerprint, or the fingerprint itself."""
    prints = nodes.filter("fp <> 0").select(F.col("sim").alias("fp")).distinct()
    roots = materialise(components(fingerprint_links(materialise(prints), MAX_BITS))).select(F.col("node").alias("sim"), "root")
    bucket = F.xxhash64(F.lit("sim"), F.coalesce("root", "sim"))
    return nodes.join(roots, "sim", "left").withColumn("bands", F.array_append("bands", bucket)).select("fp", "first", "holder", "size", "bands")


def near_copies(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, holder, fp and component_id (the smallest doc_id that links reach) of every document."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("holder", holder())
    prints = materialise(_prints(own))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("holder").alias("holder"), F.first("size").alias("size"), F.min("sim").alias("sim"), F.first("bands").alias("bands")))
    nodes = materialise(_with_sim_bucket(nodes))
    return named(prints.select("doc_id", "holder", "fp"), nodes.select("fp", "first"), links(nodes, own, bucket_rows, bucket_bytes))


def copy_dedup(docs: DataFrame) -> DataFrame:
    """The documents that name their component: one of each group of near copies stays."""
    return those_that_stay(docs, near_copies(docs))
