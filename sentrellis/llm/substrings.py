"""Substring dedup by super-k-mer partitioning.

Each window of ``window`` words belongs to the bucket of its minimiser, the 3-word gram in it with the smallest
hash. Consecutive windows with the same minimiser travel as one packed string. A task first merges equal strings
of its own documents, so a passage that millions of documents share leaves each task once; buckets sort the hashes
of their windows and compare the words themselves wherever hashes are equal. Windows with a frequent minimiser are
dealt by a second one, so that no bucket grows with one gram. A word goes if a window over it also
starts in a document with a smaller id.

Defined cases: a null text has no words; a row without an id loses nothing and takes nothing from others; rows
with the same id are one document; texts shorter than a window stay; an empty table gives an empty result;
further columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, discard, encoded, materialise, mix, pack, partitions_for, prepare, span_hashes, unpack, with_row

WINDOW = 13
GRAM = 3
#: Bytes of text whose packed strings a task holds before it sends them.
HELD_BYTES = 8 << 20
#: One of so many texts says which minimisers are frequent.
DEALT_BY = 64
_SECOND, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 64) - 1)


def window_minima(order: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each run of ``width`` values."""
    best, reach = np.arange(len(order)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        best = np.where(order[left] <= order[right], left, right)
        reach += step
    return best


def super_kmers(words: Words, window: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser hash of each super-k-mer.

    Windows whose minimiser is ``frequent`` (sorted) go by a second one, the smallest by another hash of the grams that
    are not, or by all their words if they have none: equal windows have equal words, so they agree on it.
    """
    n, h = len(words.starts), words.hashes
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64)
    gram = min(GRAM, window)
    order = h[: n - gram + 1].copy()
    for j in range(1, gram):
        order += h[j : n - gram + 1 + j] * np.uint64(2 * j * 0x632BE59BD9B4E019 + 1 & (1 << 64) - 1)
    order = mix(order)
    least = window_minima(order, window - gram + 1)
    valid = np.flatnonzero(words.text[: n - window + 1] == words.text[window - 1 :])
    if not len(valid):
        return none, none, none.astype(np.uint64)
    least = least[valid]
    key = order[least]
    if frequent is not None and len(frequent):
        known = frequent[np.minimum(np.searchsorted(frequent, order), len(frequent) - 1)] == order
        other = np.where(known, _LAST, mix(order ^ _SECOND))
        second = window_minima(other, window - gram + 1)[valid]
        often, every = known[least], known[second]  # every: of frequent grams only, so each window goes by itself
        key, least = np.where(often, other[second], key), np.where(often, second + n, least)
        if every.any():
            alone = valid[every].astype(np.int64)
            key[every], least[every] = span_hashes(h, alone, alone + window), alone + 2 * n
    new = np.flatnonzero(np.concatenate(([True], (np.diff(valid) != 1) | (np.diff(least) != 0))))
    return valid[new], np.diff(np.append(new, len(valid))), key[new]


def frequent_minimisers(docs: DataFrame, window: int, buckets: int) -> np.ndarray:
    """Minimisers of over a quarter of a bucket's share of the windows, so fewer than four a bucket; by a hashed sample.

    They say where windows are compared, not which.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in encoded(batch["text"])]
            for a, b in chunks([len(t) for t in texts]):
                _, many, least = super_kmers(Words(texts[a:b]), window)
                key, at = np.unique(least, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, many, minlength=len(key)).astype(np.int64))], ["key", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(DEALT_BY)) == 0)
    counts = materialise(sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.filter(F.col("n") > total / (4 * buckets)).select("key").toArrow()["key"].to_numpy()
    discard(counts)
    return np.sort(often.view(np.uint64))


class _Held:
    """Packed strings of one task until they are sent: each distinct string once, its places beside it."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.bucket: list[np.ndarray] = []
        self.where: list[np.ndarray] = []
        self.size = 0

    def add(self, docs: list[int], rids: list[int], texts: list[bytes], window: int, buckets: int, frequent: np.ndarray) -> None:
        words = Words([b" ".join(t.split()) for t in texts])
        first, count, least = super_kmers(words, window, frequent)
        starts, ends = words.starts[first].tolist(), words.ends[first + count + window - 2].tolist()
        ids, data = self.ids, words.bytes
        uid = np.fromiter((ids.setdefault(data[a:b], len(ids)) for a, b in zip(starts, ends, strict=True)), np.int64, len(first))
        text = words.text[first]
        begin = np.cumsum([0, *words.counts])[text]
        self.bucket.append((mix(least) % np.uint64(buckets)).astype(np.int64))
        self.where.append(np.stack([uid, np.asarray(docs, np.int64)[text], np.asarray(rids, np.int64)[text], first - begin]))
        self.size += len(data)

    def rows(self) -> pa.RecordBatch:
        bucket, (uid, doc, rid, pos) = np.concatenate(self.bucket), np.concatenate(self.where, axis=1)
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, uid, doc)
        strings = list(self.ids)
        order = np.lexsort((uid, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-2))
        keys, blobs = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = order[a:b]
            own, at = np.unique(uid[rows], return_inverse=True)
            back = np.argsort(rows)  # in the order of the documents: long runs of equal ids
            rows, at = rows[back], at[back]
            blobs.append(pack(b"\n".join([strings[i] for i in own]), least[own].tobytes(), at.astype(np.int32).tobytes(), doc[rows].tobytes(), rid[rows].tobytes(), pos[rows].astype(np.int32).tobytes()))
            keys.append(int(bucket[rows[0]]))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "payload"])


def packed_strings(docs: DataFrame, window: int, buckets: int, frequent: np.ndarray) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            texts = [t or b"" for t in encoded(batch["text"])]
            ids, rids = batch["doc_id"].to_pylist(), batch["rid"].to_pylist()
            for a, b in chunks([len(t) for t in texts]):
                held.add(ids[a:b], rids[a:b], texts[a:b], window, buckets, frequent)
                if held.size >= HELD_BYTES:
                    yield held.rows()
        if held.size and held.ids:
            yield held.rows()

    return docs.mapInArrow(pack, "bucket int, payload binary")


def _repeats(payloads: list[bytes], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """doc, rid, start and end (words) of what goes, from all packed strings of a bucket."""
    parts, hashes, docs = [], [], []
    for packed in payloads:
        strings, least, at, doc, rid, pos = unpack(packed, 6)
        words = Words(strings.split(b"\n"))
        n = len(words.starts)
        valid = np.flatnonzero(words.text[: n - window + 1] == words.text[window - 1 :]).astype(np.int32)
        hashes.append(span_hashes(words.hashes, valid.astype(np.int64), valid.astype(np.int64) + window))
        docs.append(np.frombuffer(least, np.int64)[words.text[valid]])
        parts.append((words.bytes, words.starts.astype(np.int32), words.ends.astype(np.int32), words.text.astype(np.int32), words.counts, valid, np.frombuffer(least, np.int64), np.frombuffer(at, np.int32), np.frombuffer(doc, np.int64), np.frombuffer(rid, np.int64), np.frombuffer(pos, np.int32)))
    base = np.cumsum([0, *(len(h) for h in hashes)])
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    del hashes, docs
    order = np.lexsort((doc, h))
    sorted_h = h[order]
    fresh = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    later = np.flatnonzero(doc[order] > doc[order[head]])  # equal hash, larger id than the first of its run

    def string(k: int) -> bytes:
        p = int(np.searchsorted(base, k, "right")) - 1
        data, starts, ends, _, _, valid, *_ = parts[p]
        i = valid[k - base[p]]
        return data[starts[i] : ends[i + window - 1]]

    gone = np.zeros(len(h), bool)
    if len(later):
        where = np.searchsorted(base, order[later], "right") - 1
        top = np.searchsorted(base, order[head[later]], "right") - 1
        unsure = []
        for k, p, q, k0 in zip(order[later].tolist(), where.tolist(), top.tolist(), order[head[later]].tolist(), strict=True):
            a, b = parts[p], parts[q]
            i, j = a[5][k - base[p]], b[5][k0 - base[q]]
            if a[0][a[1][i] : a[2][i + window - 1]] == b[0][b[1][j] : b[2][j + window - 1]]:
                gone[k] = True
            else:
                unsure.append(k)
        for k in unsure:  # different words under one hash: compare with all of that hash
            same = np.flatnonzero(h == h[k])
            gone[k] = any(doc[j] < doc[k] and string(j) == string(k) for j in same)
    for p, (_, _, _, text, counts, valid, least, at, own, rid, pos) in enumerate(parts):
        known = own > least[at]
        starts, ends = [pos[known]], [pos[known] + counts[at[known]].astype(np.int32)]
        rows = [np.flatnonzero(known)]
        hit = valid[gone[base[p] : base[p + 1]]]
        if len(hit):
            new = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(text[hit]) != 0))))
            last = hit[np.append(new[1:], len(hit)) - 1]
            begin = np.cumsum([0, *counts]).astype(np.int32)
            run_text, run_a, run_b = text[hit[new]], hit[new] - begin[text[hit[new]]], last - begin[text[hit[new]]] + window
            first = np.searchsorted(run_text, np.arange(len(counts) + 1))
            open_ = np.flatnonzero(~known)
            many = (first[1:] - first[:-1])[at[open_]]
            occ = np.repeat(open_, many)
            run = np.repeat(first[at[open_]], many) + np.arange(len(occ)) - np.repeat(np.cumsum(many) - many, many)
            starts.append(pos[occ] + run_a[run])
            ends.append(pos[occ] + run_b[run])
            rows.append(occ)
        rows = np.concatenate(rows)
        yield own[rows], rid[rows], np.concatenate(starts), np.concatenate(ends)


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, rid (hash of the text), start and end: ranges of words that repeat a document with a smaller id."""
    prepare(docs.sparkSession)
    buckets = 2 * partitions_for(docs)  # a window's strings and hashes are several times the text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[bytes]] = {}
        for batch in batches:
            for key, payload in zip(batch["bucket"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                of.setdefault(key, []).append(payload)
        for payloads in of.values():
            for doc, rid, start, end in _repeats(payloads, window):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(rid), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "rid", "start", "end"])

    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text")
    packed = packed_strings(own, window, buckets, frequent_minimisers(own, window, buckets)).repartitionById(buckets, F.col("bucket"))
    return packed.mapInArrow(count, "doc_id long, rid long, start int, end int")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, goes in zip(encoded(batch["text"]), batch["goes"].to_pylist(), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if goes:
                stay = np.ones(len(words), bool)
                for r in goes:
                    stay[r["start"] : r["end"]] = False
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row`` (the document's own columns), n_words, n_removed and kept (the words left, joined by one space)."""
    ranges = materialise(repeated_ranges(docs.select("doc_id", "text"), window))
    goes = ranges.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("start", "end")).alias("goes"))
    goes = goes.select(F.col("doc_id").alias("of"), F.col("rid").alias("of_rid"), "goes")
    own = docs.select(F.struct("*").alias("row"))
    same = (F.col("row.doc_id") == F.col("of")) & (F.xxhash64("row.text") == F.col("of_rid"))
    joined = own.join(goes, same, "left").select("row", F.col("row.text").alias("text"), "goes")
    return joined.mapInArrow(_cut, with_row(own, "n_words long, n_removed long, kept string"))
