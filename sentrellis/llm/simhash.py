"""SimHash near-dedup: fingerprints, a grid range-join in segment-popcount space, exact checks, components.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their bit counts is its place in a grid.
The Manhattan distance of two such vectors is at most the Hamming distance of the fingerprints, so links at
``max_bits`` or fewer differ by at most ``max_bits`` // 2 in one half of the segments: each fingerprint is homed in
its own cell of either half and looks into the cells within that distance. Every candidate is then checked exactly.
Equal fingerprints are merged before the join. A cell with more rows than ``CELL_ROWS`` is dealt to many tasks as
pairs of chunks, and a task returns a spanning forest of the links it finds, never all pairs of a group.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer words than a
shingle make one shingle; rows of one id are one document; null ids take part but never name a component unless
all its ids are null; of a stage, equal rows stay or go together; more than 60 rounds of components raise an error; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, encoded, materialise, partitions_for, prepare
from .components import components, forest

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Rows of a grid cell that one task compares with each other; larger cells are split into chunks of this size.
CELL_ROWS = 16_384
_LINKS_HELD = 2_000_000


def text_fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text (lower-cased A-Z, words of non-space, word shingles with repeats)."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in chunks([len(t) for t in texts], 1 << 20):
        hashes: list[int] = []
        counts = []
        for text in texts[a:b]:
            words = text.lower().split()
            n = len(words) - shingle + 1
            if n > 1:
                whole = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                starts = np.concatenate(([0], ends[:-1] + 1))
                hashes += [digest(whole[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
            elif words:
                hashes.append(digest(b" ".join(words), SEED))
            counts.append(max(n, 1) if words else 0)
        counts = np.array(counts)
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        first = np.cumsum(counts)[some] - counts[some]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[a + some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def holder() -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, holder (names the row by id and text) and fp, the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_fingerprints([t or b"" for t in encoded(batch["text"])], shingle)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["holder"], pa.array(found.view(np.int64))], ["doc_id", "holder", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), holder().alias("holder"), "text")
    return own.mapInArrow(one, "doc_id long, holder long, fp long")


_ODD = np.uint64(0x55555555)


def _cells(fp: np.ndarray, half: int) -> np.ndarray:
    """Bit counts of the 16 two-bit segments of a half, packed two bits each."""
    x = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
    return x - ((x >> np.uint64(1)) & _ODD)


def _offsets(reach: int, start: int = 0, first: bool = True) -> list[tuple[tuple[int, int], ...]]:
    """Changes of counts, as (segment, by), of at most ``reach`` in sum, the first of them upwards."""
    out = []
    for i in range(start, 16):
        for by in range(-min(2, reach), min(2, reach) + 1):
            if by > 0 or by < 0 and not first:
                out.append(((i, by),))
                out += [((i, by), *rest) for rest in _offsets(reach - abs(by), i + 1, False)]
    return out


def grid(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """cell, home and fp: each fingerprint in its own cell of both halves, and in those that it looks into.

    A cell looks into those at an offset whose first count that differs is higher, so of two cells within the
    reach exactly one looks into the other.
    """
    offsets = _offsets(max_bits // 2)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            cells, homes, whose = [], [], []

            def put(cell: np.ndarray, who: np.ndarray, home: bool, half: int) -> None:
                cells.append(((cell << np.uint64(1)) | np.uint64(half)).view(np.int64))
                homes.append(np.full(len(cell), home))
                whose.append(who.view(np.int64))

            for half in (0, 1):
                own = _cells(fp, half)
                put(own, fp, True, half)
                counts = [(own >> np.uint64(2 * i)) & np.uint64(3) for i in range(16)]
                for offset in offsets:
                    cell, fits = own, np.ones(len(own), bool)
                    for i, by in offset:
                        fits &= (counts[i] >= -by) & (counts[i] <= 2 - by)
                        cell = cell + np.uint64((by << 2 * i) % (1 << 64))
                    put(cell[fits], fp[fits], False, half)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes)), pa.array(np.concatenate(whose))], ["cell", "home", "fp"])

    return nodes.select("fp").mapInArrow(spread, "cell long, home boolean, fp long")


class _Links:
    """Links found so far, thinned to a spanning forest whenever they are many."""

    def __init__(self) -> None:
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)
            if self.n > _LINKS_HELD:
                a, b = self.forest()
                self.a, self.b, self.n = [a], [b], len(a)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return forest(np.concatenate(self.a), np.concatenate(self.b))


def cell_links(cell: np.ndarray, home: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of the same cell of which one at least is at home."""
    order = np.lexsort((~home, cell))
    cell, home, fp = cell[order], home[order], fp[order]
    cut = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1 if len(cell) else 0)) if len(cell) else np.zeros(0, int)
    size = np.diff(np.append(cut, len(cell)))
    homes = np.add.reduceat(home, cut, dtype=np.int64) if len(cut) else size
    links = _Links()
    few = (size <= 48) & (homes > 0) & (size > 1)
    keep = np.repeat(few, size)
    c, h, f = cell[keep], home[keep], fp[keep]
    for d in range(1, int(size[few].max(initial=1))):
        i = np.flatnonzero((c[:-d] == c[d:]) & h[:-d])  # those at home come first in a cell
        if not len(i):
            break
        near = i[np.bitwise_count(f[i] ^ f[i + d]) <= max_bits]
        links.add(f[near], f[near + d])
    for g in np.flatnonzero((size > 48) & (homes > 0)):
        own = fp[cut[g] : cut[g] + size[g]]
        for a in range(0, int(homes[g]), 256):
            i, j = np.nonzero(np.bitwise_count(own[a : min(a + 256, homes[g]), None] ^ own[None, :]) <= max_bits)
            links.add(own[a + i], own[j])
    return links.forest()


def fingerprint_links(nodes: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all links at ``max_bits`` or fewer."""
    rows = grid(nodes, max_bits)
    hot = materialise(rows.groupBy("cell").count().filter(F.col("count") > cell_rows).select(F.col("cell").alias("hot"), F.ceil(F.col("count") / cell_rows).alias("parts")))
    key: Column = F.col("cell")
    if hot.head(1):
        rows = rows.join(hot, F.col("cell") == F.col("hot"), "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)))
        key = F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")))
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions_for(nodes))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got)
        col = lambda k: t[k].combine_chunks().to_numpy(zero_copy_only=False)
        a, b = cell_links(col("cell"), col("home"), col("fp").view(np.uint64), max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = rows.select(key.alias("cell"), "home", "fp").repartition(n, "cell")
    return dealt.mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, holder, fp and component_id (the smallest doc_id that links reach) of every document."""
    prints = materialise(fingerprints(docs, shingle))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return named(prints, nodes, fingerprint_links(nodes, max_bits))


def named(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``prints`` (doc_id, holder, fp) with component_id, from ``nodes`` (fp, first: the smallest doc_id) and edges (a, b)."""
    roots = materialise(components(edges))
    member = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = materialise(member)
    least = member.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    least = materialise(least.filter("n > 1").drop("n"))
    member = materialise(member.join(least, F.col("root") == F.col("of"), "left").select(F.col("fp").alias("own"), F.coalesce("component_id", "first").alias("component_id")))
    return prints.join(member, F.col("fp") == F.col("own")).select("doc_id", "holder", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that name their component: one of each group of near copies stays."""
    return those_that_stay(docs, near_duplicates(docs, shingle, max_bits))


def those_that_stay(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id names their component in ``members``; equal rows are one document and stay together."""
    name = "holder_"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    stay = members.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("holder").alias(name)).distinct()
    return docs.join(stay, holder() == F.col(name), "left_semi")
