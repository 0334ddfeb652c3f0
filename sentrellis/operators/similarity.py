"""Pairs of vectors with a cosine above a bound, exactly, without comparing all of them.

Vectors of the right side are dealt to the cell of their nearest pivot, a hashed sample of them; those of the left go
to every cell that can hold a partner. With t the angle of the bound, a partner y of x in the cell of pivot p satisfies
angle(x, p) <= t + angle(y, p) <= t + radius of the cell, and, as p is y's nearest pivot, angle(x, p) <= 2 t + angle(x, q) for every pivot q.
Cells are cut on both sides into blocks of bounded size. Within a block, products of the first quarter, half and three quarters of the
components, and the norms of the rest, bound the cosine; only what is left gets the exact one.

Defined cases: vectors that are null, zero, or hold null or non-finite components have no partners; shorter ones are
padded with zeros; equal ids on both sides are a pair like any other; repeated rows give repeated pairs; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Vectors of a cell on average, and of a block of either side at most on average; pivots at most.
CELL_ROWS, BLOCK_ROWS, PIVOTS = 4096, 8192, 1024
#: Rows of the left that are compared at a time; share of pairs from which products are taken for all of them.
PART, DENSE = 512, 0.05
_SLACK = 1e-9
#: Rows that a batch of vectors dealt to cells holds at most: a vector can go to all of them.
DEALT = 16384
#: Vectors of a block of ids at most on average, where pairs are given; pairs whose vectors are taken at a time.
AMONG_ROWS, AMONG_PAIRS = 65536, 8192
#: First rows of the right that each row is held against before all pairs are thought of, in rounds; sent to all tasks.
FIRST_ROWS = (4096, 16384)


class _Counts(AccumulatorParam):
    def zero(self, value: np.ndarray) -> np.ndarray:
        return np.zeros_like(value)

    def addInPlace(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b


def seen_counter(spark: SparkSession) -> Accumulator:
    """Counts of pairs: all, those in blocks that meet, those that a quarter, half and three quarters of the components
    leave (the last get the exact cosine), those found."""
    return spark.sparkContext.accumulator(np.zeros(6, np.int64), _Counts())


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    own = df.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter(F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Scaled by the largest component, so that no square overflows or vanishes.
    return own.filter(finite).withColumn("m", F.array_max(F.transform("v", F.abs))).filter("m > 0").select("id", F.transform("v", lambda x: x / F.col("m")).alias("v"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("nd,nd->n", m, m))[:, None]


def _cells(rows: DataFrame, pivots: np.ndarray, reach: float | None, radius: np.ndarray | None = None) -> DataFrame:
    """id, v, cell and angle: the nearest pivot's, or with ``reach`` every cell that can hold a partner."""
    sent = rows.sparkSession.sparkContext.broadcast((pivots, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius = sent.value
        for batch in (b.slice(k, PART) for b in batches for k in range(0, len(b), PART)):
            angle = np.arccos(np.clip(_unit(_matrix(batch["v"], pivots.shape[1])) @ pivots.T, -1, 1))
            if reach is None:
                rows, cells = np.arange(len(batch)), angle.argmin(axis=1)
            else:
                rows, cells = np.nonzero((angle <= radius + reach + _SLACK) & (angle <= angle.min(axis=1, keepdims=True) + 2 * reach + _SLACK))
            for k in range(0, len(rows), DEALT):
                row, cell = rows[k : k + DEALT], cells[k : k + DEALT]
                yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(row)) for c in ("id", "v")), pa.array(cell.astype(np.int32)), pa.array(angle[row, cell])], ["id", "v", "cell", "angle"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(deal, f"id {kind}, v array<double>, cell int, angle double")


def _compare(left: np.ndarray, right: np.ndarray, least: float, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors with a product above ``least``, and the products."""
    width = left.shape[1]
    cuts = [-(-width * k // 4) for k in range(1, 5)]
    rest = lambda m, k: np.sqrt(np.maximum(1 - np.einsum("nd,nd->n", m[:, :k], m[:, :k]), 0))
    seen[1] += len(left) * len(right)
    part = left[:, : cuts[0]] @ right[:, : cuts[0]].T
    i, j = np.nonzero(part + np.outer(rest(left, cuts[0]), rest(right, cuts[0])) > least - _SLACK)
    part = part[i, j]
    for level, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 2):
        seen[level] += len(i)
        if len(i) > DENSE * len(left) * len(right):
            part = part + (left[:, a:b] @ right[:, a:b].T)[i, j]
        else:
            part = part + np.einsum("nd,nd->n", left[i, a:b], right[j, a:b])
        keep = part + rest(left, b)[i] * rest(right, b)[j] > least - _SLACK if b < width else part > least
        i, j, part = i[keep], j[keep], part[keep]
    seen[5] += len(i)
    return i, j, part


def similar_pairs(left: DataFrame, right: DataFrame, least: float, key: str = "id", vector: str = "vector", seen: Accumulator | None = None) -> DataFrame:
    """l_id, r_id and cosine of all pairs above ``least`` (between 0 and 1)."""
    spark = left.sparkSession
    a, b = _usable(left, key, vector), _usable(right, key, vector)
    kind = [dict(x.dtypes)["id"] for x in (a, b)]
    sizes = b.agg(F.count("*"), F.max(F.size("v"))).first()
    n_left, wide = a.agg(F.count("*"), F.max(F.size("v"))).first()
    if not sizes[0] or not n_left:
        return spark.createDataFrame([], f"l_id {kind[0]}, r_id {kind[1]}, cosine double")
    width = max(sizes[1], wide)
    n = min(PIVOTS, -(-sizes[0] // CELL_ROWS))
    pivots = _unit(_matrix(b.orderBy(F.xxhash64("v"), "id").limit(n).select("v").toArrow()["v"], width))
    reach = float(np.arccos(least))
    right_cells = _cells(b, pivots, None)
    found = right_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row a pivot
    radius, n_right = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in found:
        radius[r["cell"]], n_right[r["cell"]] = r["radius"], r["n"]
    left_cells = _cells(a, pivots, reach, radius)
    n_of_left = dict(left_cells.groupBy("cell").count().collect())
    blocks = [(c, -(-n_of_left.get(c, 0) // BLOCK_ROWS), -(-int(n_right[c]) // BLOCK_ROWS)) for c in range(len(pivots)) if n_right[c] and n_of_left.get(c)]
    if not blocks:
        return spark.createDataFrame([], f"l_id {kind[0]}, r_id {kind[1]}, cosine double")
    cut = F.broadcast(spark.createDataFrame(blocks, "cell int, l int, r int"))  # a row a pivot at most
    block = lambda i, j: F.struct("cell", i.alias("i"), j.alias("j")).alias("block")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda name: F.pmod(F.xxhash64("id", "v"), F.col(name)).cast("int")
    # Each left block of a cell meets each right block of it.
    lefts = left_cells.join(cut, "cell").withColumn("other", every("r")).select(block(own("l"), F.col("other")), F.lit(1).alias("side"), F.col("id").alias("l_id"), F.lit(None).cast(kind[1]).alias("r_id"), "v")
    rights = right_cells.join(cut, "cell").withColumn("other", every("l")).select(block(F.col("other"), own("r")), F.lit(0).alias("side"), F.lit(None).cast(kind[0]).alias("l_id"), F.col("id").alias("r_id"), "v")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(sum(x * y for _, x, y in blocks), 100_000))
    dealt = rights.unionAll(lefts).repartition(tasks, "block").sortWithinPartitions("block", "side")
    if seen is not None:
        seen.add(np.array([n_left * sizes[0], 0, 0, 0, 0, 0]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, fixed, counts = None, [], [], None, np.zeros(6, np.int64)
        for batch in batches:
            code = [pc.struct_field(batch["block"], k).to_numpy() for k in range(3)] + [batch["side"].to_numpy()]
            new = np.flatnonzero(np.any([np.diff(c, prepend=c[:1] - 1) != 0 for c in code], axis=0))
            for lo, hi in zip(new, np.append(new[1:], len(batch)), strict=True):
                where, side = tuple(c[lo] for c in code[:3]), code[3][lo]
                if where != now:
                    now, ids, held, fixed = where, [], [], None
                vectors = _unit(_matrix(batch["v"].slice(lo, hi - lo), width))
                if side == 0:
                    ids.append(batch["r_id"].slice(lo, hi - lo))
                    held.append(vectors)
                    continue
                if fixed is None and held:
                    fixed, names = np.concatenate(held), pa.concat_arrays(ids)
                for k in range(0, len(vectors) if held else 0, PART):
                    i, j, cosine = _compare(vectors[k : k + PART], fixed, least, counts)
                    if len(i):
                        own = batch["l_id"].slice(lo + k, min(PART, hi - lo - k))
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(i)), names.take(pa.array(j)), pa.array(cosine)], ["l_id", "r_id", "cosine"])
        if seen is not None:
            seen.add(counts)

    return dealt.mapInArrow(meet, f"l_id {kind[0]}, r_id {kind[1]}, cosine double")


def _by_id(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, where the vectors of each begin and how many there are, and all vectors by id."""
    ids = pa.concat_arrays([i for i, _ in held]).dictionary_encode()
    code = ids.indices.to_numpy()
    n = np.bincount(code, minlength=len(ids.dictionary))
    return ids.dictionary, np.cumsum(n) - n, n, np.concatenate([v for _, v in held])[np.argsort(code, kind="stable")]


def _alike(left: tuple, right: tuple, l_ids: pa.Array, r_ids: pa.Array, least: float) -> np.ndarray:
    """Which pairs of ids have vectors (``_by_id``) with a product above ``least``."""
    (l_names, l_start, l_n, l_v), (r_names, r_start, r_n, r_v) = left, right
    i, j = (pc.fill_null(pc.index_in(ids, names, skip_nulls=True), -1).to_numpy() for ids, names in ((l_ids, l_names), (r_ids, r_names)))
    n = np.where((i >= 0) & (j >= 0), l_n[i] * r_n[j], 0)  # an id can have several vectors
    ends, found = np.cumsum(n), np.zeros(len(n), bool)
    for k in range(0, int(ends[-1]), AMONG_PAIRS):
        nth = np.arange(k, min(k + AMONG_PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, nth, side="right")
        a, b = np.divmod(nth - ends[row] + n[row], r_n[j[row]])
        near = np.einsum("nd,nd->n", l_v[l_start[i[row]] + a], r_v[r_start[j[row]] + b]) > least
        found[row[near]] = True
    return found


def similar_among(asked: DataFrame, rows: DataFrame, least: float, pair: tuple[str, str], key: str = "id", vector: str = "vector") -> DataFrame:
    """The rows of ``asked`` whose two ids, columns ``pair``, have vectors in ``rows`` with a cosine above ``least``: what a
    semi-join with ``similar_pairs`` leaves, without the pairs that nobody asks for.

    Ids are dealt to blocks by hash. A row goes to the task of its two blocks, and the vectors of either block to all
    tasks of it; a task holds two blocks and lets its rows pass."""
    spark = asked.sparkSession
    vectors = _usable(rows, key, vector).filter("id is not null")
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return asked.limit(0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // AMONG_ROWS), int(np.ceil(np.sqrt(tasks))))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    place = lambda side, i, j: ((i.cast("long") * blocks + j) * 3 + side).alias("code")  # noqa: E731  # one number, which sorts without comparing rows
    other, none = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.lit(None).cast(asked.schema).alias("row")
    spread = vectors.select("id", "v", own("id").alias("own"), other.alias("other"))
    lefts = spread.select(place(0, F.col("own"), F.col("other")), "id", "v", none)
    rights = spread.select(place(1, F.col("other"), F.col("own")), "id", "v", none)
    kinds = dict(vectors.dtypes)
    pairs = asked.select(place(2, *map(own, pair)), F.lit(None).cast(kinds["id"]).alias("id"), F.array().cast(kinds["v"]).alias("v"), F.struct("*").alias("row"))  # null lists are counted anew for each row of a batch
    dealt = lefts.unionAll(rights).unionAll(pairs).repartition(max(tasks, blocks**2), F.floor(F.col("code") / 3)).sortWithinPartitions("code")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, ([], []), None
        for batch in batches:
            codes = batch["code"].to_numpy()
            new = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
            for lo, hi in zip(new, np.append(new[1:], len(batch)), strict=True):
                where, side = divmod(codes[lo], 3)
                part = batch.slice(lo, hi - lo)
                if where != now:
                    now, held, known = where, ([], []), None
                if side < 2:
                    held[side].append((part["id"], _unit(_matrix(part["v"], width))))
                    continue
                if known is None:
                    known, held = [_by_id(h) for h in held] if all(held) else [], ([], [])
                if known:
                    found = _alike(*known, *(pc.struct_field(part["row"], c) for c in pair), least)
                    yield pa.RecordBatch.from_arrays([part["row"].filter(pa.array(found))], ["row"])

    return dealt.mapInArrow(meet, StructType([StructField("row", asked.schema)])).select("row.*")


def _held_against(rows: DataFrame, block: pa.Table, group: list[str], order: str, least: float) -> DataFrame:
    """``rows`` (group, order, v, match) where a row without a match gets the first of ``block``, which is in order."""
    names = [tuple(r.values()) for r in block.select(group).to_pylist()]
    code = {g: i for i, g in enumerate(dict.fromkeys(names))}
    width = int(pc.max(pc.list_value_length(block["v"])).as_py() or 1)
    sent = rows.sparkSession.sparkContext.broadcast((_unit(_matrix(block["v"], width)), np.array([code[g] for g in names]), code, block[order].to_pylist()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group_of, code, ids = sent.value
        names = np.array([*ids, None], object)
        for batch in batches:
            match, own = np.array([*batch["match"].to_pylist(), None], object)[:-1], np.array([*batch[order].to_pylist(), None], object)[:-1]
            groups = np.array([code.get(tuple(r.values()), -1) for r in batch.select(group).to_pylist()], np.int64)
            open_ = np.flatnonzero([m is None for m in match])
            for k in range(0, len(open_), PART):
                some = open_[k : k + PART]
                vectors = batch["v"].take(pa.array(some))
                wide = max(held.shape[1], int(pc.max(pc.list_value_length(vectors)).as_py()))
                near = _unit(_matrix(vectors, wide))[:, : held.shape[1]] @ held.T > least
                near &= (groups[some][:, None] == group_of[None, :]) & (own[some][:, None] != names[None, :-1])
                match[some] = names[np.where(near.any(axis=1), near.argmax(axis=1), len(ids))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*group, order, "v")), pa.array(match.tolist(), batch.schema.field("match").type)], schema=batch.schema)

    return rows.mapInArrow(meet, rows.schema)


def similar_first(left: DataFrame, right: DataFrame, group: list[str], vector: str, least: float, order: str) -> DataFrame:
    """For each row of the left, the first of its group on the right, another one, whose cosine is above ``least``.

    Where partners are not rare, the first is an early one: rows are held against ``FIRST_ROWS`` first rows of the right, those
    without a match against so many more, and only what is then left takes part in the join of all pairs."""
    own = lambda df: _usable(df.withColumn("_id", F.struct(*group, F.col(order).alias("_o"))), "_id", vector).select(*(F.col(f"id.{g}").alias(g) for g in group), F.col("id._o").alias(order), "v").dropna(subset=[*group, order])
    kind = dict(right.dtypes)[order]
    rows, rest = own(left).withColumn("match", F.lit(None).cast(kind)), own(right)
    after = None
    for n in FIRST_ROWS:
        block = (rest if after is None else rest.filter(F.col(order) >= F.lit(after))).orderBy(order).limit(n).toArrow()
        if not block.num_rows:
            break
        rows = _held_against(rows, block, group, order, least)
        after = block[order][-1].as_py()
        if block.num_rows < n:  # all of the right
            return rows.filter("match is not null").groupBy(*group, order).agg(F.min("match").alias("match"))
    rows = rows.withColumn("v", F.when(F.col("match").isNull(), F.col("v"))).persist()  # of few rows the vectors are left
    found = rows.filter("match is not null").select(*group, order, "match")
    open_ = rows.filter("match is null")
    if after is not None and not open_.isEmpty():
        late = rest.filter(F.col(order) >= F.lit(after))
        near = similar_pairs(open_, late, least, order, "v").filter("l_id <> r_id")
        side = lambda df, name: df.select(*group, F.col(order).alias(name)).distinct()
        both = near.join(side(open_, "l_id"), "l_id").join(side(late, "r_id"), ["r_id", *group])
        found = found.unionByName(both.select(*group, F.col("l_id").alias(order), F.col("r_id").alias("match")))
    return found.groupBy(*group, order).agg(F.min("match").alias("match"))
