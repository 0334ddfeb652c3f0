"""Scores of a hierarchical Pitman-Yor language model, its seating sampled by Gibbs.

The restaurants: one for each context, which is the word before (the text's end before the first word), all with one
parent over all words, whose base is uniform. Every context and every word has its own counts and its own seating,
however many there are. A sweep empties each dish of its customers and seats them anew given all others (``seating``),
first in the contexts, then, with one customer for each table below, in the parent. A pair that occurs once has one
table whatever is drawn, so only the others are drawn. Averages over the sweeps after the first few are taken of each
pair's tables, each context's tables and the parent's probability of each word; what they predict sums to one. Every
draw is a hash of its sweep and pair, so no order of rows matters.

How it is spread out: pairs (context, word) are dealt to buckets by their context, those of a frequent context by their
word as well. A task counts what it has read and packs, for each bucket, sorted hashes and the texts that hold them;
so a pair leaves a task once, whatever number of texts hold it. Pairs that hold over ``HOT`` of all tokens, which
bounds their number, are looked up in a broadcast table and do not travel. Buckets give back sums for each text, packed
too. What a sweep knows of contexts and words are tables that are joined by their hashes, both sides shuffled; only one
row for each number of customers of the parent comes to the driver.

Defined cases: a null text is empty and has one token, its end; null ids are trained on (their fold is no held-out
one); repeated rows count as often as they occur and get equal scores; without training rows every probability is
that of the base; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, discard, encoded, from_planes, materialise, mix, pack, partitions_for, planes, prepare, unpack
from .seating import Seating

SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
FOLDS, FOLD = 7, 2
#: Share of all tokens from which a pair is looked up in a broadcast table; bounds their number to its inverse.
HOT = 2.0**-18
#: Steps of a unit in which sums travel.
FIXED = 2.0**30
#: One of so many texts says which contexts are frequent.
DEALT_BY = 64
#: Draws of the parent for each number of customers in each sweep.
CHAINS = 8
#: Tokens that a task packs at a time, and rows of a batch that it gives back.
HELD_TOKENS, OUT_ROWS = 1_200_000, 100_000
#: Distinct numbers of customers up to which their table, 16 bytes a row, is broadcast.
BROADCAST_COUNTS = 1_000_000
#: Words whose tables change from sweep to sweep, up to which these, 24 bytes each, are broadcast and not joined.
BROADCAST_TYPES = 1 << 20
#: Codes of pairs and rows are below this, else they are sorted as two numbers.
ONE_CODE = 1 << 62
#: The hash of the token that ends a text.
END = np.uint64(0x5E17A1B0C3D2E4F7)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of packed rows; what the model knows comes before the texts.
PAIRS, ROOMS, WORDS, TEXTS, SUMS = range(5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


class Tokens:
    """Tokens of several texts, one end after each: hash, text and context, the token before."""

    def __init__(self, texts: list[bytes]):
        words = Words([t.lower() for t in texts])
        n = len(words.starts) + len(texts)
        own = np.arange(len(words.starts)) + words.text
        ends = np.cumsum(words.counts) + np.arange(len(texts))
        self.hash, self.text = np.empty(n, np.uint64), np.empty(n, np.int64)
        self.hash[own], self.hash[ends] = words.hashes, END
        self.text[own], self.text[ends] = words.text, np.arange(len(texts))
        self.context = np.concatenate((self.hash[-1:], self.hash[:-1]))  # every text is followed by its end


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in encoded(batch["text"])]


def _key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * _GOLDEN + word)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unsigned(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64) if isinstance(column, pa.Array) else column.to_numpy().view(np.uint64)


class Dealer:
    """The bucket of a pair: by its context, or by both words if the context is frequent."""

    def __init__(self, buckets: int, frequent: np.ndarray):
        self.buckets, self.frequent = buckets, np.sort(frequent)

    def often(self, context: np.ndarray) -> np.ndarray:
        return _found(self.frequent, context)[1]

    def __call__(self, context: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
        h = mix(context ^ _GOLDEN)
        if word is not None and len(self.frequent):
            h = np.where(self.often(context), _key(word, context), h)
        return (h % np.uint64(self.buckets)).astype(np.int32)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _held(batches: Iterator[pa.RecordBatch], most: int = HELD_TOKENS) -> Iterator[tuple]:
    """doc_ids, train (by row) and tokens' context, hash and row, for about ``most`` tokens at a time."""
    ids, train, held, size, rows = [], [], [], 0, 0

    def give() -> tuple:
        columns = [list(x) for x in zip(*held, strict=True)]
        held.clear()
        out = [np.concatenate(columns.pop(0)) for _ in range(3)]  # the parts of each column go as it is joined
        return pa.concat_arrays(ids), np.concatenate(train), *out

    for batch in batches:
        texts, learns = _texts(batch), batch["train"].to_numpy(zero_copy_only=False).astype(bool)
        for a, b in chunks([len(t) for t in texts]):
            tokens = Tokens(texts[a:b])
            held.append((tokens.context, tokens.hash, (tokens.text + rows).astype(np.int32)))
            ids.append(batch["doc_id"].slice(a, b - a))
            train.append(learns[a:b])
            rows += b - a
            size += len(tokens.hash)
            if size > most:
                out = give()
                ids, train, size, rows = [], [], 0, 0
                yield out
                del out
    if held:
        yield give()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of rows with equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def word_counts(docs: DataFrame) -> DataFrame:
    """key (a word's hash) and n, its tokens; summed by each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, word, _ in _held(batches):
            key, n = np.unique(word, return_counts=True)
            for i in range(0, len(key), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([_signed(key[i : i + OUT_ROWS]), pa.array(n[i : i + OUT_ROWS])], ["key", "n"])

    return docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, buckets: int) -> np.ndarray:
    """Words with over a quarter of a bucket's share of the tokens, so fewer than four a bucket; by a hashed sample.

    They say where pairs are counted, not what is counted.
    """
    counts = materialise(word_counts(docs.filter(F.pmod(F.xxhash64("text"), F.lit(DEALT_BY)) == 0)))
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.filter(F.col("n") > tokens / (4 * buckets)).select("key").toArrow()["key"]
    discard(counts)
    return _unsigned(often)


class Coded:
    """Tokens of a chunk by their places in its sorted vocabulary, and its distinct pairs, sorted."""

    def __init__(self, context: np.ndarray, word: np.ndarray, row: np.ndarray, some: np.ndarray | slice = slice(None)):
        self.vocabulary, both = np.unique(np.concatenate((word, context[:1])), return_inverse=True)
        places = both.astype(np.int64)
        before = np.concatenate((places[-1:], places[:-2]))  # a context is the token before; the first one's is the end
        many, rows = len(self.vocabulary), int(row.max()) + 1
        code = (before * many + places[:-1])[some]
        row = row[some]
        if many * many * rows < ONE_CODE:
            code = code * rows + row
            code.sort()
            entry = _runs(code)
            self.many = np.diff(np.append(entry, len(code))).astype(np.int32)
            code, row = np.divmod(code[entry], rows)
        else:  # pair and row do not fit into one number
            order = np.lexsort((row, code))
            code, row = code[order], row[order]
            entry = _runs(code, row)
            self.many = np.diff(np.append(entry, len(code))).astype(np.int32)
            code, row = code[entry], row[entry]
        self.row = row.astype(np.int32)
        self.first = _runs(code)
        code = code[self.first]
        self.context, self.word = (x.astype(np.int32) for x in np.divmod(code, many))

    @classmethod
    def of_pairs(cls, context: np.ndarray, word: np.ndarray) -> Coded:
        """Distinct pairs; ``row`` says which of those given each is."""
        self = cls.__new__(cls)
        self.vocabulary, places = np.unique(np.concatenate((context, word)), return_inverse=True)
        context, word = places[: len(context)], places[len(context) :]
        self.row = np.lexsort((word, context))
        self.context, self.word = context[self.row].astype(np.int32), word[self.row].astype(np.int32)
        return self

    def by_bucket(self, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket and its pairs."""
        order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
        cuts = np.append(_runs(bucket[order]), len(order)) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(bucket[order[a]]), order[a:b]

    def packed(self, pairs: np.ndarray) -> list[bytes]:
        """Contexts, pairs of each, words, and the place of each pair's word."""
        context = self.context[pairs]
        first = np.append(_runs(context), len(pairs))
        words, at = np.unique(self.word[pairs], return_inverse=True)
        return [_steps(self.vocabulary[context[first[:-1]]]), planes(np.diff(first).astype(np.int32)), _steps(self.vocabulary[words]), planes(at.astype(np.int32))]


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys by the steps between them."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def _pairs_of(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    return _from_steps(parts[0]), from_planes(parts[1], np.int32), _from_steps(parts[2]), from_planes(parts[3], np.int32)


_ROW = "bucket int, kind int, payload binary"


def _rows(found: list[tuple[int, int, bytes]], names: tuple[str, ...] = ("bucket", "kind", "payload")) -> pa.RecordBatch:
    a, kind, payload = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64() if names[0] == "chunk" else pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], list(names))


def count_pairs(docs: DataFrame, deal: Dealer) -> DataFrame:
    """Rows of what the buckets count, by kind.

    PAIRS: a context, b word, n tokens in training rows, of those with n > 1 or in both kinds of rows; ROOMS: a context
    and WORDS: a bucket, b word, with n pairs that occur once and m tokens; SUMS: a = 1, 2, n pairs that occur so often.
    """
    sent = docs.sparkSession.sparkContext.broadcast(deal)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, train, context, word, row in _held(batches):
            pairs = Coded(context, word, row)
            learns = train[pairs.row]
            n = np.add.reduceat(np.where(learns, pairs.many, 0), pairs.first, dtype=np.int64).astype(np.int32)
            other = np.logical_or.reduceat(~learns, pairs.first)
            bucket = sent.value(pairs.vocabulary[pairs.context], pairs.vocabulary[pairs.word])
            yield _rows([(k, PAIRS, pack(*pairs.packed(of), planes(n[of]), other[of].tobytes())) for k, of in pairs.by_bucket(bucket)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, payload in zip(batch["bucket"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                of.setdefault(k, []).append(payload)
        for k, payloads in of.items():
            got = []
            for payload in payloads:
                parts = unpack(payload, 6)
                got.append((*_pairs_of(parts), from_planes(parts[4], np.int32), np.frombuffer(parts[5], bool)))
            payloads.clear()
            keys = np.unique(np.concatenate([x for g in got for x in (g[0], g[2])]))
            code = [np.repeat(np.searchsorted(keys, room) * len(keys), size) + np.searchsorted(keys, words)[at] for room, size, words, at, _, _ in got]
            code, n, other = np.concatenate(code), np.concatenate([g[4] for g in got]), np.concatenate([g[5] for g in got])
            del got
            order = np.argsort(code)
            code, n, other = code[order], n[order], other[order]
            first = _runs(code)
            context, word = (keys[x] for x in np.divmod(code[first], len(keys)))
            n, other = np.add.reduceat(n, first, dtype=np.int64), np.logical_or.reduceat(other, first)
            del code, order
            once, kept = n == 1, np.flatnonzero((n > 1) | (n == 1) & other)
            rooms = _runs(context)
            single = np.add.reduceat(once, rooms, dtype=np.int64)
            some = np.flatnonzero(single)
            order = np.argsort(word, kind="stable")
            words = _runs(word[order])
            zero = lambda m: np.zeros(m, np.uint64)
            parts = [
                (PAIRS, context[kept], word[kept], n[kept], None),
                (ROOMS, context[rooms][some], zero(len(some)), single[some], None),
                (WORDS, zero(len(words)) + np.uint64(k), word[order][words], np.add.reduceat(once[order], words, dtype=np.int64), np.add.reduceat(n[order], words)),
                (SUMS, np.array([1, 2], np.uint64), zero(2), np.array([once.sum(), (n == 2).sum()]), None),
            ]
            for kind, a, b, pairs, tokens in parts:
                tokens = np.zeros(len(a), np.int64) if tokens is None else tokens
                for i in range(0, len(a), OUT_ROWS):
                    j = slice(i, i + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[j]), kind, np.int32)), _signed(a[j]), _signed(b[j]), pa.array(pairs[j]), pa.array(tokens[j])], ["kind", "a", "b", "n", "m"])

    return docs.mapInArrow(send, _ROW).repartitionById(deal.buckets, F.col("bucket")).mapInArrow(count, "kind int, a long, b long, n long, m long")


def discount(counts: np.ndarray, many: np.ndarray | None = None) -> float:
    """The usual estimate from the numbers of singletons and pairs."""
    many = np.ones(len(counts)) if many is None else many
    one, two = many[counts == 1].sum(), many[counts == 2].sum()
    return float(np.clip(one / (one + 2 * two) if one + two else 0.5, 0.1, 0.95))


def uniforms(key: np.ndarray, sweep: int) -> np.ndarray:
    """A number in [0, 1) for each key and sweep."""
    return (mix(key + np.uint64((sweep + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) >> np.uint64(11)) * 2.0**-53


def refine(count: np.ndarray, words: np.ndarray, uniform: float, sweeps: int = 4, most_chains: int = CHAINS) -> tuple[np.ndarray, float]:
    """The parent's probability of a word by its customers (``count``, each of so many ``words``), and of an unseen one."""
    rng = np.random.default_rng(5)
    total, d = float((count * words).sum()), discount(count, words)
    seating, chains = Seating(d), max(1, min(most_chains, 4_000_000 // max(len(count), 1)))
    tables, kept, rest = np.ones(len(count)), np.zeros(len(count)), 0.0
    for _ in range(sweeps):
        for_all = np.tile(STRENGTH + d * (float((tables * words).sum()) - tables), chains)
        drawn = seating.draw(np.tile(count, chains), for_all, np.full(len(for_all), uniform), rng.random(len(for_all)))
        tables = drawn.reshape(chains, -1).mean(axis=0) if len(count) else tables
    rest = (STRENGTH + d * float((tables * words).sum())) / (STRENGTH + total) * uniform
    kept = (count - d * tables) / (STRENGTH + total) + rest
    return kept, rest


def _classes(types: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of customers of the parent, and how many words have each."""
    got = types.groupBy("served").agg(F.count("*").alias("words")).toArrow()
    return got["served"].to_numpy(), got["words"].to_numpy()


class Parent:
    """The parent's probabilities by the customers of a word, summed over the sweeps that count."""

    def __init__(self, passive: tuple[np.ndarray, np.ndarray], uniform: float):
        self.passive, self.uniform = passive, uniform
        self.kept, self.unseen = np.zeros(len(passive[0])), 0.0

    def chances(self, active: tuple[np.ndarray, np.ndarray], counts: bool) -> tuple[np.ndarray, np.ndarray]:
        customers, at = np.unique(np.concatenate((self.passive[0], active[0])), return_inverse=True)
        words = np.bincount(at, np.concatenate((self.passive[1], active[1])), minlength=len(customers))
        chance, unseen = refine(customers.astype(np.float64), words, self.uniform)
        if counts:
            self.kept += chance[at[: len(self.kept)]]
            self.unseen += unseen
        return customers, chance


def _by_class(types: DataFrame, customers: np.ndarray, values: np.ndarray, name: str) -> DataFrame:
    by_count = types.sparkSession.createDataFrame(pa.table({"c": pa.array(customers, pa.int64()), name: pa.array(values, pa.float64())}))
    if len(customers) <= BROADCAST_COUNTS:
        by_count = F.broadcast(by_count)
    return types.join(by_count, F.col("served") == F.col("c")).drop("c")


def _gathered(batches: Iterator[pa.RecordBatch], most: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``most`` rows or a little more: short ones cost as much as long ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def reseat(pairs: DataFrame, active: DataFrame, d: float, sweep: int, broadcast_types: int) -> DataFrame:
    """A draw for ``pairs`` (context, word, n, sum and t, the last draw) given ``active`` (key, tables and chance).

    Rows have the same columns; those with t = 0 say that ``context``, as a key, has n tables more, as a word sum.
    """
    sent = None
    if active.count() <= broadcast_types:
        got = active.toArrow()
        order = np.argsort(_unsigned(got["key"]))
        sent = pairs.sparkSession.sparkContext.broadcast((_unsigned(got["key"])[order], got["tables"].to_numpy()[order], got["chance"].to_numpy()[order]))
    else:
        pairs = pairs.join(active.select(F.col("key").alias("context"), "tables"), "context").join(active.select(F.col("key").alias("word"), "chance"), "word")
        pairs = pairs.select("context", "word", "n", "sum", "t", "tables", "chance")
    names = ["context", "word", "n", "sum", "t"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seating, held = Seating(d), []

        def more() -> Iterator[pa.RecordBatch]:
            keys, r, w = (np.concatenate(x) for x in zip(*held, strict=True))
            key, at = np.unique(keys, return_inverse=True)
            r, w = (np.bincount(at, x, minlength=len(key)).astype(np.int64) for x in (r, w))
            for i in range(0, len(key), OUT_ROWS):
                j = slice(i, i + OUT_ROWS)
                zero = pa.array(np.zeros(len(key[j]), np.int64))
                yield pa.RecordBatch.from_arrays([_signed(key[j]), zero, pa.array(r[j]), pa.array(w[j]), zero], names)

        for batch in _gathered(batches):
            context, word = _unsigned(batch["context"]), _unsigned(batch["word"])
            n, total, t = (batch[k].to_numpy(zero_copy_only=False) for k in ("n", "sum", "t"))
            if sent:
                keys, tables, chance = sent.value
                tables, chance = tables[np.searchsorted(keys, context)], chance[np.searchsorted(keys, word)]
            else:
                tables, chance = batch["tables"].to_numpy(), batch["chance"].to_numpy()
            t = seating.draw(n, STRENGTH + d * (tables - t), chance, uniforms(_key(context, word), sweep))
            total = total + t if sweep >= BURN_IN else total
            yield pa.RecordBatch.from_arrays([batch["context"], batch["word"], batch["n"], pa.array(total), pa.array(t)], names)
            for keys, as_context in ((context, 1), (word, 0)):
                key, at = np.unique(keys, return_inverse=True)
                sums = np.bincount(at, t, minlength=len(key))
                held.append((key, sums * as_context, sums * (1 - as_context)))
        if held:
            yield from more()

    return pairs.mapInArrow(draw, ", ".join(f"{k} long" for k in names))


def fit(docs: DataFrame, broadcast_types: int = BROADCAST_TYPES) -> dict:
    """The model of ``docs`` (doc_id, text, train).

    ``pairs``: context, word, n and mean (tables) of all pairs that buckets need; ``types``: key, known (tokens), room
    (the mean share of the parent in its context) and above (the parent's mean probability of it), of all words.
    """
    buckets = partitions_for(docs)
    deal = Dealer(buckets, frequent_words(docs, buckets))
    counted = materialise(count_pairs(docs, deal))
    of = lambda kind: counted.filter(F.col("kind") == kind)
    first = dict(of(SUMS).groupBy("a").agg(F.sum("n")).collect())
    d = discount(np.array([1, 2]), np.array([first.get(1, 0), first.get(2, 0)]))
    pairs = of(PAIRS).filter("n > 1").select(F.col("a").alias("context"), F.col("b").alias("word"), "n")
    # Tables of the pairs that occur once, as a context's and as a word's, then one of each other pair to begin with.
    zero = F.lit(0).cast("long")
    single = of(ROOMS).select(F.col("a").alias("key"), F.col("n").alias("r"), zero.alias("w"), zero.alias("m")).union(of(WORDS).filter("m > 0").select(F.col("b").alias("key"), zero.alias("r"), F.col("n").alias("w"), "m"))
    others = pairs.select(F.col("context").alias("key"), F.lit(1).alias("r"), F.lit(0).alias("w")).union(pairs.select(F.col("word"), F.lit(0), F.lit(1)))
    others = others.groupBy("key").agg(F.sum("r").alias("tables"), F.sum("w").alias("served"))
    types = single.groupBy("key").agg(F.sum("r").alias("room_once"), F.sum("w").alias("word_once"), F.sum("m").alias("known")).join(others, "key", "left")
    types = materialise(types.withColumns({"tables": F.col("room_once") + F.col("tables"), "served": F.col("word_once") + F.col("served")}))
    sums = types.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    tokens, kinds = sums["tokens"], sums["words"]
    uniform = 1 / (kinds + 1)
    later = materialise(counted.filter((F.col("kind") == WORDS) | (F.col("kind") == PAIRS) & (F.col("n") == 1)).select("kind", "a", "b"))
    # Words and contexts whose pairs all occur once, most of them, stay as they are.
    passive = types.filter("tables is null").select("key", "known", F.col("room_once").alias("tables"), F.col("word_once").alias("served"))
    active = types.filter("tables is not null").withColumns({"rooms": F.lit(0.0), "above": F.lit(0.0)})
    parent = Parent(_classes(passive), uniform)
    drawn, old = pairs.withColumns({"sum": zero, "t": F.lit(1).cast("long")}), []
    for sweep in range(SWEEPS + 1):
        counts = sweep > BURN_IN
        active = _by_class(active, *parent.chances(_classes(active), counts), "chance")
        if counts:
            active = active.withColumns({"above": F.col("above") + F.col("chance"), "rooms": F.col("rooms") + F.col("tables")})
        if sweep == SWEEPS:
            break
        written = materialise(reseat(drawn, active.select("key", "tables", "chance"), d, sweep, broadcast_types))
        drawn = written.filter("t > 0")
        more = written.filter("t = 0").groupBy(F.col("context").alias("key")).agg(F.sum("n").alias("r"), F.sum("sum").alias("w"))
        active = active.drop("tables", "served", "chance").join(more, "key")
        active = materialise(active.withColumns({"tables": F.col("room_once") + F.col("r"), "served": F.col("word_once") + F.col("w")}).drop("r", "w"))
        discard(*old, *([counted] if sweep == 0 else []))
        old = [written, active]
    kept = float(SWEEPS - BURN_IN)
    passive = _by_class(passive.withColumn("rooms", F.col("tables") * kept), parent.passive[0], parent.kept, "above")
    room = (STRENGTH + d * F.col("rooms") / kept) / (STRENGTH + F.col("known"))
    every = active.select("key", "known", "rooms", "above").union(passive.select("key", "known", "rooms", "above"))
    every = materialise(every.select("key", "known", room.alias("room"), (F.col("above") / kept).alias("above")))
    discard(types, *old[1:])
    seated = drawn.select("context", "word", "n", (F.col("sum") / kept).alias("mean"))
    once = later.filter(F.col("kind") == PAIRS).select(F.col("a").alias("context"), F.col("b").alias("word"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("mean"))
    bucket_words = later.filter(F.col("kind") == WORDS).select(F.col("a").cast("int").alias("bucket"), F.col("b").alias("key"))
    return {"pairs": seated.union(once), "types": every, "bucket_words": bucket_words, "deal": deal, "d": d, "unseen": parent.unseen / kept, "tokens": tokens, "kinds": kinds}


def probability(n, mean, known, room, above, d: float):
    """Of a word after a context that has ``known`` tokens, ``n`` of them this word at ``mean`` tables."""
    return (n - d * mean) / (STRENGTH + known) + room * above


def _hot(model: dict) -> dict:
    """Pairs over HOT of all tokens, sorted by key: their probabilities and the words' tokens; at most 1 / HOT rows."""
    types = model["types"]
    hot = model["pairs"].filter(F.col("n") > max(model["tokens"] * HOT, 1.0))
    hot = hot.join(types.select(F.col("key").alias("context"), F.col("known").alias("total"), "room"), "context").join(types.select(F.col("key").alias("word"), "known", "above"), "word")
    hot = hot.select("context", "word", "known", probability(F.col("n"), F.col("mean"), F.col("total"), F.col("room"), F.col("above"), model["d"]).alias("p")).toArrow()
    key = _key(_unsigned(hot["context"]), _unsigned(hot["word"]))
    order = np.argsort(key)
    return {"key": key[order], "context": _unsigned(hot["context"])[order], "word": _unsigned(hot["word"])[order], "log": np.log10(hot["p"].to_numpy()[order]), "known": hot["known"].to_numpy()[order]}


def _column(x: np.ndarray) -> list[bytes]:
    """Keys by the steps between them; numbers, of which many are equal, by their places among the distinct ones."""
    if x.dtype == np.uint64:
        return [_steps(x)]
    values, at = np.unique(x, return_inverse=True)
    return [values.tobytes(), planes(at.astype(np.int32))]


def _columns(parts: list[bytes], kinds: tuple[type, ...]) -> list[np.ndarray]:
    parts = iter(parts)
    return [_from_steps(next(parts)) if k is np.uint64 else np.frombuffer(next(parts), k)[from_planes(next(parts), np.int32)] for k in kinds]


def _model_rows(model: dict) -> DataFrame:
    """What the buckets must know, packed: pairs, contexts (frequent ones are sent to all tasks) and words."""
    deal = model["deal"]
    sent = model["types"].sparkSession.sparkContext.broadcast(deal)

    def rows(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(_runs(bucket[order]), len(order)) if len(order) else np.zeros(1, np.int64)
        return _rows([(int(bucket[order[a]]), kind, pack(*(x for c in columns for x in _column(c[order[a:b]])))) for a, b in zip(cuts, cuts[1:], strict=False)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 10 * OUT_ROWS):
            context, word = _unsigned(batch["context"]), _unsigned(batch["word"])
            n, mean = batch["n"].to_numpy(), batch["mean"].to_numpy().astype(np.float32)
            pairs = Coded.of_pairs(context, word)
            bucket = sent.value(context, word)[pairs.row]
            yield _rows([(k, PAIRS, pack(*pairs.packed(of), *_column(n[pairs.row[of]]), *_column(mean[pairs.row[of]]))) for k, of in pairs.by_bucket(bucket)])

    def rooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 10 * OUT_ROWS):
            key = _unsigned(batch["key"])
            some = np.flatnonzero(~sent.value.often(key))
            some = some[np.argsort(key[some])]
            yield rows(ROOMS, sent.value(key[some]), key[some], batch["known"].to_numpy()[some], batch["room"].to_numpy()[some])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 10 * OUT_ROWS):
            key = _unsigned(batch["key"])
            order = np.argsort(key)
            bucket = batch["bucket"].to_numpy()[order]
            yield rows(WORDS, bucket, key[order], batch["known"].to_numpy()[order], batch["above"].to_numpy()[order])

    types = model["types"]
    wanted = model["bucket_words"].join(types.select("key", "known", "above"), "key")
    return model["pairs"].mapInArrow(pairs, _ROW).union(types.select("key", "known", "room").mapInArrow(rooms, _ROW)).union(wanted.mapInArrow(words, _ROW))


class Known:
    """What a bucket knows, as sorted arrays."""

    def __init__(self, frequent: tuple[np.ndarray, ...]):
        self.held: dict[int, list[list[np.ndarray]]] = {PAIRS: [], ROOMS: [list(frequent)], WORDS: []}
        self.ready = False

    def add(self, kind: int, payload: bytes) -> None:
        if kind == PAIRS:
            parts = unpack(payload, 8)
            rooms, size, words, place = _pairs_of(parts)
            self.held[kind].append([np.repeat(rooms, size), words[place], *_columns(parts[4:], (np.int64, np.float32))])
        else:
            self.held[kind].append(_columns(unpack(payload, 5), (np.uint64, np.int64, np.float64)))

    def settle(self) -> None:
        if not self.ready:
            got = {k: [np.concatenate(x) for x in zip(*v, strict=True)] if v else [np.zeros(0, np.uint64)] * 4 for k, v in self.held.items()}
            self.held.clear()
            context, word, n, mean = got[PAIRS]
            self.pairs = self._sorted(_key(context, word), context, word, n, mean)
            self.rooms, self.words = self._sorted(*got[ROOMS][:3]), self._sorted(*got[WORDS][:3])
            self.ready = True

    @staticmethod
    def _sorted(*columns: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(columns[0])
        return [c[order] for c in columns]

    def scores(self, rooms: np.ndarray, size: np.ndarray, words: np.ndarray, place: np.ndarray, d: float, unseen: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probability of each pair if it occurs in training rows, if not, and its word's tokens there."""
        self.settle()
        at, there = _found(self.rooms[0], rooms)
        total = np.repeat(np.where(there, self.rooms[1][at] if len(self.rooms[0]) else 0, 0), size)
        room = np.repeat(np.where(there, self.rooms[2][at] if len(self.rooms[0]) else 1.0, 1.0), size)
        at, there = _found(self.words[0], words)
        known = np.where(there, self.words[1][at] if len(self.words[0]) else 0, 0)[place]
        above = np.where(there, self.words[2][at] if len(self.words[0]) else unseen, unseen)[place]
        context, word = np.repeat(rooms, size), words[place]
        key, has, theirs, n, mean = self.pairs
        at, there = _found(key, _key(context, word))
        if len(key):
            there &= (has[at] == context) & (theirs[at] == word)
            n, mean = np.where(there, n[at], 0), np.where(there, mean[at], 0)
        else:
            n = mean = np.zeros(len(word))
        unknown = probability(n, mean, total, room, above, d)
        once = np.where(there, unknown, probability(1, 1, total, room, above, d))
        return np.log10(once), np.log10(unknown), known


def _score_rows(docs: DataFrame, model: dict) -> DataFrame:
    """chunk, kind and payload: TEXTS (ids, folds, tokens and own sums of a chunk's texts) and SUMS of buckets."""
    spark, deal, d, unseen = docs.sparkSession, model["deal"], model["d"], model["unseen"]
    frequent = model["types"].join(F.broadcast(spark.createDataFrame(pa.table({"f": _signed(deal.frequent)}))), F.col("key") == F.col("f")).select("key", "known", "room").toArrow()
    frequent = tuple(x.to_numpy() for x in frequent.columns)
    frequent = (frequent[0].view(np.uint64), *frequent[1:])
    sent = spark.sparkContext.broadcast((deal, frequent, _hot(model)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, _, hot = sent.value
        part, seq = TaskContext.get().partitionId(), 0
        for ids, train, context, word, row in _held(batches):
            chunk = (part << 32) + seq
            seq += 1
            tokens = np.bincount(row, minlength=len(train))
            at, there = _found(hot["key"], _key(context, word))
            if len(hot["key"]):
                there &= (hot["context"][at] == context) & (hot["word"][at] == word)
            at, whose = at[there], row[there]
            score = np.bincount(whose, hot["log"][at], minlength=len(train))
            known = np.bincount(whose, minlength=len(train))
            base = np.bincount(whose, np.log10(hot["known"][at] + 1), minlength=len(train))
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            named = ids.fill_null(0).to_numpy()
            own = pack(*(np.ascontiguousarray(x).tobytes() for x in (named, missing, train, tokens, known.astype(np.int64), base, score)))
            out = [(chunk % deal.buckets, TEXTS, np.int64(chunk).tobytes() + b"\x01" + own)]
            if not there.all():
                pairs = Coded(context, word, row, ~there)
                head = np.int64(chunk).tobytes() + b"\x00"
                refs = np.diff(np.append(pairs.first, len(pairs.row))).astype(np.int32)
                entry = pairs.row * 2 + train[pairs.row]  # a text that holds the pair, and if it is learned from
                bucket = deal(pairs.vocabulary[pairs.context], pairs.vocabulary[pairs.word])
                for k, of in pairs.by_bucket(bucket):
                    mine = np.repeat(pairs.first[of] - np.cumsum(refs[of]) + refs[of], refs[of]) + np.arange(refs[of].sum())
                    out.append((k, TEXTS, head + pack(*pairs.packed(of), *(planes(x) for x in (refs[of], entry[mine].astype(np.int32), pairs.many[mine])))))
            for i in range(0, len(out), 64):
                yield _rows(out[i : i + 64])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            out = []
            for k, kind, payload in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
                if k != now:
                    now, known = k, Known(sent.value[1])
                if kind != TEXTS:
                    known.add(kind, payload)
                    continue
                chunk, own = int(np.frombuffer(payload[:8], np.int64)[0]), payload[8:9] == b"\x01"
                if own:
                    out.append((chunk, TEXTS, payload[9:]))
                    continue
                parts = unpack(payload[9:], 7)
                refs, row, many = (from_planes(x, np.int32) for x in parts[4:])
                once, unknown, tokens = known.scores(*_pairs_of(parts), d, unseen)
                pair = np.repeat(np.arange(len(refs)), refs)
                log = np.where(row & 1, once[pair], unknown[pair]) * many
                base, seen = (np.log10(tokens + 1)[pair] * many), np.where(tokens > 0, 1, 0)[pair] * many
                some, at = np.unique(row >> 1, return_inverse=True)
                sums = [np.bincount(at, x, minlength=len(some)) for x in (seen, base, log)]
                steps = (some.astype(np.uint64), sums[0].astype(np.int32), *(np.rint(x * FIXED).astype(np.int64) for x in sums[1:]))
                out.append((chunk, SUMS, pack(_steps(steps[0]), *map(planes, steps[1:]))))
            if out:
                yield _rows(out, ("chunk", "kind", "payload"))

    every = _model_rows(model).union(docs.mapInArrow(send, _ROW))
    dealt = every.repartitionById(deal.buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(look_up, "chunk long, kind int, payload binary")


def _summed(rows: DataFrame, model: dict, parts: int) -> DataFrame:
    """The scores of every text, from the sums of its chunk."""
    tokens, kinds = model["tokens"], model["kinds"]
    least = np.log10(tokens + kinds + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def result() -> pa.RecordBatch:
            ids, missing, train, n, known, base, score = held
            folds = [pa.array(ids, mask=missing), pa.array(~train), pa.array(n), pa.array(known), pa.array(base - n * least), pa.array(score)]
            return pa.RecordBatch.from_arrays(folds, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for chunk, kind, payload in zip(*(batch[c].to_pylist() for c in ("chunk", "kind", "payload")), strict=True):
                if chunk != now:
                    if held:
                        yield result()
                    now = chunk
                if kind == TEXTS:
                    kinds = (np.int64, bool, bool, np.int64, np.int64, np.float64, np.float64)
                    held = [np.frombuffer(x, k).copy() for x, k in zip(unpack(payload, 7), kinds, strict=True)]
                else:
                    some, *sums = unpack(payload, 4)
                    some = _from_steps(some).astype(np.int64)
                    held[4][some] += from_planes(sums[0], np.int32)
                    for total, x in zip(held[5:], sums[1:], strict=True):
                        total[some] += from_planes(x, np.int64) / FIXED
        if held:
            yield result()

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    dealt = rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    return dealt.mapInArrow(add, kind)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    own = own.withColumn("train", ~held_out(F.col("doc_id")))
    return predict(own, fit(own))


def predict(own: DataFrame, model: dict) -> DataFrame:
    """Scores of ``own``, the rows that the model was fitted on (doc_id, text, train)."""
    out = _summed(materialise(_score_rows(own, model)), model, model["deal"].buckets)
    return out.withColumn("train_tokens", F.lit(model["tokens"]).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
