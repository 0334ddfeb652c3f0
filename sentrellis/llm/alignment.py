"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids meet there.

A text is cut before spaces that follow a printable ASCII character. No token of either vocabulary crosses such a
cut (``Aligner`` checks it), so each piece is encoded by itself, and a task encodes each different piece once, as
long as it remembers it. Within a piece B's tokens are intervals of bytes in order: an index that bisection stabs with
the start and end of each token of A gives the range of B tokens that overlap it; the gaps that no token of either
side spans end the groups, and the two tokens before such a gap are linked.

Pairs of linked ids are counted over all documents; B ids get their highest count. Frequent pairs, at most ``HOT`` by
their definition, are sent to all tasks; the rest of a document's pairs are joined.

Defined cases: a null or empty text, or one that either tokenizer does not give back byte by byte, has no tokens;
special tokens in texts are plain text; a piece without spaces is encoded whole, however long; repeated rows count
each; an empty table gives an empty result; further columns of any name are kept in ``row``, which leaves out text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import chunks, discard, encoded, materialise, prepare, with_row

FOLDER = "/opt/tokenizers"
MODEL_A, MODEL_B = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Pieces and bytes of them that a task remembers; texts that it works on at a time.
REMEMBERED, REMEMBERED_BYTES, CHUNK_BYTES = 300_000, 16 << 20, 2 << 20
#: Pairs with more than one of so many links are sent to all tasks.
HOT = 1 << 20
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters of byte-level tokens: printable Latin bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, model_a: bytes, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_buffer(model_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        alphabet = byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        crossing = re.compile(rb"[!-~] ")
        self.cut = not any(crossing.search(t) for t in (*self.bytes_a, *self.bytes_b))

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space, which the second tokenizer adds itself."""
        many = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return [e.ids for e in many(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the range of B tokens that share bytes with it; B's intervals are in order and apart."""
    return np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")


class Aligner:
    """Alignment of pieces by number: tokens of A and B, groups, the groups in writing, linked pairs of ids."""

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (encoders.bytes_a, encoders.bytes_b))
        self.name_a, self.name_b = ([b"%d" % i for i in range(len(x))] for x in (self.size_a, self.size_b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.written: list[bytes] = []
        self.bytes = 0
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and B, links, whether the bytes differ
        self.pairs = np.zeros(0, np.int64)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces; those not seen before are aligned together."""
        if len(self.number) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self.number]
        if new:
            self._align(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def _side(self, ids: list[list[int]], size: np.ndarray, token: list[bytes], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in a row, tokens of each piece, and pieces whose bytes the tokens don't give."""
        flat = np.array([i for x in ids for i in x], np.int64)
        n = np.array([len(x) for x in ids], np.int64)
        bad = np.zeros(len(pieces), bool)
        if b"".join(map(token.__getitem__, flat.tolist())) != b"".join(pieces):
            bad = np.array([b"".join(map(token.__getitem__, x)) != p for x, p in zip(ids, pieces, strict=True)])
        return flat, n, bad

    def _align(self, pieces: list[bytes]) -> None:
        a_lists, b_lists = self.encoders.encode([p.decode() for p in pieces])
        sides = ((a_lists, self.size_a, self.encoders.bytes_a), (b_lists, self.size_b, self.encoders.bytes_b))
        bad = np.logical_or(*(self._side(ids, size, token, pieces)[2] for ids, size, token in sides))
        if bad.any():
            a_lists, b_lists = ([[] if x else ids for x, ids in zip(bad.tolist(), lists, strict=True)] for lists in (a_lists, b_lists))
            sides = ((a_lists, self.size_a, self.encoders.bytes_a), (b_lists, self.size_b, self.encoders.bytes_b))
        good = [b"" if x else p for x, p in zip(bad.tolist(), pieces, strict=True)]
        (a, n_a, _), (b, n_b, _) = (self._side(ids, size, token, good) for ids, size, token in sides)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        low, high = overlaps(end_a - self.size_a[a], end_a, end_b - self.size_b[b], end_b)
        # The gap after a token of A ends a group if B's last token over it ends there as well.
        last = high - 1
        ends = np.flatnonzero((high > low) & (end_b[np.maximum(last, 0)] == end_a)) if len(b) else np.zeros(0, np.int64)
        piece = np.repeat(np.arange(len(pieces)), n_a)[ends]
        self.pairs = np.concatenate((self.pairs, a[ends] << 32 | b[last[ends]]))
        n_links = np.bincount(piece, minlength=len(pieces))
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, n_links, bad), 1)))
        names_a, names_b = [self.name_a[i] for i in a.tolist()], [self.name_b[i] for i in b.tolist()]
        groups, i, k = [], 0, 0
        for j, m in zip((ends + 1).tolist(), (last[ends] + 1).tolist(), strict=True):
            groups.append(b",".join(names_a[i:j]) + b"|" + b",".join(names_b[k:m]))
            i, k = j, m
        at = 0
        for n in n_links.tolist():
            self.written.append(b";".join(groups[at : at + n]))
            at += n
        self.bytes += sum(map(len, pieces))


def _expanded(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(first - start, size)


def _aligned(aligner: Aligner, texts: list[bytes]) -> dict[str, list | np.ndarray]:
    """Columns of some texts, none of them empty."""
    spaced = [b" " + t for t in texts]
    data = b"".join(spaced)
    begin = np.cumsum([0, *map(len, spaced)])
    x = np.frombuffer(data, np.uint8)
    cut = np.zeros(len(x) + 1, bool)
    if aligner.encoders.cut:
        cut[1:-1] = (x[1:] == 32) & (x[:-1] > 32) & (x[:-1] < 127)
        cut[begin[1:] - 1] = False  # a space that ends a text stays with what is before it: B adds none to an empty piece
    cut[begin] = True
    at = np.flatnonzero(cut)
    places = at.tolist()
    number = aligner.numbers([data[i:j] for i, j in zip(places, places[1:], strict=False)])
    doc = np.searchsorted(begin, at[:-1], "right") - 1
    first = np.searchsorted(at[:-1], begin[:-1])
    counts = np.add.reduceat(aligner.counts[number], first) if len(first) else np.zeros((0, 4), np.int64)
    good = counts[:, 3] == 0
    counts[~good] = 0
    shas, edge = [], [*first.tolist(), len(number)]
    numbers = number.tolist()
    for k, fine in enumerate(good.tolist()):
        shas.append(hashlib.sha256(b";".join(map(aligner.written.__getitem__, numbers[edge[k] : edge[k + 1]]))).hexdigest() if fine else "")
    size = aligner.counts[number, 2] * good[doc]
    start = (np.cumsum(aligner.counts[:, 2]) - aligner.counts[:, 2])[number]
    pair, owner = aligner.pairs[_expanded(start, size)], np.repeat(doc, size)
    known, code = np.unique(pair, return_inverse=True)
    key, times = np.unique(owner * max(1, len(known)) + code, return_counts=True)
    owner, pair = np.divmod(key, max(1, len(known)))
    return {"counts": counts[:, :3], "sha": shas, "pairs": known[pair], "times": times, "size": np.bincount(owner, minlength=len(texts))}


def aligned_documents(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """``row`` (the document's columns without text), uid (unlike in each row), n_a, n_b, n_links, groups_sha256, and
    the different pairs of linked ids, a * 2^32 + b, with how often each is linked."""
    spark = docs.sparkSession
    prepare(spark)
    models = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (model_a, model_b)))  # noqa: SIM115

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, uid = Aligner(Encoders(*models.value)), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t or b"" for t in encoded(batch["text"])]
            for lo, hi in chunks([len(t) for t in texts], CHUNK_BYTES):
                some = [k for k in range(lo, hi) if texts[k]]
                found = _aligned(aligner, [texts[k] for k in some]) if some else None
                counts, sha, size = np.zeros((hi - lo, 3), np.int64), [""] * (hi - lo), np.zeros(hi - lo, np.int64)
                if found:
                    place = np.array(some) - lo
                    counts[place], size[place] = found["counts"], found["size"]
                    for k, s in zip(place.tolist(), found["sha"], strict=True):
                        sha[k] = s
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
                pairs = pa.ListArray.from_arrays(offsets, pa.array(found["pairs"] if found else [], pa.int64()))
                times = pa.ListArray.from_arrays(offsets, pa.array(found["times"] if found else [], pa.int32()))
                columns = [batch["row"].slice(lo, hi - lo), pa.array(np.arange(uid, uid + hi - lo)), *(pa.array(counts[:, k]) for k in range(3)), pa.array(sha), pairs, times]
                yield pa.RecordBatch.from_arrays(columns, ["row", "uid", "n_a", "n_b", "n_links", "groups_sha256", "pairs", "times"])
                uid += hi - lo

    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")).alias("row"), "text")
    kind = with_row(own, "uid long, n_a long, n_b long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    return own.mapInArrow(align, kind)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (its links in all documents) and best (whether no other pair of its B id has more)."""
    counts = materialise(found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")))
    id_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(id_b.alias("b")).agg(F.max("n").alias("most"))  # at most a row for each id of B
    return counts.withColumn("b", id_b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, hot: int = HOT) -> DataFrame:
    """``row``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    Groups end where both sides end, and no token is empty, so that each group has one link."""
    spark = docs.sparkSession
    found = materialise(aligned_documents(docs, model_a, model_b))
    counts = pair_counts(found)
    total = found.agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
    frequent = counts.filter(F.col("n") * hot > total).orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast(tuple(frequent[c].to_numpy() for c in ("pair", "n", "best")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            own, times = (batch[c].flatten().to_numpy() for c in ("pairs", "times"))
            size = pc.list_value_length(batch["pairs"]).to_numpy()
            doc = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            at, edge = at[hit], np.searchsorted(doc[hit], np.arange(len(size) + 1))
            sums = [np.diff(np.concatenate(([0], np.cumsum(times[hit] * x[at])))[edge]) for x in (best, n)]
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[~hit], minlength=len(size))))), pa.int32())
            rest = (pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (own, times))
            columns = [*(batch[c] for c in ("row", "uid", "n_a", "n_b", "n_links", "groups_sha256")), *map(pa.array, sums), *rest]
            yield pa.RecordBatch.from_arrays(columns, ["row", "uid", "n_a", "n_b", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times"])

    more = "uid long, n_a long, n_b long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<int>"
    summed = materialise(found.mapInArrow(add, with_row(found, more)))
    rest = summed.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rest.join(counts.filter(F.col("n") * hot <= total), "pair")
    late = rare.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("late_best"), F.sum(F.col("times") * F.col("n")).alias("late_sum"))
    out = summed.join(late, "uid", "left")
    with_late = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    discard(found)
    return out.select("row", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", with_late("n_best", "late_best"), with_late("count_sum", "late_sum"), "groups_sha256")
