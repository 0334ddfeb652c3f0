"""Token counts without tokens: the best segmentation by a unigram vocabulary, counted only.

An Aho-Corasick automaton enumerates all vocabulary matches of a word; dynamic programming over its characters
carries the best score and the number of pieces. Tie rules are those of the tokenizer libraries: scores add up
from the left in double precision, and of equal scores the one whose last piece starts first stays. A character
that no piece covers costs the smallest score less 10 and counts as its UTF-8 bytes (byte fallback).

Words are runs of anything but ASCII white space, each with the word mark before it. The vocabulary, a bounded
table, is read on the driver and broadcast; a task remembers the counts of the words it has seen, ``REMEMBERED``
at most.

Defined cases: a null, empty or blank text has 0 tokens; a very long word is one word; repeated rows are counted
alike; an empty table gives an empty result; further columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, prepare, with_row

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, but for those that no text can be cut into: control, unknown,
    unused and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Counter(dict):
    """Pieces of words (UTF-8 bytes) by the best segmentation; a dict of those seen."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.match = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.match.add_word(piece, (len(piece), score))
        self.match.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.count(MARK + word.decode())
        return n

    def count(self, text: str) -> int:
        best, pieces = [0.0], [0]
        last = 0

        def uncovered(until: int) -> None:
            for i in range(len(best), until):
                best.append(best[-1] + self.unknown)
                pieces.append(pieces[-1] + len(text[i - 1].encode()))

        high, count, single = None, 0, False
        for end, (size, score) in self.match.iter(text):
            if end + 1 != last:
                if high is not None:
                    self._close(text, best, pieces, high, count, single)
                uncovered(end + 1)
                last, high, count, single = end + 1, None, 0, False
            start = end + 1 - size
            value = best[start] + score
            if high is None or value > high:
                high, count = value, pieces[start] + 1
            single |= size == 1
        if high is not None:
            self._close(text, best, pieces, high, count, single)
        uncovered(len(text) + 1)
        return pieces[-1]

    def _close(self, text: str, best: list[float], pieces: list[int], high: float, count: int, single: bool) -> None:
        """Settle one end: the longest matches came first; a character without a piece of its own comes last."""
        if not single and best[-1] + self.unknown > high:
            high, count = best[-1] + self.unknown, pieces[-1] + len(text[len(best) - 1].encode())
        best.append(high)
        pieces.append(count)


def token_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``row`` (the document's own columns), n_words and n_tokens."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            words, tokens = [], []
            for text in encoded(batch["text"]):
                parts = (text or b"").split()
                words.append(len(parts))
                tokens.append(sum(map(counter.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["row", "n_words", "n_tokens"])

    own = docs.select(F.struct("*").alias("row"))
    return own.select("row", F.col("row.text").alias("text")).mapInArrow(count, with_row(own, "n_words long, n_tokens long"))
