"""Tokens of texts by ranked byte-pair merges, with the byte where each ends, and preference pairs encoded from text.

The vocabulary is a file of lines "base64(token) rank", a bounded table that the driver reads and broadcasts. A task
remembers the tokens of the pieces that it has seen, ``REMEMBERED`` at most.

Defined cases: null and empty texts have no tokens; a text of one long word is merged as a whole, in time that grows little faster than
its length; repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import align

# Fixed value: the pattern that cuts texts into pieces before they are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Encoder:
    """Ids of texts; ``ranks`` must hold all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.size = ranks, {i: len(t) for t, i in ranks.items()}
        self.cut, self.seen = regex.compile(pattern).findall, {}

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The pair of neighbours with the lowest rank is merged first, of equal ones the leftmost."""
        if data in self.ranks:
            return (self.ranks[data],)
        n = len(data)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        pair = lambda i: self.ranks.get(data[i : end[after[i]]]) if after[i] < n else None
        waiting = [(rank, i, end[i + 1]) for i in range(n - 1) if (rank := pair(i)) is not None]
        heapq.heapify(waiting)
        gone = bytearray(n)
        while waiting:
            _, i, until = heapq.heappop(waiting)
            if gone[i] or after[i] >= n or end[after[i]] != until:
                continue  # one of the two has been merged otherwise
            j = after[i]
            gone[j], end[i], after[i] = 1, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (rank := pair(k)) is not None:
                    heapq.heappush(waiting, (rank, k, end[after[k]]))
        return tuple(self.ranks[data[i : end[i]]] for i in range(n) if not gone[i])

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for word in self.cut(text or ""):
            found = self.seen.get(word)
            if found is None:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = found = self.piece(word.encode())
            out += found
        return out

    def ends(self, ids: list[int]) -> list[int]:
        """The byte after each token."""
        out, at = [], 0
        for i in ids:
            at += self.size[i]
            out.append(at)
        return out


def encoded(df: DataFrame, columns: list[str], path: str, ends: bool = False) -> DataFrame:
    """``df`` with {c}_ids, and with ``ends`` {c}_ends, of each text column c."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    names = [f"{c}_{kind}" for c in columns for kind in (("ids", "ends") if ends else ("ids",))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            more = []
            for c in columns:
                ids = [encoder.encode(t) for t in pc.struct_field(batch["row"], batch["row"].type.get_field_index(c)).to_pylist()]
                more += [ids, [encoder.ends(x) for x in ids]] if ends else [ids]
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(x, pa.list_(pa.int32())) for x in more)], ["row", *names])

    own = df.select(F.struct("*").alias("row"))
    kind = StructType([own.schema["row"], *(StructField(n, ArrayType(IntegerType())) for n in names)])
    out = own.mapInArrow(run, kind)
    return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns), *names)


@dataclass(frozen=True)
class Template:
    """What stands around the turns of a conversation before they are encoded, each turn by itself; ``end`` ends an answer.
    Answers begin with their own text, so that a context's tokens are the same within an answer and alone."""

    system: tuple[str, str] = ("", "\n")
    user: tuple[str, str] = ("USER: ", " ASSISTANT: ")
    assistant: tuple[str, str] = ("", "</s>")
    end: int | None = None

    def turn(self, role: Column, content: Column) -> Column:
        around = lambda pair: F.concat(F.lit(pair[0]), content, F.lit(pair[1]))
        return F.when(role == "assistant", around(self.assistant)).when(role == "system", around(self.system)).otherwise(around(self.user))


def encode_rows(aligned: DataFrame, path: str, template: Template | None = None, cutoff: int = 2048) -> DataFrame:
    """chosen_ids, chosen_labels, rejected_ids and rejected_labels of aligned rows (_prompt, _response, _system,
    _context); rows without an odd number of prompt turns and two answers drop.

    A context goes before both answers; they then end at their last period, and labels count after the context only.
    """
    template = template or Template()
    rows = align.valid_pairs(aligned)
    context = F.when(F.col("_context") != "", F.col("_context"))
    answer = lambda i: F.concat(F.lit(template.assistant[0]), F.concat_ws(" ", context, F.get("_response", F.lit(i))["content"]))
    system = F.when(F.col("_system") != "", F.array(template.turn(F.lit("system"), F.col("_system")))).otherwise(F.array().cast("array<string>"))
    turns = F.concat(system, F.transform("_prompt", lambda t: template.turn(t["role"], t["content"])))
    keep = [c for c in aligned.columns if not c.startswith("_")]
    rows = rows.select(*keep, answer(0).alias("_chosen"), answer(1).alias("_rejected"), F.coalesce(context, F.lit("")).alias("_said"), turns.alias("_turns"))
    sent = encoded_lists(rows, ["_turns"], path)
    sent = encoded(sent, ["_chosen", "_rejected", "_said"], path)
    end = [F.array(F.lit(template.end))] if template.end is not None else []
    ids = lambda c: F.concat(F.col(c), *end) if end else F.col(c)
    period = read_ranks(path)[b"."]
    pairs = sent.select(*keep, F.flatten("_turns_ids").alias("prompt"), ids("_chosen_ids").alias("chosen"), ids("_rejected_ids").alias("rejected"), F.col("_said_ids").alias("context"))
    return align.encode_pairs(pairs, period, cutoff).drop("prompt", "chosen", "rejected", "context")


def encoded_lists(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """``df`` with {c}_ids, a list of ids for each text of the list c."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    names = [f"{c}_ids" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            more = [[[encoder.encode(t) for t in texts or []] for texts in pc.struct_field(batch["row"], batch["row"].type.get_field_index(c)).to_pylist()] for c in columns]
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(x, pa.list_(pa.list_(pa.int32()))) for x in more)], ["row", *names])

    own = df.select(F.struct("*").alias("row"))
    kind = StructType([own.schema["row"], *(StructField(n, ArrayType(ArrayType(IntegerType()))) for n in names)])
    out = own.mapInArrow(run, kind)
    return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns), *names)
