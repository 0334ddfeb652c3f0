"""Quality rules: every rule is evaluated once, and a bitmask of what failed is kept with the measurements.

One pass over the texts takes the measurements; rules are conditions on them, one bit each in ``failed``. Policies
are named, versioned sets of rules: a document stays under a policy if none of its bits is set. Further policies, and
what each rule of a policy rejects alone, come from the ledger; no text is read again. For ablations documents are
counted by their bitmask first (at most one row for each combination of rules), then compared with each policy's mask.

Words are exact: windows are compared by the numbers that a chunk's dictionary gives their words, not by hashes.

Defined cases: a null or empty text has no words and lines, and fails ``few_words`` alone; a text is measured whole in
one task, however long; repeated rows are measured alike; an empty table gives an empty ledger and no ablations;
further columns of any name are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, Words, chunks, encoded, prepare, with_row

WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines")
# Fixed characters of the measurements.
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•")
ELLIPSES = ("...", "…")

#: Rules by name, in the order of their bits; new ones are added at the end, so that stored ledgers keep their meaning.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_windows": lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 50,
    "short_words": lambda: F.col("word_chars") * 10 < F.col("n_words") * 20,
    "long_words": lambda: F.col("word_chars") > F.col("n_words") * 20,
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("n_words"),
    "repeated_lines": lambda: F.col("n_dup_lines") * 2 > F.col("n_lines"),
    "capitals": lambda: F.col("n_upper") > F.col("n_lower"),
    "few_letters": lambda: F.col("n_letter_words") * 10 < F.col("n_words") * 8,
    "bullets": lambda: F.col("n_bullet_lines") * 10 > F.col("n_lines") * 9,
    "ellipses": lambda: F.col("n_ellipsis_lines") * 10 > F.col("n_lines") * 3,
}

#: Policies: the rules that reject a document. "base" is part of all others.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "capitals"),
    "v2": tuple(RULES),
}
LATEST = "v2"


def _table(chars: str | bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


_SPACE, _SYMBOL, _UPPER, _LOWER = _table(WS), _table(SYMBOLS), _table(range(65, 91)), _table(range(97, 123))
_LETTER = _UPPER | _LOWER | _table(range(128, 256))
_FIRST = ~_table(range(128, 192))  # bytes that begin a code point
_BULLETS, _ELLIPSES = tuple(x.encode() for x in BULLETS), tuple(x.encode() for x in ELLIPSES)


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number below len(a) for each different pair."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def repeated_words(words: Words) -> np.ndarray:
    """For each word, whether a window of three words that its text holds twice or more covers it."""
    n, covered = len(words.starts), np.zeros(len(words.starts), bool)
    if n < WINDOW:
        return covered
    letters = words.buffer[~_SPACE[words.buffer]]
    ends = np.cumsum(np.concatenate(([0], words.ends - words.starts)), dtype=np.int64)
    names = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    number = names.dictionary_encode().indices.to_numpy()
    at = np.flatnonzero(words.text[: 1 - WINDOW] == words.text[WINDOW - 1 :])
    rank = words.text[at]
    for k in range(WINDOW):
        rank = _ranks(rank, number[at + k])
    twice = at[np.bincount(rank, minlength=1)[rank] > 1]
    for k in range(WINDOW):
        covered[twice + k] = True
    return covered


def _lines(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word; those equal to an earlier one, beginning with a bullet, ending with an ellipsis."""
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    bullets = sum(x.lstrip().startswith(_BULLETS) for x in lines)
    ellipses = sum(x.rstrip().endswith(_ELLIPSES) for x in lines)
    return len(lines), len(lines) - len(set(lines)), bullets, ellipses


def measured(texts: list[bytes]) -> np.ndarray:
    """MEASURES of each text, a row each."""
    words = Words(texts, hashed=False)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[at[1:] - 1] - total[at[:-1]]

    letters = np.concatenate(([0], np.cumsum(_LETTER[words.buffer], dtype=np.int64)))
    with_letter = letters[words.ends] > letters[words.starts]
    count = lambda flags: np.bincount(words.text[flags], minlength=len(texts))
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 4)
    columns = {
        "n_words": words.counts,
        "word_chars": per_text((_FIRST & ~_SPACE)[words.buffer]),
        "n_symbols": per_text(_SYMBOL[words.buffer]),
        "n_lines": lines[:, 0],
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": count(repeated_words(words)),
        "n_upper": per_text(_UPPER[words.buffer]),
        "n_lower": per_text(_LOWER[words.buffer]),
        "n_letter_words": count(with_letter),
        "n_bullet_lines": lines[:, 2],
        "n_ellipsis_lines": lines[:, 3],
    }
    return np.stack([columns[name] for name in MEASURES], 1).astype(np.int64)


def mask(rules: tuple[str, ...]) -> int:
    """The bits of some rules."""
    return sum(1 << list(RULES).index(name) for name in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """``row`` (the document's own columns), the measurements, and failed: bit k is set if rule k fails."""
    prepare(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in encoded(batch["text"])]
            parts = [measured(texts[a:b]) for a, b in chunks([len(t) for t in texts])]
            found = np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)), np.int64)
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(found[:, k]) for k in range(len(MEASURES)))], ["row", *MEASURES])

    own = docs.select(F.struct("*").alias("row"))
    out = own.select("row", F.col("row.text").alias("text")).mapInArrow(measure, with_row(own, ", ".join(f"{m} long" for m in MEASURES)))
    bits = [F.when(rule(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return out.withColumn("failed", failed)


def fails(policy: str, failed: Column | None = None) -> Column:
    """Whether a document is rejected by a policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def quality_rules(docs: DataFrame, policy: str = LATEST) -> DataFrame:
    """The documents that a policy keeps."""
    kept = ledger(docs).filter(~fails(policy))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def ablations(entries: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """For each policy and each of its rules: documents, those rejected, those that the rule fails, and those that
    only this rule rejects, which leaving it out would bring back."""
    counted = entries.groupBy("failed").agg(F.count("*").alias("n"))
    names = list(RULES)
    cells = [F.struct(F.lit(p).alias("policy"), F.lit(mask(POLICIES[p])).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for p in policies for r in POLICIES[p]]
    each = counted.select("failed", "n", F.inline(F.array(*cells)))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(hit != 0)("n_rejected"),
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        total(hit == F.col("bit"))("n_only"),
    )


def profiles(entries: DataFrame, *by: str) -> DataFrame:
    """For each group: documents, the rules that any of them fails, and those that all fail (bitmasks)."""
    return entries.groupBy(*by).agg(F.count("*").alias("n_docs"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"))
