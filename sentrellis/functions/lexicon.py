"""Lexicons: words with a representative each, and pairs of words that count as one. Passed as data, never global.

The large synonym lists that captions need are parameters (``parse_synonyms`` reads their usual text form); fixed
here are only the short lists that all lexicons share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word pairs that are one object.
DOUBLE_WORDS = (
    "motor bike", "motor cycle", "air plane", "traffic light", "street light", "traffic signal", "stop light",
    "fire hydrant", "stop sign", "parking meter", "suit case", "sports ball", "baseball bat", "baseball glove",
    "tennis racket", "wine glass", "hot dog", "cell phone", "mobile phone", "teddy bear", "hair drier",
    "potted plant", "bow tie", "laptop computer", "stove top oven", "home plate", "train track", "dining table",
    "coffee table",
)
ANIMALS = ("bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "animal", "cub")
VEHICLES = ("jet", "train")
RENAMED = {"bow tie": "tie", "toilet seat": "toilet", "wine glas": "wine glass"}

# Objects of the scene-graph data set.
SCENE_OBJECTS = (
    "tree", "window", "shirt", "building", "person", "table", "car", "door", "light", "fence", "chair", "people",
    "plate", "glass", "jacket", "sidewalk", "snow", "flower", "hat", "bag", "track", "roof", "umbrella", "helmet",
    "plant", "train", "bench", "box", "food", "pillow", "bus", "bowl", "horse", "trunk", "clock", "mountain",
    "elephant", "giraffe", "banana", "house", "cabinet", "hill", "dog", "book", "bike", "coat", "glove", "zebra",
    "bird", "motorcycle", "lamp", "cow", "skateboard", "surfboard", "beach", "sheep", "kite", "cat", "pizza", "bed",
    "bear", "windshield", "towel", "desk",
)


def parse_synonyms(text: str) -> tuple[list[str], dict[str, str]]:
    """All words of a list with one comma-separated group a line, and the head of each word's group; blanks drop."""
    words, heads = [], {}
    for line in text.splitlines():
        group = [w for w in (part.strip() for part in line.split(",")) if w]
        words += group
        heads |= dict.fromkeys(group, group[0]) if group else {}
    return words, heads


def double_words(evaluation: bool = False) -> dict[str, str]:
    """Pairs of words and what they become; an evaluation lexicon also knows young and grown animals."""
    pairs = {w: w for w in DOUBLE_WORDS}
    if evaluation:
        pairs |= {f"{age} {a}": a for a in ANIMALS for age in ("baby", "adult")}
    return pairs | {f"passenger {v}": v for v in VEHICLES} | RENAMED


def _literal(pairs: dict[str, str]) -> Column:
    items = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.create_map(*items) if items else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


@dataclass(frozen=True)
class Lexicon:
    """Words with their representatives, and word pairs; a few hundred entries, so literals of the plan."""

    heads: dict[str, str]
    pairs: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_text(cls, text: str, evaluation: bool = False) -> Lexicon:
        return cls(parse_synonyms(text)[1], double_words(evaluation))

    def words(self) -> Column:
        return F.array(*map(F.lit, self.heads))

    def known(self, word: Column) -> Column:
        return word.isin(*self.heads)

    def head(self, word: Column) -> Column:
        """The representative of a word, the word itself if it is in no group."""
        return F.coalesce(F.try_element_at(_literal(self.heads), word), word)

    def merged(self, pair: Column) -> Column:
        """What a pair of words becomes, null if it is no entry."""
        return F.try_element_at(_literal(self.pairs), pair)

    def table(self, spark: SparkSession) -> DataFrame:
        """The lexicon as a dimension table for joins."""
        return spark.createDataFrame(list(self.heads.items()), "word string, rep string")
