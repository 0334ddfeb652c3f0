"""Nouns by a tagger: its tokens by sentence, phrases as runs of them, concreteness and synonyms by tables of senses.

A tagger is a provider (``providers.CONTRACTS["tagger"]``) that is asked once for each distinct sentence. Its tokens are
several times the text, so they stay in the sentence's row and phrases are told there, not dealt out as rows.

Defined cases: a sentence without an answer, or without tokens, has no nouns; null and empty sentences are not asked for;
repeated sentences get the same nouns; a word without a sense is not concrete; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import providers

NOUNS = ("NOUN", "PROPN")
#: What may stand before the nouns of a chunk.
BEFORE = ("DET", "ADJ", "NUM", "PRON")
# Classes of senses that are no things.
ABSTRACT = (
    "noun.feeling", "noun.attribute", "noun.state", "noun.shape", "noun.time", "noun.quantity",
    "noun.cognition", "noun.event", "noun.communication", "noun.relation", "noun.act", "noun.location",
)


def tokens(sentences: DataFrame, tagger: providers.Provider, kept: Callable[[DataFrame], DataFrame] = lambda told: told) -> DataFrame:
    """sentence and tokens (text, pos, lemma, in order) of each distinct sentence. ``kept`` says what of them is kept: it
    maps answers row by row where they come, so that nothing more of them is dealt by sentence."""
    asked = sentences.select("sentence").filter("sentence <> ''").distinct()
    return kept(providers.bound(tagger, providers.CONTRACTS["tagger"])(asked).select("sentence", "tokens")).dropDuplicates(["sentence"])


def _is(i: Column, pos: tuple[str, ...]) -> Column:
    """If the token at a place is one of these; none is outside of the sentence."""
    return F.coalesce(F.get("tokens", i)["pos"].isin(*pos), F.lit(False))


def _runs(begins: Callable[[Column], Column], ends: Callable[[Column], Column]) -> Column:
    """The runs of a row's tokens between the places where one begins and the next place where one ends: first and p."""
    places = F.transform("tokens", lambda t, i: i)
    run = lambda a, b: F.struct(a.alias("first"), F.slice("tokens", a + 1, b - a + 1).alias("p"))
    return F.zip_with(F.filter(places, begins), F.filter(places, ends), run)


def _words(p: Column) -> Column:
    return F.transform(p, lambda t: t["text"])


def phrases(nouns: tuple[str, ...] = NOUNS) -> Column:
    """first (place), phrase, lemma (the last word as its lemma) and words of a row's runs of nouns; null without tokens."""
    noun = lambda i: _is(i, nouns)
    lemma = lambda p: F.concat(F.slice(_words(p), F.lit(1), F.size(p) - 1), F.array(F.element_at(p, -1)["lemma"]))
    build = lambda r: F.struct(
        r["first"].alias("first"), F.array_join(_words(r["p"]), " ").alias("phrase"), F.array_join(lemma(r["p"]), " ").alias("lemma"), F.size(r["p"]).alias("words"),
    )
    return F.transform(_runs(lambda i: noun(i) & ~noun(i - 1), lambda i: noun(i) & ~noun(i + 1)), build)


def lemmas(nouns: tuple[str, ...] = NOUNS) -> Column:
    """i and lemma of a row's nouns; null without tokens."""
    placed = F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t["lemma"].alias("lemma"), t["pos"].isin(*nouns).alias("noun")))
    return F.transform(F.filter(placed, lambda t: t["noun"]), lambda t: F.struct(t["i"].alias("i"), t["lemma"].alias("lemma")))


def noun_phrases(tagged: DataFrame, nouns: tuple[str, ...] = NOUNS) -> DataFrame:
    """sentence, first (place), phrase, lemma (the last word as its lemma) and words: runs of nouns."""
    return tagged.select("sentence", F.inline(phrases(nouns)))


def noun_chunks(tagged: DataFrame, nouns: tuple[str, ...] = NOUNS) -> DataFrame:
    """sentence, first and chunk: a run of nouns with what may stand before it, in lower case, without a leading "the"."""
    noun, part = lambda i: _is(i, nouns), lambda i: _is(i, (*nouns, *BEFORE))
    # Something that stands before nouns begins a chunk, if a noun is before it.
    parted = lambda i: noun(i) & ~noun(i + 1)
    runs = _runs(lambda i: part(i) & (~part(i - 1) | parted(i - 1)), lambda i: part(i) & (~part(i + 1) | parted(i)))
    with_noun = F.filter(runs, lambda r: F.exists(r["p"], lambda t: F.coalesce(t["pos"].isin(*nouns), F.lit(False))))
    text = lambda r: F.regexp_replace(F.lower(F.array_join(_words(r["p"]), " ")), "^the ", "")
    return tagged.select("sentence", F.inline(F.transform(with_noun, lambda r: F.struct(r["first"].alias("first"), text(r).alias("chunk")))))


def noun_lemmas(tagged: DataFrame, nouns: tuple[str, ...] = NOUNS) -> DataFrame:
    """sentence, i and lemma of every noun."""
    return tagged.select("sentence", F.inline(lemmas(nouns)))


def concrete(words: DataFrame, senses: DataFrame, abstract: tuple[str, ...] = ABSTRACT) -> DataFrame:
    """word and concrete: whether the first sense of (word, sense, class) of each distinct word is of a class of things."""
    first = senses.groupBy(F.col("word").alias("known")).agg(F.min_by("class", "sense").alias("class"))
    rows = words.select("word").distinct().join(first, F.col("word") == F.col("known"), "left")
    return rows.select("word", F.coalesce(~F.col("class").isin(*abstract), F.lit(False)).alias("concrete"))


def synonyms(words: DataFrame, senses: DataFrame) -> DataFrame:
    """word and synonyms: the first lemma of each sense of (word, sense, lemmas), in the order of the senses, each once."""
    rows = words.select("word").distinct().join(senses.select("word", "sense", F.get("lemmas", F.lit(0)).alias("lemma")).filter("lemma is not null"), "word")
    told = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("sense", "lemma"))), lambda x: x["lemma"]))
    return rows.groupBy("word").agg(told.alias("synonyms"))


def accepted(phrases: DataFrame, known: DataFrame, concreteness: DataFrame) -> DataFrame:
    """Distinct (sentence, phrase) of ``phrases`` that ``known`` (word) lists, or whose last word's lemma is a thing."""
    rows = phrases.select("sentence", "phrase", F.element_at(F.split("lemma", " "), -1).alias("word")).distinct()
    listed = known.select(F.col("word").alias("phrase"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(listed, "phrase", "left").join(concreteness, "word", "left")
    return rows.filter(F.coalesce("_known", F.lit(False)) | F.coalesce("concrete", F.lit(False))).select("sentence", "phrase").distinct()
