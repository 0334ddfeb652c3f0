"""Nouns by a tagger."""

import random

from sentrellis.operators import nouns, providers
from sentrellis.plans import registry

POS = {"the": "DET", "old": "ADJ", "red": "ADJ", "fire": "NOUN", "truck": "NOUN", "trucks": "NOUN", "near": "ADP", "Paris": "PROPN", "idea": "NOUN", "two": "NUM", "is": "VERB"}


def tagger(rows):
    return [{"sentence": r["sentence"], "tokens": [{"text": w, "pos": POS.get(w.lower() if w != "Paris" else w, "X"), "lemma": w.rstrip("s") if w == "trucks" else w} for w in r["sentence"].split()]} for r in rows]


def test_nouns(spark):
    said = spark.createDataFrame([("The old fire trucks near Paris idea",), ("The old fire trucks near Paris idea",), ("two red truck the idea is",), ("near",), ("",), (None,)], "sentence string")
    tagged = nouns.tokens(said, providers.batched(tagger, providers.CONTRACTS["tagger"].answers))
    rows = lambda df, *c: sorted(tuple(r[k] for k in c) for r in df.collect())
    assert rows(nouns.noun_phrases(tagged), "first", "phrase", "lemma", "words") == [(2, "fire trucks", "fire truck", 2), (2, "truck", "truck", 1), (4, "idea", "idea", 1), (5, "Paris idea", "Paris idea", 2)]
    assert rows(nouns.noun_chunks(tagged), "first", "chunk") == [(0, "old fire trucks"), (0, "two red truck"), (3, "idea"), (5, "paris idea")]
    assert rows(nouns.noun_lemmas(tagged), "i", "lemma") == [(2, "fire"), (2, "truck"), (3, "truck"), (4, "idea"), (5, "Paris"), (6, "idea")]
    senses = spark.createDataFrame([("truck", 1, "noun.artifact", ["truck", "lorry"]), ("truck", 2, "noun.act", ["barter"]), ("idea", 1, "noun.cognition", ["idea"]), ("idea", 2, "noun.artifact", ["idea"]), ("idea", 3, "noun.act", None)], "word string, sense int, class string, lemmas array<string>")
    words = spark.createDataFrame([("truck",), ("idea",), ("unknown",), ("truck",)], "word string")
    things = nouns.concrete(words, senses)
    assert rows(things, "word", "concrete") == [("idea", False), ("truck", True), ("unknown", False)]
    assert rows(nouns.synonyms(words, senses), "word", "synonyms") == [("idea", ["idea"]), ("truck", ["truck", "barter"])]
    known = spark.createDataFrame([("Paris idea",)], "word string")
    assert rows(nouns.accepted(nouns.noun_phrases(tagged), known, things), "phrase") == [("Paris idea",), ("fire trucks",), ("truck",)]
    assert nouns.noun_phrases(tagged.limit(0)).collect() == []


def test_runs_of_any_tokens(spark):
    """Phrases, chunks and lemmas of random tokens, nulls among them, against plain loops; a sentence answered twice counts once."""
    rng = random.Random(5)
    kinds = ["NOUN", "PROPN", "DET", "ADJ", "VERB", None]
    said = {f"s{k}": [(f"W{rng.randrange(9)}", rng.choice(kinds), f"l{rng.randrange(9)}") for _ in range(rng.randrange(12))] for k in range(60)}
    said["long"] = [("w", "NOUN", "l")] * 3000 + [("The", "DET", "the"), (None, "NOUN", None)]
    told = lambda rows: [{"sentence": r["sentence"], "tokens": None if r["sentence"] == "s0" else [dict(zip(("text", "pos", "lemma"), t, strict=True)) for t in said[r["sentence"]]]} for r in rows for _ in range(2)]
    said["s0"] = []
    tagged = nouns.tokens(spark.createDataFrame([(s,) for s in said], "sentence string"), providers.batched(lambda rows: told(rows), providers.CONTRACTS["tagger"].answers))
    phrases, chunks, lemmas = [], [], []
    for s, tokens in said.items():
        run, part = [], []
        for i, (text, pos, lemma) in enumerate([*tokens, ("", "VERB", "")]):
            noun = pos in nouns.NOUNS
            if not noun and run:
                phrases.append((s, run[0][0], " ".join(x[1] for x in run if x[1] is not None), " ".join(x for x in [*(y[1] for y in run[:-1]), run[-1][2]] if x is not None), len(run)))
                run = []
            if part and (pos not in nouns.NOUNS + nouns.BEFORE or not noun and part[-1][2]):
                if any(x[2] for x in part):
                    chunk = " ".join(x[1] for x in part if x[1] is not None).lower()
                    chunks.append((s, part[0][0], chunk.removeprefix("the ")))
                part = []
            if noun:
                run.append((i, text, lemma))
                lemmas.append((s, i, lemma))
            if pos in nouns.NOUNS + nouns.BEFORE:
                part.append((i, text, noun))
    for got, want in ((nouns.noun_phrases(tagged), phrases), (nouns.noun_chunks(tagged), chunks), (nouns.noun_lemmas(tagged), lemmas)):
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_tokens_are_not_dealt_out(spark):
    """The query deals out sentences and their measures, no tokens."""
    plan = registry.queries()["txt15_17_tagged_nouns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "first(tokens" not in plan
