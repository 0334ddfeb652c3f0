"""Text functions on captions, answers and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import Lexicon

IRREGULAR = {"people": "person", "men": "man", "women": "woman", "children": "child", "mice": "mouse", "geese": "goose", "feet": "foot", "teeth": "tooth", "knives": "knife", "wolves": "wolf", "oxen": "ox"}


def _last(parts: Column) -> Column:
    return F.element_at(parts, -1)


def sentences(text: Column) -> Column:
    """Sentences with their marks, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def noun_lemma(word: Column) -> Column:
    """The singular of a noun by rule, irregular ones by a short list."""
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    regular = (
        F.when(word.rlike("(ss|us|is)$") | (F.length(word) < 4), word)
        .when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ch|sh|x|ss|zz)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )
    return F.coalesce(F.try_element_at(irregular, word), regular)


def phrase_lemma(phrase: Column) -> Column:
    """A phrase with the last of its words as a lemma."""
    parts = F.split(F.trim(phrase), " +")
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.when(F.size(parts) > 1, F.concat_ws(" ", head, noun_lemma(_last(parts)))).otherwise(noun_lemma(_last(parts)))


def merge_pairs(parts: Column, lexicon: Lexicon, keep_single: bool = True) -> Column:
    """Words with known pairs merged greedily from the left; both words of a merged pair are used up."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("before"), F.lit(False).alias("open"))

    def step(acc: Column, word: Column) -> Column:
        pair = lexicon.merged(F.concat_ws(" ", acc["before"], word))
        joined = acc["open"] & pair.isNotNull()
        closed = F.when(acc["open"], F.concat(acc["out"], F.array(acc["before"]))).otherwise(acc["out"]) if keep_single else acc["out"]
        return F.when(joined, F.struct(F.concat(acc["out"], F.array(pair)).alias("out"), F.lit("").alias("before"), F.lit(False).alias("open"))).otherwise(F.struct(closed.alias("out"), word.alias("before"), F.lit(True).alias("open")))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"], F.concat(acc["out"], F.array(acc["before"]))).otherwise(acc["out"]) if keep_single else acc["out"]

    return F.aggregate(parts, start, step, finish)


def drop_seat(parts: Column) -> Column:
    """Without "seat" where there is a "toilet"."""
    return F.when(F.array_contains(parts, "toilet"), F.array_remove(parts, "seat")).otherwise(parts)


def caption_words(text: Column, lexicon: Lexicon) -> Column:
    """Lemmas of a caption with pairs merged and the seat rule applied."""
    return drop_seat(merge_pairs(F.transform(words(text), noun_lemma), lexicon))


def extract_objects(text: Column, lexicon: Lexicon, represent: bool = True) -> Column:
    """Known objects of a caption in order, repeats kept, as representatives or as written."""
    found = F.filter(caption_words(text, lexicon), lexicon.known)
    return F.transform(found, lexicon.head) if represent else found


def distinct_objects(text: Column, lexicon: Lexicon) -> Column:
    return F.array_distinct(extract_objects(text, lexicon))


def object_pairs(parts: Column, lexicon: Lexicon) -> Column:
    """(word, representative) of the known objects among words."""
    return F.transform(F.filter(parts, lexicon.known), lambda w: F.struct(w.alias("word"), lexicon.head(w).alias("rep")))


def mentions(text: Column, masked: Column, lexicon: Lexicon) -> Column:
    """If a response mentions the masked object or its representative."""
    found = extract_objects(text, lexicon)
    return F.array_contains(found, lexicon.head(masked)) | F.array_contains(found, masked)


def triples(text: Column) -> Column:
    """(subject, predicate, object) of each "( s, p, o )" in a scene graph's text."""
    inner = F.filter(F.transform(F.split(F.regexp_replace(F.trim(text), r"^\( ?| ?\)$", ""), r" ?\), ?\( ?"), lambda t: F.split(t, ", ")), lambda p: F.size(p) == 3)
    return F.transform(inner, lambda p: F.struct(F.trim(p[0]).alias("s"), F.trim(p[1]).alias("p"), F.trim(p[2]).alias("o")))


def triple_mentions(graph: Column) -> Column:
    """Objects of triples: of "is" and "are" the subject alone, of all others both ends; distinct, in order."""
    both = F.transform(graph, lambda t: F.when(t["p"].isin("is", "are"), F.array(t["s"])).otherwise(F.array(t["s"], t["o"])))
    return F.array_distinct(F.flatten(both))


def is_concrete(phrase: Column, classes: Column, abstract: list[str]) -> Column:
    """If any word of a phrase has a noun class, by the map ``classes``, that is not abstract."""
    return F.exists(F.split(phrase, " "), lambda w: F.coalesce(~F.try_element_at(classes, w).isin(*abstract), F.lit(False)))


def synonyms(word: Column, first_lemmas: Column) -> Column:
    """First lemmas of a word's senses, from a map of word to array; distinct and sorted."""
    return F.array_sort(F.array_distinct(F.coalesce(F.try_element_at(first_lemmas, word), F.array().cast("array<string>"))))


def clean_chunk(chunk: Column) -> Column:
    return F.trim(F.replace(F.lower(chunk), F.lit("the"), F.lit("")))


def pack_objects(objects: Column) -> Column:
    """Distinct objects as one detector caption, "a.b."; sorted, for sets have no order."""
    return F.concat(F.array_join(F.array_sort(F.array_distinct(objects)), "."), F.lit("."))


def unpack_objects(caption: Column) -> Column:
    return F.split(F.rtrim(caption, F.lit(".")), r"\.")


def same_caption(a: Column, b: Column) -> Column:
    """If two detector captions list the same labels in any order."""
    return F.array_sort(F.split(F.lower(a), r"\.")) == F.array_sort(F.split(F.lower(b), r"\."))


def first_sentence(text: Column) -> Column:
    return F.concat(F.substring_index(text, ".", 1), F.lit("."))


def after_first_sentence(text: Column) -> Column:
    at = F.locate(".", text)
    return F.when(at > 0, F.ltrim(F.substr(text, at + 1))).otherwise(F.lit(""))


def last_fragment(text: Column) -> Column:
    """What follows the last ". "."""
    return _last(F.split(text, r"\. "))


def sentence_at(text: Column, k: int) -> Column:
    return F.concat(F.ltrim(F.get(F.split(text, r"\."), F.lit(k))), F.lit("."))


def last_sentences(sents: Column, k: int) -> Column:
    """The last ``k`` sentences as one context; all of them if ``k`` is negative."""
    kept = sents if k < 0 else F.slice(sents, F.greatest(F.size(sents) - k, F.lit(0)) + 1, F.lit(k))
    return F.array_join(kept, " ")


def remove_boxes(text: Column) -> Column:
    """Without the box annotations that a correcting model leaves in its text."""
    for pattern in (r"\(\[.*?\]\)", r"\(\[.*?\];", r"\[.*?\];"):
        text = F.regexp_replace(text, pattern, "")
    return text


def remove_negative(text: Column) -> Column:
    """Without the sentences that say that there is no such thing."""
    return F.array_join(F.filter(sentences(text), lambda s: ~(s.contains("There is no") | s.contains("There are no"))), " ")


def stops(text: Column, keywords: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k))


def generated_sentence(text: Column) -> Column:
    """A text up to its first sentence mark, as a generator with stop tokens would end it."""
    return F.regexp_extract(text, "^[^.!?]*[.!?]", 0)


def is_short(caption: Column, most: int = 3) -> Column:
    return F.size(F.split(F.trim(caption), r"\s+")) <= most


# Fixed values of the answer normaliser.
NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ("a", "an", "the")
PUNCTUATION = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't",
    "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't",
    "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't",
    "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd",
    "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've",
    "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's",
    "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've",
    "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've",
    "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at",
    "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've",
    "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've",
    "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd",
    "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll",
    "thats": "that's", "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've",
    "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've",
    "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't",
    "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't", "whatll": "what'll",
    "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd",
    "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've",
    "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's",
    "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd",
    "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}


def normalise_answer(answer: Column) -> Column:
    """An answer in the form that leaderboards compare: lower case, without marks and articles, digits for numbers."""
    text = F.trim(F.lower(answer))
    for a, b in ((",", ""), ("?", ""), ("'s", " 's")):
        text = F.replace(text, F.lit(a), F.lit(b))
    given = F.trim(F.translate(F.trim(text), "\n\t", "  "))
    text = given
    for mark in PUNCTUATION:
        apart = F.contains(given, F.lit(f"{mark} ")) | F.contains(given, F.lit(f" {mark}"))
        text = F.replace(text, F.lit(mark), F.when(apart, F.lit("")).otherwise(F.lit(" ")))
    text = F.lower(F.regexp_replace(text, r"\.(?!\d)", ""))
    numbers = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    short = F.create_map(*[F.lit(x) for pair in CONTRACTIONS.items() for x in pair])
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES))
    parts = F.filter(F.transform(parts, lambda w: F.coalesce(F.try_element_at(numbers, w), w)), lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def yes_no(answer: Column) -> Column:
    """"no" if the first sentence holds No, not or no as a word, else "yes"."""
    tokens = F.split(F.replace(F.substring_index(answer, ".", 1), F.lit(","), F.lit("")), " ")
    return F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, ("No", "not", "no")))), "no").otherwise("yes")


def option_letter(answer: Column, letters: str = "ABCDE") -> Column:
    """The letter that an answer picks, "FAILED" if it picks none or several."""
    one = f"[{letters}]"
    found = F.regexp_extract_all(answer, F.lit(r"The answer is ([A-Z])\."), F.lit(1))
    return (
        F.when(answer.rlike(f"^{one}$"), answer)
        .when(answer.rlike(rf"^{one}\. "), F.substring(answer, 1, 1))
        .when(answer.rlike(rf"^{one}\.$"), F.substring(answer, 1, 1))
        .when(F.size(found) == 1, F.get(found, F.lit(0)))
        .otherwise("FAILED")
    )


def option_index(letter: Column, choices: Column, letters: str = "ABCDE") -> Column:
    """Index of a letter among so many choices, -1 beyond them."""
    at = F.locate(letter, F.lit(letters)) if isinstance(letter, str) else F.instr(F.lit(letters), letter)
    return F.when((F.length(letter) == 1) & (at > 0) & (at <= choices), at - 1).otherwise(-1)


def prompt_question(prompt: Column) -> Column:
    """The question of a prompt in one of its three forms, lower case; null for any other form."""
    lines = F.split(prompt, "\n")
    return F.lower(
        F.when(prompt.startswith("OCR tokens: "), F.regexp_extract(prompt, r"(?s)Question: (.*?) Short answer:", 1))
        .when(F.contains(prompt, F.lit("Reference OCR token: ")) & (F.size(lines) == 3), F.when(prompt.startswith("Reference OCR token:"), F.get(lines, F.lit(1))).otherwise(F.get(lines, F.lit(0))))
        .when(F.size(lines) == 2, F.get(lines, F.lit(0)))
    )


def verdict_code(judgement: Column) -> Column:
    """A judge's text as "0" (incorrect), "1" (correct) or "2" (neither); "incorrect" is looked for first."""
    low = F.lower(judgement)
    return F.when(F.contains(low, F.lit("incorrect")), "0").when(F.contains(low, F.lit("correct")), "1").otherwise("2")


def same_code(judgement: Column) -> Column:
    return F.when(F.contains(F.lower(judgement), F.lit("same")), "1").otherwise("0")


def json_list(content: Column) -> Column:
    """A list of strings from a model's answer: in a code fence, bare, or on the last line; null if none is there."""
    blank = F.lit(" \t\r\n")
    bare = F.btrim(F.regexp_replace(F.btrim(content, blank), r"^```(json)?|```$", ""), blank)
    parse = lambda c: F.from_json(F.when(c.startswith("["), c), "array<string>")
    return F.coalesce(parse(bare), parse(_last(F.split(bare, "\n"))))


# Fixed markers of responses that carry a corrected text.
MARKERS = (
    ("The following is a response without hallucination.", -1),
    ("The following is a response with hallucination.", 1),
    ("Generate a response without errors.", -1),
    ("Generate a response with errors.", 1),
)


def corrected_response(text: Column) -> Column:
    """The part of a response that a marker names as free of errors; the whole text without a marker."""
    out = F.when(F.lit(False), text)
    for marker, part in MARKERS:
        out = out.when(F.contains(text, F.lit(marker)), F.trim(F.substring_index(text, marker, part)))
    return out.otherwise(text)


def image_tag_first(value: Column) -> Column:
    """With the image tag in front if there is one."""
    moved = F.concat(F.lit("<image>\n"), F.trim(F.replace(value, F.lit("<image>"), F.lit(""))))
    return F.when(F.contains(value, F.lit("<image>")), moved).otherwise(value)


def chat_prompt(system: Column, messages: Column, style: str, sep: str = "###", sep2: str = "</s>") -> Column:
    """A conversation, an array of (role, message), as one prompt in one of five separator styles."""
    said = lambda m: F.coalesce(m["message"], F.lit("")) != ""
    by_turn = lambda i: F.when(i % 2 == 0, sep).otherwise(sep2)
    if style in ("single", "two"):
        part = lambda m, i: F.when(said(m), F.concat(m["role"], F.lit(": "), m["message"], by_turn(i) if style == "two" else F.lit(sep))).otherwise(F.concat(m["role"], F.lit(":")))
        head = F.concat(system, F.lit(sep))
    elif style == "mpt":
        part = lambda m, i: F.when(said(m), F.concat(m["role"], m["message"], F.lit(sep))).otherwise(m["role"])
        head = F.concat(system, F.lit(sep))
    elif style == "plain":
        part = lambda m, i: F.when(said(m), F.concat(m["message"], by_turn(i))).otherwise("")
        head = system
    elif style == "llama_2":
        intro = F.when(F.length(system) > 0, F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"))).otherwise("")
        asked = lambda m, i: F.concat(F.lit(sep), F.lit("[INST] "), F.when(i == 0, intro).otherwise(""), m["message"], F.lit(" [/INST]"))
        part = lambda m, i: F.when(said(m), F.when(i % 2 == 0, asked(m, i)).otherwise(F.concat(F.lit(" "), m["message"], F.lit(f" {sep2}")))).otherwise("")
        return F.ltrim(F.array_join(F.transform(messages, part), ""), F.lit(sep)) if sep else F.array_join(F.transform(messages, part), "")
    else:
        raise ValueError(f"unknown separator style: {style}")
    return F.concat(head, F.array_join(F.transform(messages, part), ""))


def user_assistant(user: Column, assistant: Column) -> Column:
    return F.when(F.coalesce(assistant, F.lit("")) != "", F.concat_ws(" ", user, assistant)).otherwise(user)


def speaker_turns(conversation: Column, human: str = "human", assistant: str = "gpt") -> Column:
    """Turns (from, value) under their signals, each "### SPEAKER: text" on a line of its own."""
    name = lambda t: F.when(t["from"] == human, human).when(t["from"] == assistant, assistant).otherwise("unknown")
    return F.concat(F.array_join(F.transform(conversation, lambda t: F.concat(F.lit("### "), name(t), F.lit(": "), t["value"], F.lit("\n"))), ""), F.lit("### "))


def model_size(name: Column) -> Column:
    return _last(F.split(name, "[-_]"))


def model_version(name: Column, versions: list[str]) -> Column:
    """The first of some versions that a name contains."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(v)), v) for v in versions])


def display_name(path: Column) -> Column:
    """The last part of a model's path, with the one before it for a checkpoint."""
    parts = F.split(F.trim(path, F.lit("/")), "/")
    return F.when(_last(parts).startswith("checkpoint-") & (F.size(parts) > 1), F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), _last(parts))).otherwise(_last(parts))


def strip_output(text: Column) -> Column:
    return F.trim(F.rtrim(text, F.lit("\n")))
