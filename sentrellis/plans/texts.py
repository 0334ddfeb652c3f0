"""Text, array and geometry functions on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import boxes as B
from ..functions import maths as M
from ..functions import text as X
from ..operators import nouns, providers, similarity
from .bindings import LEXICON, query, table

SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


@query("txt1_sentences", f"SELECT doc_id, CAST(len({SENTENCES}) AS INT) AS n, md5(array_to_string({SENTENCES}, '|')) AS digest FROM documents")
def txt1_sentences(spark: SparkSession, d: str) -> DataFrame:
    """TXT1: sentences of every document."""
    s = X.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query("txt2_words", "SELECT doc_id, CAST(len(w) AS INT) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def txt2_words(spark: SparkSession, d: str) -> DataFrame:
    """TXT2: words of every document."""
    w = X.words(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


LEMMA_SQL = """CASE w WHEN 'people' THEN 'person' WHEN 'men' THEN 'man' WHEN 'women' THEN 'woman' WHEN 'children' THEN 'child' WHEN 'mice' THEN 'mouse' WHEN 'geese' THEN 'goose'
 WHEN 'feet' THEN 'foot' WHEN 'teeth' THEN 'tooth' WHEN 'knives' THEN 'knife' WHEN 'wolves' THEN 'wolf' WHEN 'oxen' THEN 'ox' ELSE
 CASE WHEN regexp_matches(w, '(ss|us|is)$') OR length(w) < 4 THEN w WHEN regexp_matches(w, 'ies$') THEN regexp_replace(w, 'ies$', 'y')
 WHEN regexp_matches(w, '(ch|sh|x|ss|zz)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, 's$') THEN regexp_replace(w, 's$', '') ELSE w END END"""


@query("txt3_lemmas", f"SELECT lemma, CAST(count(*) AS BIGINT) AS n FROM (SELECT {LEMMA_SQL} AS lemma FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)) GROUP BY lemma")
def txt3_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """TXT3: lemmas of all words; each distinct word is derived once."""
    words = docs(spark, d).select(F.explode(X.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(X.noun_lemma(F.col("w")).alias("lemma")).agg(F.sum("n").alias("n"))


@query("txt4_phrase_lemma", f"SELECT p_partkey, regexp_extract(p_name, '^(.*) ', 1) || ' ' || lemma AS lemma FROM (SELECT p_partkey, p_name, {LEMMA_SQL} AS lemma FROM (SELECT *, split_part(p_name, ' ', 2) || 's' AS w FROM part))")
def txt4_phrase_lemma(spark: SparkSession, d: str) -> DataFrame:
    """TXT4: the last word of a phrase as a lemma."""
    return part(spark, d).select("p_partkey", X.phrase_lemma(F.concat("p_name", F.lit("s"))).alias("lemma"))


@query("win7_8_merge_pairs", """WITH w AS (SELECT p_partkey, CASE WHEN p_name IN ('hot rod', 'cold plate') THEN [p_name] ELSE string_split(p_name, ' ') END AS a FROM part)
SELECT p_partkey, array_to_string(list_concat(list_concat(a, ['hot rod']), ['anvil']), '|') AS merged, CASE WHEN len(a) = 1 THEN a[1] || '|' ELSE '' END || 'hot rod' AS pairs_only FROM w""")
def win7_8_merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """WIN7-8: known pairs merged greedily, with and without the words between."""
    words = F.split(F.concat("p_name", F.lit(" hot rod anvil")), " ")
    return part(spark, d).select("p_partkey", F.array_join(X.merge_pairs(words, LEXICON), "|").alias("merged"), F.array_join(X.merge_pairs(words, LEXICON, keep_single=False), "|").alias("pairs_only"))


@query("txt8_seat_rule", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'toilet|bowl' ELSE 'seat|bowl' END AS words FROM part")
def txt8_seat_rule(spark: SparkSession, d: str) -> DataFrame:
    """TXT8: no seat beside a toilet."""
    words = F.when(F.col("p_size") % 2 == 1, F.array(*map(F.lit, ("toilet", "seat", "bowl")))).otherwise(F.array(*map(F.lit, ("seat", "bowl"))))
    return part(spark, d).select("p_partkey", F.array_join(X.drop_seat(words), "|").alias("words"))


@query("prj25_txt11_triples", """SELECT p_partkey, CAST(2 AS INT) AS n, split_part(p_name, ' ', 2) || '.' || p_brand AS mentions, split_part(p_name, ' ', 1) AS second_object FROM part""")
def prj25_txt11_triples(spark: SparkSession, d: str) -> DataFrame:
    """PRJ25, TXT11: triples of a scene graph and the objects they mention."""
    noun, adjective = F.element_at(F.split("p_name", " "), 2), F.element_at(F.split("p_name", " "), 1)
    graph = X.triples(F.concat(F.lit("( "), noun, F.lit(", has, "), "p_brand", F.lit(" ), ( "), noun, F.lit(", is, "), adjective, F.lit(" )")))
    return part(spark, d).select("p_partkey", F.size(graph).alias("n"), F.array_join(X.triple_mentions(graph), ".").alias("mentions"), F.get(graph, F.lit(1))["o"].alias("second_object"))


@query("txt13_concrete", "SELECT p_partkey, split_part(p_name, ' ', 2) NOT IN ('gizmo', 'anvil') AS concrete FROM part")
def txt13_concrete(spark: SparkSession, d: str) -> DataFrame:
    """TXT12-13: concrete nouns by a table of noun classes."""
    classes = {"widget": "artifact", "gear": "artifact", "plate": "artifact", "bolt": "artifact", "ring": "artifact", "rod": "artifact", "gizmo": "cognition"}
    literal = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return part(spark, d).select("p_partkey", X.is_concrete(F.col("p_name"), literal, ["cognition", "feeling"]).alias("concrete"))


@query("txt18_pack_objects", """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '.' ORDER BY o_orderpriority) || '.' AS packed, CAST(count(DISTINCT o_orderpriority) AS INT) AS n FROM orders GROUP BY o_custkey""")
def txt18_pack_objects(spark: SparkSession, d: str) -> DataFrame:
    """TXT18, FLT19: objects packed into one caption and unpacked."""
    packed = table(spark, d, "orders").groupBy("o_custkey").agg(X.pack_objects(F.collect_list("o_orderpriority")).alias("packed"))
    return packed.withColumn("n", F.size(X.unpack_objects(F.col("packed"))))


@query("txt19_21_sentence_parts", """SELECT doc_id, md5(split_part(text, '.', 1) || '.') AS first, md5(CASE WHEN contains(text, '.') THEN ltrim(substr(text, instr(text, '.') + 1)) ELSE '' END) AS rest,
 md5(string_split(text, '. ')[-1]) AS last, md5(ltrim(string_split(text, '.')[2]) || '.') AS second FROM documents""")
def txt19_21_sentence_parts(spark: SparkSession, d: str) -> DataFrame:
    """TXT19-21: first sentence, the rest, the last fragment and the second sentence."""
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.md5(X.first_sentence(t)).alias("first"), F.md5(X.after_first_sentence(t)).alias("rest"), F.md5(X.last_fragment(t)).alias("last"), F.md5(X.sentence_at(t, 1)).alias("second"))


@query("txt22_context", f"SELECT doc_id, md5(array_to_string(({SENTENCES})[-3:], ' ')) AS context FROM documents")
def txt22_context(spark: SparkSession, d: str) -> DataFrame:
    """TXT22, WIN2: the last three sentences as context."""
    return docs(spark, d).select("doc_id", F.md5(X.last_sentences(X.sentences(F.col("text")), 3)).alias("context"))


@query("txt23_remove_boxes", "SELECT p_partkey, 'a ' || p_name || '  and  end' AS cleaned FROM part")
def txt23_remove_boxes(spark: SparkSession, d: str) -> DataFrame:
    """TXT23: box annotations removed."""
    text = F.concat(F.lit("a "), "p_name", F.lit(" ([0.1, 0.2]) and [0.3];[0.4, "), F.col("p_size").cast("string"), F.lit("]; end"))
    return part(spark, d).select("p_partkey", X.remove_boxes(text).alias("cleaned"))


@query("flt13_remove_negative", "SELECT p_partkey, 'A ' || p_name || '.' || CASE WHEN p_size % 2 = 1 THEN ' It is fine.' ELSE '' END AS kept FROM part")
def flt13_remove_negative(spark: SparkSession, d: str) -> DataFrame:
    """FLT13: sentences that deny an object removed."""
    text = F.concat(F.lit("A "), "p_name", F.lit(". There is no gear. "), F.when(F.col("p_size") % 2 == 1, "It is fine.").otherwise("There are no bolts!"))
    return part(spark, d).select("p_partkey", X.remove_negative(text).alias("kept"))


def _answer() -> Column:
    odd = F.pmod(F.col("p_size"), F.lit(7))
    return (
        F.when(odd == 0, F.concat(F.lit("The two "), "p_name", F.lit("s.")))
        .when(odd == 1, F.concat(F.lit("3.5 kg, "), "p_brand"))
        .when(odd == 2, F.concat(F.lit("well-known "), "p_type"))
        .when(odd == 3, F.concat(F.lit("dont - stop; an "), "p_name"))
        .when(odd == 4, F.lit("1,000 (a) b's?"))
        .when(odd == 5, F.concat("p_type", F.lit("/"), "p_name"))
        .otherwise(F.concat(F.lit("a. b\t"), "p_name", F.lit(" wont\nnone")))
    )


SQL_ANSWER = """CASE p_size % 7 WHEN 0 THEN 'The two ' || p_name || 's.' WHEN 1 THEN '3.5 kg, ' || p_brand WHEN 2 THEN 'well-known ' || p_type WHEN 3 THEN 'dont - stop; an ' || p_name
 WHEN 4 THEN '1,000 (a) b''s?' WHEN 5 THEN p_type || '/' || p_name ELSE 'a. b' || chr(9) || p_name || ' wont' || chr(10) || 'none' END"""


def _normalise_sql(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    given = f"trim(translate(trim(replace(replace(replace(trim(lower({text})), ',', ''), '?', ''), '''s', ' ''s')), chr(10) || chr(9), '  '))"
    marked = "g"
    for m in X.PUNCTUATION:
        marked = f"replace({marked}, {q(m)}, CASE WHEN contains(g, {q(m + ' ')}) OR contains(g, {q(' ' + m)}) THEN '' ELSE ' ' END)"
    # RE2 has no look-ahead: a period goes unless a digit follows, found by a second pass that keeps the digit.
    marked = f"regexp_replace(regexp_replace({marked}, '\\.([0-9])', chr(1) || '\\1', 'g'), '\\.', '', 'g')"
    number = "CASE w " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.NUMBERS.items()) + " ELSE w END"
    short = "CASE w " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.CONTRACTIONS.items()) + " ELSE w END"
    split = f"list_filter(string_split_regex(trim(replace({marked}, chr(1), '.')), '\\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"
    return f"SELECT p_partkey, array_to_string(list_transform(list_transform({split}, lambda w: {number}), lambda w: {short}), ' ') AS answer FROM (SELECT p_partkey, {given} AS g FROM part)"


@query("txt24_normalise_answer", _normalise_sql(SQL_ANSWER))
def txt24_normalise_answer(spark: SparkSession, d: str) -> DataFrame:
    """TXT24: answers in the form that leaderboards compare."""
    return part(spark, d).select("p_partkey", X.normalise_answer(_answer()).alias("answer"))


@query("txt26_27_options", """WITH a AS (SELECT p_partkey, CAST(2 + p_partkey % 4 AS INT) AS choices, chr(CAST(65 + p_size % 6 AS INT)) AS l, p_size % 5 AS k FROM part), f AS (
 SELECT *, CASE WHEN k = 4 THEN 'FAILED' WHEN k = 3 THEN l WHEN l > 'E' THEN 'FAILED' ELSE l END AS letter FROM a)
SELECT p_partkey, letter, CASE WHEN length(letter) = 1 AND instr('ABCDE', letter) BETWEEN 1 AND choices THEN CAST(instr('ABCDE', letter) - 1 AS INT) ELSE -1 END AS idx FROM f""")
def txt26_27_options(spark: SparkSession, d: str) -> DataFrame:
    """TXT26-27: the option that an answer picks, and its index within the choices."""
    letter = F.chr(65 + F.col("p_size") % 6)
    kind = F.col("p_size") % 5
    text = F.when(kind == 0, letter).when(kind == 1, F.concat(letter, F.lit(". thing"))).when(kind == 2, F.concat(letter, F.lit("."))).when(kind == 3, F.concat(F.lit("The answer is "), letter, F.lit("."))).otherwise("no idea")
    picked = part(spark, d).select("p_partkey", X.option_letter(text).alias("letter"), (2 + F.col("p_partkey") % 4).cast("int").alias("choices"))
    return picked.select("p_partkey", "letter", X.option_index(F.col("letter"), F.col("choices")).alias("idx"))


@query("txt28_prompt_question", """SELECT p_partkey, lower(CASE WHEN p_size % 5 = 4 THEN NULL ELSE 'What is ' || p_name || '?' END) AS question FROM part""")
def txt28_prompt_question(spark: SparkSession, d: str) -> DataFrame:
    """TXT28: the question of a prompt in each of its forms."""
    q = F.concat(F.lit("What is "), "p_name", F.lit("?"))
    k = F.col("p_size") % 5
    prompt = (
        F.when(k == 0, F.concat(F.lit("OCR tokens: x\nQuestion: "), q, F.lit(" Short answer:")))
        .when(k == 1, F.concat(F.lit("Reference OCR token: x\n"), q, F.lit("\nAnswer.")))
        .when(k == 2, F.concat(q, F.lit("\nReference OCR token: x\nAnswer.")))
        .when(k == 3, F.concat(q, F.lit("\nAnswer.")))
        .otherwise(q)
    )
    return part(spark, d).select("p_partkey", X.prompt_question(prompt).alias("question"))


@query("txt29_31_judge_codes", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2' END AS verdict, CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END AS same, p_brand || '_' || p_size AS key FROM part""")
def txt29_31_judge_codes(spark: SparkSession, d: str) -> DataFrame:
    """TXT29-31: a judge's words as codes, and composite keys."""
    said = F.when(F.col("p_size") % 3 == 0, "It is Incorrect, not correct").when(F.col("p_size") % 3 == 1, "Correct").otherwise("unclear")
    same = F.when(F.col("p_size") % 2 == 0, "The Same").otherwise("different")
    return part(spark, d).select("p_partkey", X.verdict_code(said).alias("verdict"), X.same_code(same).alias("same"), F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("key"))


@query("txt32_json_list", """SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) END AS items FROM part""")
def txt32_json_list(spark: SparkSession, d: str) -> DataFrame:
    """TXT32: a list from a model's answer, fenced, bare or on the last line."""
    items = F.concat(F.lit('["'), F.replace("p_name", F.lit(" "), F.lit('", "')), F.lit('"]'))
    k = F.col("p_size") % 4
    text = F.when(k == 0, F.concat(F.lit("```json\n"), items, F.lit("\n```"))).when(k == 1, items).when(k == 2, F.concat(F.lit("Here it is:\n"), items)).otherwise("none")
    return part(spark, d).select("p_partkey", F.array_join(X.json_list(text), "|").alias("items"))


@query("txt33_34_36_markers", """SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN p_name || ' text' ELSE p_name END AS corrected, CASE WHEN p_size % 2 = 0 THEN '<image>' || chr(10) || p_name ELSE p_name END AS tagged,
 CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' ' || p_brand END AS prompt FROM part""")
def txt33_34_36_markers(spark: SparkSession, d: str) -> DataFrame:
    """TXT33, TXT34, TXT36: corrected responses, image tags in front, prompts of user and assistant."""
    k, even = F.col("p_size") % 3, F.col("p_size") % 2 == 0
    text = F.when(k == 0, F.concat(F.lit("bad The following is a response without hallucination. "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" Generate a response with errors. bad"))).otherwise(F.concat("p_name", F.lit(" text")))
    tagged = F.when(even, F.concat("p_name", F.lit("\n<image>"))).otherwise(F.col("p_name"))
    return part(spark, d).select("p_partkey", X.corrected_response(text).alias("corrected"), F.replace(X.image_tag_first(tagged), F.concat("p_name", F.lit("\n")), F.col("p_name")).alias("tagged"), X.user_assistant(F.col("p_name"), F.when(even, "").otherwise(F.col("p_brand"))).alias("prompt"))


@query("txt38_40_names", """SELECT p_partkey, 'vlm_' || p_size || 'b' AS shown, p_size || 'b' AS size, 'v1.5' AS version, p_name AS stripped FROM part""")
def txt38_40_names(spark: SparkSession, d: str) -> DataFrame:
    """TXT38-40: names of models from paths, their size and version, stripped output."""
    name = F.concat(F.lit("vlm_"), F.col("p_size").cast("string"), F.lit("b"))
    return part(spark, d).select("p_partkey", X.display_name(F.concat(F.lit("/models/"), name, F.lit("/"))).alias("shown"), X.model_size(name).alias("size"), X.model_version(F.concat(F.lit("vlm-v1.5-"), name), ["v1.6", "v1.5"]).alias("version"), X.strip_output(F.concat(F.lit(" "), "p_name", F.lit("\n\n"))).alias("stripped"))


CHAT = "SELECT conv_id, list({'role': role, 'message': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id"


def conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("message"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("m"))


@query("txt35_chat_prompts", f"""WITH c AS ({CHAT}) SELECT conv_id,
 md5('sys###' || array_to_string(list_transform(m, lambda x: x.role || ': ' || x.message || '###'), '')) AS single,
 md5('sys###' || array_to_string(list_transform(m, lambda x, i: x.role || ': ' || x.message || CASE WHEN i % 2 = 1 THEN '###' ELSE '</s>' END), '')) AS two,
 md5('sys###' || array_to_string(list_transform(m, lambda x: x.role || x.message || '###'), '')) AS mpt,
 md5('sys' || array_to_string(list_transform(m, lambda x, i: x.message || CASE WHEN i % 2 = 1 THEN '###' ELSE '</s>' END), '')) AS plain FROM c""")
def txt35_chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    """TXT35: conversations as prompts in each separator style."""
    prompt = lambda style: F.md5(X.chat_prompt(F.lit("sys"), F.col("m"), style))
    return conversations(spark, d).select("conv_id", *(prompt(s).alias(s) for s in ("single", "two", "mpt", "plain")))


@query("agg29_token_estimate", f"""WITH c AS ({CHAT}) SELECT conv_id, CAST(list_sum(list_transform(m, lambda x: len(string_split_regex(trim(x.message), '\\s+')))) AS INT) AS n FROM c""")
def agg29_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """AGG29: words of all turns of a conversation."""
    turns = F.transform("m", lambda t: F.struct(t["role"].alias("from"), t["message"].alias("value")))
    return conversations(spark, d).select("conv_id", A.token_estimate(turns).alias("n"))


@query("lim9_best_resolution", """WITH o AS (SELECT * FROM (VALUES (0, 336, 672), (1, 672, 336), (2, 672, 672), (3, 1008, 336)) t(k, ow, oh)), c AS (
 SELECT p_partkey, k, ow, oh, least(CAST(floor((100 + p_size * 20) * least(ow / (100 + p_size * 20), oh / (100 + (p_partkey % 40) * 20))) AS BIGINT) * CAST(floor((100 + (p_partkey % 40) * 20) * least(ow / (100 + p_size * 20), oh / (100 + (p_partkey % 40) * 20))) AS BIGINT),
   CAST((100 + p_size * 20) * (100 + (p_partkey % 40) * 20) AS BIGINT)) AS shown FROM part, o), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY shown DESC, ow * oh - shown, k) AS rn FROM c)
SELECT p_partkey, CAST(ow AS INT) AS width, CAST(oh AS INT) AS height FROM r WHERE rn = 1""")
def lim9_best_resolution(spark: SparkSession, d: str) -> DataFrame:
    """LIM9, MTH10: the resolution that shows most of an image and wastes least."""
    w, h = 100 + F.col("p_size") * 20, (100 + (F.col("p_partkey") % 40) * 20)
    best = B.best_resolution(w, h, [(336, 672), (672, 336), (672, 672), (1008, 336)])
    return part(spark, d).select("p_partkey", best.alias("b")).select("p_partkey", "b.width", "b.height")


@query("mth11_resize_pad", """WITH s AS (SELECT p_partkey, 100 + p_size * 20 AS w, 100 + (p_partkey % 40) * 20 AS h FROM part), n AS (SELECT *, CASE WHEN 336 / w < 672 / h THEN 336 ELSE least(ceil(w * (672 / h)), 336) END AS nw, CASE WHEN 336 / w < 672 / h THEN least(ceil(h * (336 / w)), 672) ELSE 672 END AS nh FROM s)
SELECT p_partkey, CAST(nw AS BIGINT) AS width, CAST(nh AS BIGINT) AS height, CAST(floor((336 - nw) / 2) AS BIGINT) AS x, CAST(floor((672 - nh) / 2) AS BIGINT) AS y, CAST(greatest(w, h) AS BIGINT) AS side FROM n""")
def mth11_resize_pad(spark: SparkSession, d: str) -> DataFrame:
    """MTH11, HLP8-9: size and offset of an image in a target, and its square."""
    w, h = 100 + F.col("p_size") * 20, 100 + (F.col("p_partkey") % 40) * 20
    out = part(spark, d).select("p_partkey", B.resize_and_pad(w, h, F.lit(336), F.lit(672)).alias("r"), B.square_padding(w.cast("long"), h.cast("long"))["side"].alias("side"))
    return out.select("p_partkey", "r.*", "side")


IDS = "[CAST(p_size AS INT), CAST(p_partkey % 10 AS INT), 7, CAST(p_size % 5 AS INT), 7, CAST(p_partkey % 3 AS INT)]"


def ids() -> Column:
    return F.array((F.col("p_size")).cast("int"), (F.col("p_partkey") % 10).cast("int"), F.lit(7), (F.col("p_size") % 5).cast("int"), F.lit(7), (F.col("p_partkey") % 3).cast("int"))


@query("win10_12_token_spans", f"""WITH a AS (SELECT p_partkey, {IDS} AS a FROM part), c AS (SELECT *, [7, a[4]] AS c FROM a), f AS (
 SELECT *, coalesce(list_filter(range(1, 6), lambda i: a[i:i+1] = c)[1], 0) AS place FROM c)
SELECT p_partkey, CAST(place AS INT) AS place, array_to_string(list_transform(a, lambda x, i: CASE WHEN place > 0 AND i <= place + 1 THEN -100 ELSE x END), ' ') AS labels,
 array_to_string(a[1:len(a) - list_position(list_reverse(a), 7) + 1], ' ') AS cut FROM f""")
def win10_12_token_spans(spark: SparkSession, d: str) -> DataFrame:
    """WIN10-12, CDPO1: a context's place in tokens, labels after it, the cut after the last period."""
    rows = part(spark, d).select("p_partkey", ids().alias("a")).withColumn("c", F.array(F.lit(7), F.get("a", F.lit(3))))
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), " ")
    return rows.select("p_partkey", A.find(F.col("a"), F.col("c")).alias("place"), text(A.ignore_through(F.col("a"), F.col("a"), F.col("c"))).alias("labels"), text(A.cut_after_last(F.col("a"), 7)).alias("cut"))


@query("arr4_5_padding", f"""WITH a AS (SELECT p_partkey, {IDS}[1:CAST(1 + p_size % 6 AS BIGINT)] AS a FROM part)
SELECT p_partkey, array_to_string(list_concat(a, list_transform(range(0, 8 - len(a)), lambda i: 0)), ' ') AS padded, CAST(len(list_filter(a, lambda x: x <> 0)) AS INT) AS attended FROM a""")
def arr4_5_padding(spark: SparkSession, d: str) -> DataFrame:
    """ARR4-6, HLP10: sequences padded to a width, and what is attended to."""
    rows = part(spark, d).select("p_partkey", F.slice(ids(), F.lit(1), (1 + F.col("p_size") % 6).cast("int")).alias("a"))
    wide = A.padded(F.col("a"), 0, F.lit(8))
    return rows.select("p_partkey", F.array_join(F.transform(wide, lambda v: v.cast("string")), " ").alias("padded"), F.size(F.filter(A.attention(wide, 0), lambda x: x)).alias("attended"))


@query("prj22_arr8_lists", """SELECT p_partkey, p_brand || '|' || p_brand || '|' || p_type || '|' || p_type AS repeated, p_brand || '/' || p_type AS parts, '1 2 -200 3 4' AS joined FROM part""")
def prj22_arr8_lists(spark: SparkSession, d: str) -> DataFrame:
    """PRJ20-22, ARR8: lists repeated, split evenly with the rest dropped, joined by a separator."""
    split = A.split_even(F.array("p_brand", "p_type", "p_name"), 2)
    chunks = A.joined_by(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))), -200)
    return part(spark, d).select("p_partkey", F.array_join(A.repeat_each(F.array("p_brand", "p_type"), 2), "|").alias("repeated"), F.array_join(F.flatten(split), "/").alias("parts"), F.array_join(F.transform(chunks, lambda v: v.cast("string")), " ").alias("joined"))


@query("win9_noun_phrases", "SELECT p_partkey, p_brand || ' ' || p_type || '|' || p_name AS phrases FROM part")
def win9_noun_phrases(spark: SparkSession, d: str) -> DataFrame:
    """WIN9: runs of nouns joined to phrases."""
    token = lambda c, noun: F.struct(c.alias("word"), F.lit(noun).alias("noun"))
    tokens = F.array(token(F.col("p_brand"), True), token(F.col("p_type"), True), token(F.lit("is"), False), token(F.col("p_name"), True))
    return part(spark, d).select("p_partkey", F.array_join(A.noun_phrases(tokens), "|").alias("phrases"))


@query("mth12_jn21_similarity", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT a.vec_id, a.label, min(b.vec_id) AS match FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) > 0.3 GROUP BY a.vec_id, a.label""")
def mth12_jn21_similarity(spark: SparkSession, d: str) -> DataFrame:
    """MTH12, JN21: the first other vector of the same label with a cosine above 0.3, whole vectors."""
    rows = table(spark, d, "embeddings")
    return similarity.similar_first(rows, rows, ["label"], "embedding", 0.3, "vec_id")


# A tagger by rule: long words are nouns, short ones stand before them; a noun's lemma is its first six letters.
@query("txt15_17_tagged_nouns", f"""WITH s AS (SELECT doc_id, unnest({SENTENCES}) AS sentence FROM documents), d AS (SELECT DISTINCT sentence FROM s), w AS (
  SELECT sentence, unnest(regexp_extract_all(lower(sentence), '[a-z]+')) AS word, unnest(range(len(regexp_extract_all(lower(sentence), '[a-z]+')))) AS i FROM d
), n AS (
  SELECT *, i - row_number() OVER (PARTITION BY sentence ORDER BY i) AS island FROM w WHERE length(word) > 6
), p AS (
  SELECT sentence, count(*) AS words, min(left(word, 6)) AS lemma FROM n GROUP BY sentence, island
), q AS (
  SELECT sentence, count(*) AS phrases, sum(words) AS nouns, max(words) AS longest, min(lemma) AS lemma FROM p GROUP BY sentence
)
SELECT doc_id, CAST(sum(phrases) AS BIGINT) AS phrases, CAST(sum(nouns) AS BIGINT) AS nouns, CAST(max(longest) AS INT) AS longest, min(lemma) AS lemma FROM s JOIN q USING (sentence) GROUP BY doc_id""")
def txt15_17_tagged_nouns(spark: SparkSession, d: str) -> DataFrame:
    """TXT17, PRV6, PRV9, WIN9: nouns and phrases of all sentences of all documents, by a tagger."""

    def tag(asked: list[dict]) -> list[dict]:
        import re

        words = lambda s: re.findall("[a-z]+", s.lower())
        return [{"sentence": r["sentence"], "tokens": [{"text": w, "pos": "NOUN" if len(w) > 6 else "ADJ", "lemma": w[:6]} for w in words(r["sentence"])]} for r in asked]

    said = docs(spark, d).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("sentence"))

    def measured(told: DataFrame) -> DataFrame:
        rows = told.select("sentence", nouns.phrases().alias("p"), nouns.lemmas().alias("l"))
        words = F.transform("p", lambda p: p["words"])
        total = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + w)
        return rows.select("sentence", F.size("p").alias("phrases"), total.alias("nouns"), F.array_max(words).alias("longest"), F.array_min(F.transform("l", lambda x: x["lemma"])).alias("lemma"))

    tagged = nouns.tokens(said, providers.batched(tag, providers.CONTRACTS["tagger"].answers), measured)
    per = said.join(tagged.filter("phrases > 0"), "sentence").groupBy("doc_id")
    return per.agg(F.sum("phrases").alias("phrases"), F.sum("nouns").alias("nouns"), F.max("longest").cast("int").alias("longest"), F.min("lemma").alias("lemma"))
