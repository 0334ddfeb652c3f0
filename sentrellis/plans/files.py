"""Benchmark files, sources and sinks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import align, encoding, metrics, providers, samplers, submission
from ..sources import documents, readers, writers
from .bindings import query, scratch, table
from .scores import HALL, _amber, _hall


@query("prj15_question_rows", "SELECT CASE WHEN p_size % 3 = 0 THEN '' ELSE 'img/' || p_brand END AS image, p_type AS question, CASE WHEN p_size % 3 = 0 THEN '' ELSE './img/' || p_brand END AS filename, p_partkey AS id FROM part")
def prj15_question_rows(spark: SparkSession, d: str) -> DataFrame:
    """PRJ15: question rows with the image's path first."""
    name = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("./img/"), "p_brand"))
    return submission.question_rows(table(spark, d, "part").select(name.alias("filename"), F.col("p_type").alias("question"), F.col("p_partkey").alias("id")))


@query("prj17_submission", "SELECT 'v1_' || CASE WHEN doc_id % 3 = 0 THEN 'i' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS key, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS value FROM documents")
def prj17_submission(spark: SparkSession, d: str) -> DataFrame:
    """PRJ17: answers by question, or by image where there is no question."""
    rows = table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("question_id"), F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("image_id"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("text"), F.col("source").alias("caption"),
    )
    return submission.submission_entries(rows)


@query("prj18_caption_rows", "SELECT doc_id AS image_id, md5(text) AS caption FROM documents")
def prj18_caption_rows(spark: SparkSession, d: str) -> DataFrame:
    """PRJ18: answers as captions."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("question_id"), "text")
    return submission.caption_rows(rows).select("image_id", F.md5("caption").alias("caption"))


@query("flt2_category_split", f"WITH {HALL} SELECT category, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct FROM h GROUP BY category")
def flt2_category_split(spark: SparkSession, d: str) -> DataFrame:
    """FLT2: the parts of a benchmark, which must be all of it."""
    parts = submission.split_complete(_hall(spark, d), "category", ["VD", "VS"])
    count = lambda df: df.groupBy("category").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
    return count(parts[0]).unionByName(count(parts[1]))


@query("flt17_selected_scores", """WITH a AS (SELECT ['attribute-state', 'attribute-number', 'attribute-action', 'hallucination', 'relation'][p_partkey % 5 + 1] AS type FROM part), l AS (
 SELECT unnest(list_distinct(['overall', CASE WHEN type LIKE 'attr%' THEN 'attribute' WHEN type = 'hallucination' THEN 'existence' ELSE type END, type])) AS level FROM a)
SELECT k.kind, level, count(*) AS n FROM l JOIN (VALUES ('a'), ('g'), ('d'), ('de'), ('da'), ('dr')) k(kind) ON
 (kind IN ('a', 'd') AND level <> 'hallucination') OR (kind = 'de' AND level = 'existence') OR (kind = 'da' AND level LIKE 'attr%') OR (kind = 'dr' AND level = 'relation') GROUP BY ALL""")
def flt17_selected_scores(spark: SparkSession, d: str) -> DataFrame:
    """FLT17: the scores that each evaluation type asks for."""
    scores = metrics.amber_discriminative(_amber(spark, d))
    kinds = [submission.selected_scores(scores, k).select(F.lit(k).alias("kind"), "level", "n") for k in submission.EVALUATION_PARTS]
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    return out


BLEU_WORDS = "string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS p, [string_split(p_name || ' x ' || p_type, ' '), string_split(p_type || ' ' || p_name || ' of ' || p_name, ' ')] AS refs"


@query("agg24_bleu", f"""WITH r AS (SELECT p_partkey AS id, {BLEU_WORDS} FROM part), k AS (SELECT unnest([1, 2, 3, 4]) AS k), g AS (
 SELECT id, k, unnest(list_transform(range(1, len(p) - k + 2), lambda i: array_to_string(p[i:i + k - 1], ' '))) AS g FROM r, k), c AS (SELECT id, k, g, count(*) AS n FROM g GROUP BY ALL), t AS (
 SELECT id, unnest(refs) AS t, generate_subscripts(refs, 1) AS j FROM r), rg AS (SELECT id, k, j, unnest(list_transform(range(1, len(t) - k + 2), lambda i: array_to_string(t[i:i + k - 1], ' '))) AS g FROM t, k), rc AS (
 SELECT id, k, g, max(n) AS m FROM (SELECT id, k, j, g, count(*) AS n FROM rg GROUP BY ALL) GROUP BY ALL), s AS (
 SELECT k, sum(least(n, coalesce(m, 0))) AS good, sum(n) AS total FROM c LEFT JOIN rc USING (id, k, g) GROUP BY k), z AS (
 SELECT sum(len(p)) AS length, sum(near) AS closest FROM r JOIN (SELECT t.id, arg_min(len(t), abs(len(t) - len(p)) * 1000 + len(t)) AS near FROM t JOIN r USING (id) GROUP BY t.id) USING (id))
SELECT round(exp(sum(ln((good + 1e-15) / (total + 1e-9))) / 4) * any_value(CASE WHEN length < closest THEN exp(1 - closest / length) ELSE 1 END), 6) AS bleu4 FROM s, z""")
def agg24_bleu(spark: SparkSession, d: str) -> DataFrame:
    """AGG24: BLEU-4 of captions against several references."""
    words = lambda *parts: F.split(F.concat_ws(" ", *parts), " ")
    rows = table(spark, d, "part").select(words("p_name", "p_type", "p_name").alias("predicted"), F.array(words("p_name", F.lit("x"), "p_type"), words("p_type", "p_name", F.lit("of"), "p_name")).alias("truths"))
    return submission.bleu(rows).select(F.round("bleu4", 6).alias("bleu4"))


@query("snk10_rendered_table", """WITH t AS (SELECT r_regionkey AS k, r_name AS name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL), w AS (SELECT CAST(greatest(max(length(name)), 4) AS INT) AS w FROM t), p AS (
 SELECT 0 AS place, '| ' || rpad('name', w, ' ') || ' | nations |' AS line FROM w UNION ALL SELECT 1, '|' || repeat('-', w + 2) || '|---------|' FROM w
 UNION ALL SELECT 2, '| ' || rpad(name, w, ' ') || ' | ' || rpad(CAST(nations AS VARCHAR), 7, ' ') || ' |' FROM t, w)
SELECT CAST(place AS INT) AS place, line FROM p""")
def snk10_rendered_table(spark: SparkSession, d: str) -> DataFrame:
    """SNK10: a small result as a text table."""
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("name")).agg(F.count("*").alias("nations"))
    return submission.rendered(rows, ["name"])


@query("hlp13_metric_line", "SELECT l_returnflag AS flag, printf('%.1f', avg(l_discount) * 100) || chr(9) || count(*) || chr(9) || printf('%.1f', avg(l_quantity)) AS line FROM lineitem GROUP BY 1")
def hlp13_metric_line(spark: SparkSession, d: str) -> DataFrame:
    """HLP13: metrics as one tab-separated line."""
    per = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_discount").alias("a"), F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    return per.select("flag", submission.metric_line([F.col("a")], [F.col("n")], F.col("q")).alias("line"))


@query("hlp15_caption_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents")
def hlp15_caption_index(spark: SparkSession, d: str) -> DataFrame:
    """HLP15: each caption's place in its file."""
    return samplers.ordinal(table(spark, d, "documents").select("doc_id"), "index", "doc_id")


@query("set3_arr1_2_lists", """SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, p_brand])), '.') AS united, array_to_string(list_concat([p_brand], [p_type]), '.') AS extended,
 list_contains([p_brand, p_type], 'PROMO') AS held, CAST(coalesce(list_position([p_brand, p_type], p_type), 0) AS BIGINT) AS place, array_to_string(list_filter([p_brand, p_type, p_name], lambda x: NOT list_contains([p_type], x)), '.') AS rest FROM part""")
def set3_arr1_2_lists(spark: SparkSession, d: str) -> DataFrame:
    """SET3, ARR1-2: sets united, lists extended, held, found and filtered by another."""
    a, b = F.array("p_brand", "p_type"), F.array("p_brand")
    rest = F.filter(F.array("p_brand", "p_type", "p_name"), lambda x: ~F.array_contains(F.array("p_type"), x))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(F.array_sort(F.array_union(a, b)), ".").alias("united"), F.array_join(F.concat(b, F.array("p_type")), ".").alias("extended"),
        F.array_contains(a, "PROMO").alias("held"), F.array_position(a, F.col("p_type")).alias("place"), F.array_join(rest, ".").alias("rest"),
    )


@query("src2_8_snk1_3_lines", "SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
def src2_8_snk1_3_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC2-5, SRC8, SNK1-2: JSON lines appended part by part, and several files read as one table."""
    rows, folder = table(spark, d, "part").select("p_partkey", "p_name", "p_size"), scratch(spark)
    writers.append_rows(rows.filter("p_partkey % 2 = 0"), f"{folder}/a.jsonl")
    writers.append_rows(rows.filter("p_partkey % 2 = 1"), f"{folder}/a.jsonl")
    writers.write_new(rows.filter("p_size > 10"), f"{folder}/b.jsonl")
    return readers.read_json(spark, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"], rows.schema)


@query("src6_tolerant_lines", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size % 5 <> 0")
def src6_tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC6: good lines of a file with bad ones in it; those after a bad one are kept."""
    good = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    line = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("{"), "p_name")).otherwise(good)
    path = f"{scratch(spark)}/lines"
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    return readers.read_lines(spark, path, "id bigint, name string")[0]


@query("src9_11_tree", "SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1")
def src9_11_tree(spark: SparkSession, d: str) -> DataFrame:
    """SRC9-11: files below a folder by name, their category from the path."""
    folder = scratch(spark)
    table(spark, d, "part").select("p_partkey", "p_brand", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("b")).write.partitionBy("b").json(folder)
    rows = readers.read_tree(spark, folder, "*.json", "b=", "p_partkey bigint, p_brand string")
    named = rows.select("p_brand", readers.file_category(F.col("file"), "/b=([^/]*)/").alias("c"))
    return named.filter(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_") == F.col("c")).groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n"))


@query("snk8_hlp16_results", f"WITH {HALL} SELECT 'overall' AS file, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct FROM h UNION ALL SELECT 'sentences', count(*), CAST(sum(correct) AS BIGINT) FROM h")
def snk8_hlp16_results(spark: SparkSession, d: str) -> DataFrame:
    """SNK8, HLP16: an evaluation's rows and its overall metrics as files, read back."""
    rows = _hall(spark, d).select("category", "set_id", "correct")
    overall = rows.agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
    a, b = submission.result_documents(rows, overall, scratch(spark), "model")
    sentences = readers.read_json(spark, a, rows.schema).agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
    both = sentences.select(F.lit("sentences").alias("file"), "n", "correct")
    return both.unionByName(readers.read_json(spark, b, "n bigint, correct bigint").select(F.lit("overall").alias("file"), "n", "correct"))


@query("snk5_array_document", "SELECT n_nationkey, n_name FROM nation")
def snk5_array_document(spark: SparkSession, d: str) -> DataFrame:
    """SNK5, SNK7: a small result as one JSON array, and its rows again."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    path = f"{scratch(spark)}/document"
    writers.array_document(rows, ["n_nationkey"]).write.text(path)
    rows = F.from_json("value", "array<struct<n_nationkey:bigint,n_name:string>>")
    return spark.read.text(path, wholetext=True).select(F.explode(rows).alias("r")).select("r.*")


@query("hlp7_11_generated", "SELECT p_partkey, split_part(p_name, ' ', 1) || '.' AS sentence, CAST(p_size % 4 + 1 AS INT) AS length FROM part")
def hlp7_11_generated(spark: SparkSession, d: str) -> DataFrame:
    """HLP5, ARR4-6: the first generated sentence, and generated tokens before the padding."""
    said = F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(". Another one."))
    ids = F.concat(F.array_repeat(F.lit(7), (F.col("p_size") % 4 + 1).cast("int")), F.array(F.lit(0), F.lit(0)))
    return table(spark, d, "part").select("p_partkey", X.first_sentence(said).alias("sentence"), A.generated_length(ids, 0).cast("int").alias("length"))


@query("src7_prefix_lines", """WITH b AS (SELECT p_brand, min(p_partkey) AS bad FROM part WHERE p_size % 25 = 0 GROUP BY p_brand)
SELECT p_partkey AS id, p_brand AS brand FROM part LEFT JOIN b USING (p_brand) WHERE bad IS NULL OR p_partkey < bad""")
def src7_prefix_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC7: of each file the lines before its first bad one; a file for each brand."""
    good = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")))
    line = F.when(F.col("p_size") % 25 == 0, F.concat(F.lit("{"), "p_name")).otherwise(good)
    rows, folder = table(spark, d, "part").withColumn("value", line).withColumn("b", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")), scratch(spark)
    rows.repartition("b").sortWithinPartitions("b", "p_partkey").select("value", "b").write.partitionBy("b").text(folder)
    return documents.read_prefix(spark, f"{folder}/b=*", "id bigint, brand string")[0]


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


@query("src12_13_members", "SELECT p_partkey, p_name, p_size, 'map' AS document FROM part UNION ALL SELECT p_partkey, p_name, p_size, 'array' FROM part")
def src12_13_members(spark: SparkSession, d: str) -> DataFrame:
    """SRC12-13, SNK4-6, SNK13: a map and an array as one file each, written by many tasks, and their members read by many tasks."""
    rows, folder = table(spark, d, "part").select("p_partkey", "p_name", "p_size"), _uri(scratch(spark))
    documents.write_document(rows, f"{folder}/map.json", ["p_partkey"], key="p_partkey")
    documents.write_document(rows, f"{folder}/array.json", ["p_partkey"])
    kept = documents.json_members(spark, f"{folder}/map.json").select("key", F.from_json("value", "p_name string, p_size int").alias("r"))
    kept = kept.select(F.col("key").cast("long").alias("p_partkey"), "r.*", F.lit("map").alias("document"))
    listed = documents.json_members(spark, f"{folder}/array.json").select(F.from_json("value", "p_partkey long, p_name string, p_size int").alias("r"))
    return kept.unionByName(listed.select("r.*", F.lit("array").alias("document")))


@query("cdpo1_2_text_encoding")
def cdpo1_2_text_encoding(spark: SparkSession, d: str) -> DataFrame:
    """CDPO1-2, ARR7, FLT15, HLP11: pairs encoded from the text of conversations, their first sentence as context.

    Tests hold it against a tokenizer library."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    talks = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id").agg(said.alias("t")).filter("size(t) > 2")
    text = lambda i: F.get("t", F.lit(i))["text"]
    prompt, answers = F.array(align.turn("user", text(0))), F.array(align.turn("assistant", text(1)), align.turn("assistant", text(2)))
    rows = talks.select("conv_id", prompt.alias("_prompt"), answers.alias("_response"), F.lit("").alias("_system"), X.first_sentence(text(1)).alias("_context"))
    out = encoding.encode_rows(rows, "/opt/tokenizers/byte_bpe_50k.tiktoken", encoding.Template(end=50256))
    counted = lambda c: F.size(F.filter(c, lambda x: x != -100)).alias(f"{c}_n")
    written = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return out.select("conv_id", written("chosen_ids"), written("rejected_ids"), counted("chosen_labels"), counted("rejected_labels"))


@query("prv7_8_pool", """SELECT DISTINCT p_type AS prompt, CASE WHEN p_type NOT LIKE 'PROMO%' THEN 'The ' || lower(p_type) || '.' END AS answer,
 CASE WHEN p_type LIKE 'PROMO%' THEN 'TimeoutError: no answer' END AS error FROM part""")
def prv7_8_pool(spark: SparkSession, d: str) -> DataFrame:
    """PRV7-8, JN23: distinct requests asked many at a time; some fail whatever is tried, and are told from the others."""
    asked = table(spark, d, "part").select(F.col("p_type").alias("prompt")).distinct()

    def judge(request: dict) -> dict:
        if request["prompt"].startswith("PROMO"):
            raise TimeoutError("no answer")
        return {"prompt": request["prompt"], "answer": f"The {request['prompt'].lower()}."}

    return providers.pooled(judge, "prompt string, answer string", attempts=2, wait=0.01)(asked)
