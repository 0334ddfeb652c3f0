"""Sources, joins, set operations, samples and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, relational, samplers
from ..sources import readers, writers
from ..streaming.state import sessions, windowed_counts
from .bindings import query, table


@query("src15_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src15_json_fields(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, SRC12, ARR10: records in JSON text."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("src12_keyed_rows", "SELECT p_partkey, p_brand AS key, CAST(p_size AS BIGINT) AS size FROM part")
def src12_keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC12: rows of small documents that map ids to records."""
    doc = F.to_json(F.create_map("p_brand", F.struct(F.col("p_size").alias("size"))))
    rows = table(spark, d, "part").select("p_partkey", F.explode(readers.keyed_rows(doc, "struct<size:bigint>")).alias("e"))
    return rows.select("p_partkey", F.col("e.key").alias("key"), F.col("e.value.size").alias("size"))


@query("src15_metric_lines", "SELECT p_partkey, p_brand AS name, p_retailprice AS value FROM part")
def src15_metric_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC15: "name = number" lines."""
    line = F.concat("p_brand", F.lit(" = "), F.col("p_retailprice").cast("string"))
    return table(spark, d, "part").select("p_partkey", readers.metric_line(line).alias("m")).select("p_partkey", "m.name", "m.value")


@query("src21_prj16_paths", "SELECT page_id, string_split(url, '/')[-2] || '/' || string_split(url, '/')[-1] AS path FROM pages")
def src21_prj16_paths(spark: SparkSession, d: str) -> DataFrame:
    """SRC21, PRJ16: the last parts of URLs as paths."""
    return table(spark, d, "pages").select("page_id", readers.path_from_url(F.col("url")).alias("path"))


@query("prj1_2_data_points", "SELECT CAST(c_custkey AS VARCHAR) AS image_id, c_name AS image_path, 'Describe this image.' AS question, c_mktsegment AS segment, CAST(3 AS INT) AS attributes FROM customer")
def prj1_2_data_points(spark: SparkSession, d: str) -> DataFrame:
    """PRJ1-2, PRJ19: typed rows from loose names, all other columns as attributes."""
    loose = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("image"), "c_mktsegment", "c_acctbal")
    out = readers.data_points(loose)
    return out.select("image_id", "image_path", "question", F.col("attributes")["c_mktsegment"].alias("segment"), F.size("attributes").alias("attributes"))


@query("prj3_4_convert", """SELECT CAST(c_custkey AS VARCHAR) AS image_id, '/img/' || c_name AS image_path, ['What?', 'Where?', 'Who?', 'Why?'][CAST('0x' || substr(md5('q|' || c_custkey), 1, 8) AS BIGINT) % 4 + 1] AS question, c_mktsegment AS ground_truth FROM customer""")
def prj3_4_convert(spark: SparkSession, d: str) -> DataFrame:
    """PRJ3-4: raw preference rows as image rows with a drawn question."""
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("image"), F.col("c_mktsegment").alias("chosen"))
    return align.converted(raw, ["What?", "Where?", "Who?", "Why?"], "/img/")


@query("prj5_rename_keys", "SELECT p_brand AS image, arg_max(p_name, p_partkey) AS masked FROM part GROUP BY p_brand")
def prj5_rename_keys(spark: SparkSession, d: str) -> DataFrame:
    """PRJ5: keys and a field as base names, the last of equal names stays."""
    rows = table(spark, d, "part").select(F.concat(F.lit("/a/"), "p_brand").alias("image"), F.concat(F.lit("b/c/"), "p_name").alias("masked"), "p_partkey")
    return relational.rename_keys(rows, "image", "masked", "p_partkey").select("image", "masked")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("image_id"), F.concat(F.lit("/img/"), "p_brand").alias("image_path"), F.col("p_type").alias("question"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, "").alias("context"), F.col("p_name").alias("y_win"), F.col("p_type").alias("y_lose"))


@query("prj6_trainer_rows", "SELECT '<image>' || p_type AS instruction, CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END AS context, p_name AS chosen, p_type AS rejected, '/img/' || p_brand AS image FROM part")
def prj6_trainer_rows(spark: SparkSession, d: str) -> DataFrame:
    """PRJ6: rows of a trainer."""
    out = align.trainer_rows(_pairs(spark, d))
    return out.select("instruction", "context", "chosen", "rejected", F.get("images", F.lit(0)).alias("image"))


@query("prj8_10_chat_rows", "SELECT p_brand AS id, '<image>' || chr(10) || p_type AS asked, CASE WHEN p_size % 3 = 0 THEN p_name || ' ' ELSE '' END || p_name AS chosen, CASE WHEN p_size % 3 = 0 THEN p_name || ' ' ELSE '' END || p_type AS rejected FROM part")
def prj8_10_chat_rows(spark: SparkSession, d: str) -> DataFrame:
    """PRJ8-10: chat rows with the context before both answers."""
    out = align.chat_rows(_pairs(spark, d))
    return out.select("id", F.get("chosen", F.lit(0))["value"].alias("asked"), F.get("chosen", F.lit(1))["value"].alias("chosen"), F.get("rejected", F.lit(1))["value"].alias("rejected"))


@query("prj11_alpaca", """SELECT p_partkey AS id, CAST(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END AS INT) AS turns, p_name || chr(10) || p_type AS asked, CAST(CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS INT) AS answers, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'good' WHEN 2 THEN p_brand END AS first FROM part""")
def prj11_alpaca(spark: SparkSession, d: str) -> DataFrame:
    """PRJ11, PRJ13-14: rows of instruction data aligned, with each kind of response."""
    k = F.col("p_size") % 4
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"), F.col("p_type").alias("query"), F.when(k.isin(0, 2), F.col("p_brand")).alias("response"),
        F.when(k == 0, F.lit(True)).alias("kto_tag"), F.when(k == 1, "good").alias("chosen"), F.when(k == 1, "bad").alias("rejected"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("hi").alias("prompt"), F.lit("ho").alias("response")))).alias("history"),
    )
    out = align.align(rows, "alpaca")
    return out.select("id", F.size("_prompt").alias("turns"), F.element_at("_prompt", -1)["content"].alias("asked"), F.size("_response").alias("answers"), F.get("_response", F.lit(0))["content"].alias("first"))


@query("prj12_sharegpt", """WITH c AS (SELECT conv_id, list({'f': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, 'v': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id), s AS (
 SELECT conv_id, CASE WHEN m[1].f = 'system' THEN m[1].v ELSE '' END AS system, CASE WHEN m[1].f = 'system' THEN m[2:] ELSE m END AS m FROM c), k AS (
 SELECT *, len(m) % 2 = 0 AND len(list_filter(list_transform(m, lambda x, i: CASE WHEN i % 2 = 1 THEN x.f = 'human' ELSE x.f = 'gpt' END), lambda b: NOT b)) = 0 AS ok FROM s)
SELECT conv_id, md5(system) AS system, CAST(CASE WHEN ok THEN greatest(len(m) - 1, 0) ELSE 0 END AS INT) AS turns, CAST(CASE WHEN ok THEN least(len(m), 1) ELSE 0 END AS INT) AS answers FROM k""")
def prj12_sharegpt(spark: SparkSession, d: str) -> DataFrame:
    """PRJ12, HLP14: conversations checked for alternation and parity and split into prompt and response."""
    said = F.struct(F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")).alias("from"), F.col("text").alias("value"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text", said.alias("m"))))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(rows, lambda r: r["m"]).alias("conversations"))
    return align.align(talks, "sharegpt").select("conv_id", F.md5("_system").alias("system"), F.size("_prompt").alias("turns"), F.size("_response").alias("answers"))


@query("cdpo1_2_encoding", """WITH e AS (SELECT p_partkey, [1, CAST(p_size AS INT)] AS p, [5, CAST(p_partkey % 10 + 10 AS INT), 3, 4] AS c, [5, 6, 7] AS r, CASE WHEN p_size % 2 = 0 THEN [5] ELSE [] END AS x FROM part), k AS (
 SELECT *, CASE WHEN len(x) > 0 THEN c[1:3] ELSE c END AS cc FROM e)
SELECT p_partkey, array_to_string(list_concat(p, cc), ' ') AS chosen_ids, array_to_string(list_concat([-100, -100], CASE WHEN len(x) > 0 THEN (CASE WHEN p[2] = 5 THEN cc ELSE list_concat([-100], cc[2:]) END) ELSE cc END), ' ') AS chosen_labels FROM k""")
def cdpo1_2_encoding(spark: SparkSession, d: str) -> DataFrame:
    """CDPO1-2: ids and labels with a context, cut after the last period."""
    i = lambda c: c.cast("int")
    ids = lambda *x: F.array(*[F.lit(v) if isinstance(v, int) else v for v in x])
    context = F.when(F.col("p_size") % 2 == 0, ids(5)).otherwise(F.array().cast("array<int>"))
    rows = table(spark, d, "part").select("p_partkey", ids(1, i(F.col("p_size"))).alias("prompt"), ids(5, i(F.col("p_partkey") % 10 + 10), 3, 4).alias("chosen"), ids(5, 6, 7).alias("rejected"), context.alias("context"))
    out = align.encode_pairs(rows, 3)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return out.select("p_partkey", text("chosen_ids"), text("chosen_labels"))


@query("agg1_2_grouped_pairs", "WITH p AS (SELECT * FROM part ORDER BY p_partkey LIMIT 500) SELECT p_brand AS image_id, string_agg(DISTINCT split_part(p_name, ' ', 2), '.' ORDER BY split_part(p_name, ' ', 2)) AS objects, CAST(count(*) AS INT) AS n FROM p GROUP BY p_brand")
def agg1_2_grouped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """AGG1-2, LIM1-2, SNK4-5, ARR3: pairs of an image with the union of their objects, after the limit of 500 pairs."""
    pairs = _pairs(spark, d).withColumn("objs", F.array(F.element_at(F.split("y_win", " "), 2)))
    out = align.grouped_pairs(pairs, "image_id", "objs", limit=500)
    return out.select("image_id", F.array_join("objects", ".").alias("objects"), F.size("pairs").alias("n"))


@query("agg1_2_all_pairs", "SELECT p_brand AS image_id, string_agg(DISTINCT split_part(p_name, ' ', 2), '.' ORDER BY split_part(p_name, ' ', 2)) AS objects, CAST(count(*) AS INT) AS n FROM part GROUP BY p_brand")
def agg1_2_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """AGG1-2: all pairs of an image with the union of their objects."""
    pairs = _pairs(spark, d).withColumn("objs", F.array(F.element_at(F.split("y_win", " "), 2)))
    out = align.grouped_pairs(pairs, "image_id", "objs")
    return out.select("image_id", F.array_join("objects", ".").alias("objects"), F.size("pairs").alias("n"))


@query("snk4_map_lines", "SELECT n_regionkey AS k, CAST(count(*) AS INT) AS n FROM nation GROUP BY 1")
def snk4_map_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK4, SNK6: grouped rows as JSON maps, read back."""
    docs = writers.map_lines(table(spark, d, "nation"), "n_regionkey", ["n_nationkey"])
    back = docs.select(F.explode(F.from_json("value", "map<string,array<struct<n_name:string>>>")).alias("k", "v"))
    return back.select(F.col("k").cast("int").alias("k"), F.size("v").alias("n"))


@query("snk11_masked_names", "SELECT p_partkey, p_brand || '_masked_' || p_name || '.jpg' AS name FROM part")
def snk11_masked_names(spark: SparkSession, d: str) -> DataFrame:
    """SNK11: names of masked images."""
    return table(spark, d, "part").select("p_partkey", writers.masked_name(F.concat(F.lit("/a/b/"), "p_brand", F.lit(".jpg")), F.col("p_name")).alias("name"))


@query("jn1_2_resume", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn1_2_resume(spark: SparkSession, d: str) -> DataFrame:
    """JN1-2, STR4-5: what is not done yet."""
    return relational.resume(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("jn11_12_left_default", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jn11_12_left_default(spark: SparkSession, d: str) -> DataFrame:
    """JN11-12: a left join with defaults."""
    return relational.left_default(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"], {"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic")


@query("jn13_checked_lookup", "SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS found, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn13_checked_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN10, JN13: a lookup and what it misses."""
    found, missing = relational.checked_lookup(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])
    n = lambda df, c, z: df.agg(F.count("*").alias(c)).withColumn(z, F.lit(0).cast("long"))
    both = n(found, "found", "missing").unionByName(n(missing, "missing", "found"))
    return both.agg(F.sum("found").alias("found"), F.sum("missing").alias("missing"))


@query("jn14_first_match", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def jn14_first_match(spark: SparkSession, d: str) -> DataFrame:
    """JN14: the first partner only."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return relational.first_match(table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderkey"]).select("c_custkey", "o_orderkey")


@query("flt1_prompt_counts", "SELECT p AS prompt, count(p_partkey) AS n FROM (VALUES ('PROMO'), ('SMALL'), ('NONE')) t(p) LEFT JOIN part ON p_type = p GROUP BY p")
def flt1_prompt_counts(spark: SparkSession, d: str) -> DataFrame:
    """FLT1: rows for each prompt of a list, zero included."""
    prompts = spark.createDataFrame([("PROMO",), ("SMALL",), ("NONE",)], "prompt string")
    return relational.prompt_counts(table(spark, d, "part").withColumnRenamed("p_type", "prompt"), prompts)


@query("set1_4_sets", "SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier)")
def set1_4_sets(spark: SparkSession, d: str) -> DataFrame:
    """SET1, SET4, SET6: union and distinct."""
    a, b = table(spark, d, "customer").select(F.col("c_name").alias("name")), table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return relational.dedupe_requests(a.unionByName(b), ["name"])


@query("lim3_sample", "SELECT doc_id FROM documents ORDER BY md5('seed|' || doc_id), doc_id LIMIT 100")
def lim3_sample(spark: SparkSession, d: str) -> DataFrame:
    """LIM3, LIM5: a seeded sample without replacement."""
    return samplers.sample(table(spark, d, "documents"), 100, "seed", "doc_id").select("doc_id")


@query("lim4_pad", """WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS ord FROM supplier), n AS (SELECT count(*) AS n FROM r), x AS (
 SELECT CAST('0x' || substr(md5('seed|' || i), 1, 8) AS BIGINT) % n AS ord FROM n, (SELECT unnest(range(0, (SELECT 1500 - n FROM n))) AS i))
SELECT s_suppkey, count(*) AS n FROM (SELECT s_suppkey FROM r UNION ALL SELECT s_suppkey FROM r JOIN x USING (ord)) GROUP BY s_suppkey""")
def lim4_pad(spark: SparkSession, d: str) -> DataFrame:
    """LIM4: rows padded to a count by seeded draws with replacement."""
    out = samplers.pad_to(table(spark, d, "supplier").select("s_suppkey"), 1500, "seed", "s_suppkey")
    return out.groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("win13_14_length_groups", """WITH h AS (SELECT doc_id, CASE WHEN lang = 'en' THEN n_chars ELSE -n_chars END AS len, md5('seed|' || doc_id) AS h FROM documents), p AS (
 SELECT *, floor((row_number() OVER (PARTITION BY len > 0 ORDER BY h, doc_id) - 1) / 32) AS mega, count(*) OVER (PARTITION BY len > 0) AS n FROM h), m AS (
 SELECT *, CASE WHEN (mega + 1) * 32 > n THEN 'last' ELSE CASE WHEN len > 0 THEN 'a' ELSE 'b' END || CAST(CAST(mega AS BIGINT) AS VARCHAR) END AS megabatch FROM p)
SELECT doc_id, megabatch, CAST(row_number() OVER (PARTITION BY megabatch ORDER BY abs(len) DESC, doc_id) - 1 AS INT) AS rank FROM m""")
def win13_14_length_groups(spark: SparkSession, d: str) -> DataFrame:
    """WIN13-14, LIM8: batches of similar length, modalities apart."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(-F.col("n_chars")).alias("len"))
    return samplers.length_groups(rows, "len", 8, 4, "seed", "doc_id").select("doc_id", "megabatch", "rank")


@query("win13_balanced")
def win13_balanced(spark: SparkSession, d: str) -> DataFrame:
    """WIN13: items of a megabatch dealt to workers by load."""
    rows = samplers.length_groups(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("len")), "len", 8, 4, "seed", "doc_id")
    lists = rows.groupBy("megabatch").agg(F.array_sort(F.collect_list(F.struct("rank", "len"))).alias("items"))
    return lists.select("megabatch", F.array_join(F.transform(samplers.balanced(F.transform("items", lambda x: x["len"]), 4), lambda v: v.cast("string")), " ").alias("workers"))


@query("str7_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str7_windows(spark: SparkSession, d: str) -> DataFrame:
    """STR7: event counts per hour; not part of the reference, shown on a table, the same on a stream."""
    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str7_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def str7_sessions(spark: SparkSession, d: str) -> DataFrame:
    """STR7: sessions of users."""
    return sessions(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
