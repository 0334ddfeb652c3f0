"""Readers of JSON documents, lines, directories, lexicons and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, tolerant: bool = False) -> DataFrame:
    """A ``.json`` document or ``.jsonl`` lines, by the extension in any case; several paths are one table.

    ``tolerant`` keeps the good lines and puts bad ones into ``_corrupt_record`` (with a schema that has it).
    """
    paths = [path] if isinstance(path, str) else list(path)
    ends = {p.lower().rstrip("/").rpartition(".")[2] for p in paths}
    if not ends <= {"json", "jsonfile", "jsonl"}:
        raise ValueError(f"neither .json nor .jsonl: {paths}")
    if "jsonl" in ends and len(ends) > 1:
        return read_json(spark, [p for p in paths if p.lower().endswith("jsonl")], schema, tolerant).unionByName(read_json(spark, [p for p in paths if not p.lower().endswith("jsonl")], schema, tolerant), allowMissingColumns=True)
    reader = spark.read.option("multiLine", ends != {"jsonl"}).option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(paths)


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad lines of a JSONL file; nothing after a bad line is lost."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    checked = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = text.select("value", F.from_json("value", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_corrupt_record"), parsed.filter(bad).select("value")


def read_tree(spark: SparkSession, path: str, glob: str, contains: str = "", schema: T.StructType | str | None = None) -> DataFrame:
    """Files below a directory by name, each row with its file's path."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    rows = (reader.schema(schema) if schema else reader).json(path).withColumn("file", F.input_file_name())
    return rows.filter(F.contains("file", F.lit(contains))) if contains else rows


def file_category(file: Column, pattern: str = r"coco_pope_(.*)\.json") -> Column:
    return F.regexp_extract(file, pattern, 1)


def keyed_rows(document: Column, value_type: str) -> Column:
    """A JSON map of id to record as an array of (key, value)."""
    return F.map_entries(F.from_json(document, f"map<string,{value_type}>"))


def field_rows(df: DataFrame, field: str) -> DataFrame:
    """Rows of a document's array field."""
    return df.select(F.explode(field).alias("r")).select("r.*")


def metric_line(line: Column) -> Column:
    """(name, value) of a line "name = number"; the number is cast, never evaluated."""
    parts = F.split(line, "=", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("value"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.contains("value", F.lit("="))).select(metric_line(F.col("value")).alias("m")).select("m.*")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")


def first_of(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first non-null of those columns that a table has."""
    have = [F.col(n) for n in names if n in df.columns]
    have += [default] if default is not None else []
    return F.coalesce(*have) if have else F.lit(None)


def sample_id(df: DataFrame) -> Column:
    return first_of(df, ["question_id", "id", "image_id"]).cast("string")


def question(df: DataFrame) -> Column:
    return first_of(df, ["text", "query", "question"])


def image_path(df: DataFrame) -> Column:
    path = first_of(df, ["image", "image_path", "image_file", "image_id"]).cast("string")
    return F.when(F.contains(path, F.lit(".")), path).otherwise(F.concat(path, F.lit(".jpg")))


def answer_text(df: DataFrame) -> Column:
    return first_of(df, ["text", "caption", "answer"])


def response_text(df: DataFrame) -> Column:
    return first_of(df, ["response", "caption", "text"])


def data_points(df: DataFrame, default_question: str = "Describe this image.") -> DataFrame:
    """image_id, image_path, question and a map of all other columns, from an image list with loose names."""
    used = ("image_id", "image_path", "question")
    rest = [c for c in df.columns if c not in used]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    attributes = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(first_of(df, ["image_id", "image"]).cast("string").alias("image_id"), first_of(df, ["image_path", "image"]).alias("image_path"), first_of(df, ["question"], F.lit(default_question)).alias("question"), attributes.alias("attributes"))


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and content of image files; pixels stay with a provider."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def encoded_image(content: Column) -> Column:
    return F.base64(content)


def decoded_image(text: Column) -> Column:
    return F.unbase64(text)


def path_from_url(url: Column) -> Column:
    """The last two parts of a URL as a path."""
    parts = F.split(url, "/")
    return F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))


def caption_rows(df: DataFrame) -> DataFrame:
    """image_id and caption of a caption file with loose names; ids lose their file ending, captions a prefix."""
    image = F.regexp_replace(first_of(df, ["image_id", "image", "question_id", "id"]).cast("string"), r"\.jpg$", "")
    return df.select(image.alias("image_id"), F.regexp_replace(first_of(df, ["caption", "text", "answer", "response"]), r"^ASSISTANT: ?", "").alias("caption"))


def read_registered(spark: SparkSession, registry: dict[str, dict], name: str, base: str = "") -> DataFrame:
    """A data set by its entry in a registry: ``file_name``, and ``columns`` from logical to actual names.

    Entries that name a hub or a script are not files and raise.
    """
    entry = registry.get(name)
    if entry is None:
        raise ValueError(f"undefined data set: {name}")
    if "file_name" not in entry:
        raise NotImplementedError(f"{name} is not a file")
    df = read_json(spark, f"{base}/{entry['file_name']}" if base else entry["file_name"])
    return df.withColumnsRenamed({actual: logical for logical, actual in entry.get("columns", {}).items() if actual in df.columns})


def resolved_media(df: DataFrame, column: str, files: DataFrame, folder: str) -> DataFrame:
    """Media paths below a folder where ``files(path)`` has them, as they are elsewhere; a scalar becomes a list."""
    media = F.col(column) if dict(df.dtypes)[column].startswith("array") else F.array(F.col(column))
    keyed = df.withColumn("_row", F.xxhash64(*df.columns))
    parts = keyed.select("_row", F.posexplode(media).alias("pos", "media")).distinct().withColumn("full", F.concat(F.lit(folder.rstrip("/") + "/"), "media"))
    found = parts.join(files.select(F.col("path").alias("full")).distinct().withColumn("_there", F.lit(True)), "full", "left")
    best = found.withColumn("media", F.when(F.col("_there"), F.col("full")).otherwise(F.col("media")))
    lists = best.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "media"))), lambda x: x["media"]).alias("_media"))
    return keyed.join(lists, "_row", "left").withColumn(column, F.col("_media")).drop("_row", "_media")
