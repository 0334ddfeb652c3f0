"""Large JSON documents and files of lines, read and written by many tasks.

A document of one map or array may be one file, even one line. It is read as text in pieces between commas, which
Spark cuts by bytes as any file, so a piece may lie inside a string or deep in a record. What a piece does to the
state of the reader, inside a string or not, and how deep, depends only on whether it begins inside one; both cases
are evaluated, and sums over the pieces of a block, then over the blocks of a file, say which holds. Commas
at the depth of the members cut them; the pieces of one member are put together again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_KEY = rf"(?s)^\s*({_STRING})\s*:"


def _count(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kind}]", ""))


def _depth(text: Column) -> Column:
    """Brackets opened less those closed outside strings, of a piece that begins outside one."""
    outside = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return _count(outside, r"\[{") - _count(outside, r"\]}")


def _before(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over all pieces of the file before each: over those of its block, and over whole blocks."""
    block = ["file", "block"]
    own = pieces.withColumn("_v", value.cast("long"))
    sums = own.groupBy(*block).agg(F.sum("_v").alias("_s"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    sums = sums.select(*block, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_b"))
    within = W.partitionBy(*block).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    out = own.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0))).join(sums, block)
    return out.withColumn(name, F.col("_w") + F.col("_b")).drop("_v", "_w", "_b")


def json_members(spark: SparkSession, path: str | list[str], field: str | None = None) -> DataFrame:
    """file, pos, key and value (JSON text) of the members of documents that are one map or array each; with ``field``
    of the members of that field of a map. Array members have no key; an empty document, or one without the field, gives no rows."""
    text = spark.read.option("lineSep", ",").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord")]
    pieces = text.select(*place, "value").withColumn("bare", F.regexp_replace("value", r"(?s)\\.", ""))
    pieces = pieces.select("file", "block", "ord", "value", _count(F.col("bare"), '"').alias("quotes"), _depth(F.col("bare")).alias("d0"), _depth(F.concat(F.lit('"'), "bare")).alias("d1"))
    pieces = _before(pieces, F.col("quotes"), "q")
    begins_inside = F.col("q") % 2 == 1
    pieces = pieces.withColumn("ends_inside", (F.col("q") + F.col("quotes")) % 2 == 1).withColumn("d", F.when(begins_inside, F.col("d1")).otherwise(F.col("d0")))
    pieces = _before(pieces, F.col("d"), "depth").withColumn("depth", F.col("depth") + F.col("d"))
    cuts = lambda level: ~F.col("ends_inside") & (F.col("depth") == level)
    pieces = _before(pieces, cuts(1), "m")
    member = ["file", "m"]
    if field is not None:
        # The first piece of a member of the map says its key; few rows, one for each document.
        first = pieces.groupBy("file", "m").agg(F.min_by("value", F.struct("block", "ord")).alias("value"))
        named = F.regexp_replace("value", r"^\s*\{", "")
        found = first.filter(_unquoted(F.regexp_extract(F.when(F.col("m") == 0, named).otherwise(F.col("value")), _KEY, 1)) == field).select("file", "m")
        pieces = _before(pieces.join(found, member), cuts(2), "k")
        member = ["file", "k"]
    whole = pieces.groupBy(*member).agg(F.array_sort(F.collect_list(F.struct("block", "ord", "value"))).alias("parts"), F.min("depth").alias("least"))
    value = F.array_join(F.transform("parts", lambda p: p["value"]), ",")
    pos, level = F.col(member[1]), 1 if field is None else 2
    opened = r"(?s)^\s*[\[{]" if field is None else rf"(?s)^\s*\{{?\s*{_STRING}\s*:\s*[\[{{]"
    value = F.when(pos == 0, F.regexp_replace(value, opened, "")).otherwise(value)
    # The last member ends with the brackets that its pieces close beyond its own.
    for more in range(1, level + 1):
        value = F.when(F.col("least") <= level - more, F.regexp_replace(value, r"[\]}]\s*$", "")).otherwise(value)
    rows = whole.select("file", pos.alias("pos"), value.alias("value")).filter(r"value rlike '\\S'")
    key = F.regexp_extract("value", _KEY, 1)
    keyed = F.when(key != "", _unquoted(key))
    return rows.select("file", "pos", keyed.alias("key"), F.trim(F.regexp_replace("value", _KEY, "")).alias("value"))


def _unquoted(text: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))


def read_prefix(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """The rows of JSONL files up to the first bad line of each, and those lines (file, value); blank lines are no lines."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    checked = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"))
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value").filter(F.trim("value") != "")
    parsed = text.withColumn("r", F.from_json("value", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    first = parsed.filter(bad).groupBy("file").agg(F.min_by("value", "place").alias("value"), F.min("place").alias("end"))
    good = parsed.join(first.select("file", "end"), "file", "left").filter(F.col("end").isNull() | (F.col("place") < F.col("end")))
    return good.select("r.*").drop("_corrupt_record"), first.select("file", "value")


def write_document(df: DataFrame, path: str, order: list[str], key: str | None = None) -> None:
    """All rows as one JSON document in one file: an array of records in order, or a map by ``key``, whose values are a record each.

    Tasks write ranges of the rows to parts beside it; one task appends these, a bounded piece at a time, to a file under another
    name, which gets its own once it is whole; parts are deleted. Until then nothing is seen at ``path``, and a task
    that runs again starts its file anew. ``path`` is a URI of a store that all executors share.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    record = F.to_json(F.struct(*(c for c in df.columns if c != key)), {"ignoreNullFields": "false"})
    if key is not None:
        name = F.regexp_replace(F.to_json(F.array(F.col(key).cast("string"))), r"^\[|\]$", "")
        record = F.concat(name, F.lit(": "), record)
    parts = f"{path}.parts-{run}"
    df.withColumn("_line", record).repartitionByRange(*order).sortWithinPartitions(*order).select("_line").write.text(parts)
    opened, closed = ("[", "]") if key is None else ("{", "}")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for _ in batches:
            pass
        store, source = fs.FileSystem.from_uri(parts)
        target = fs.FileSystem.from_uri(path)[1]
        names = sorted(i.path for i in store.get_file_info(fs.FileSelector(source)) if i.base_name.startswith("part-") and i.size)
        unfinished, rows = f"{target}.{uuid.uuid4().hex}.unfinished", 0
        with store.open_output_stream(unfinished) as out:
            out.write(opened.encode())
            for name in names:
                with store.open_input_stream(name) as lines:
                    rest = b""
                    while piece := lines.read(4 << 20):
                        *full, rest = (rest + bytes(piece)).split(b"\n")
                        for line in full:
                            out.write(b",\n" + line if rows else b"\n" + line)
                            rows += 1
            out.write(b"\n" + closed.encode() if rows else closed.encode())
        store.move(unfinished, target)
        store.delete_dir(source)
        yield pa.RecordBatch.from_arrays([pa.array([rows])], ["n"])

    spark.range(1, numPartitions=1).mapInArrow(join, "n long").write.format("noop").mode("overwrite").save()
