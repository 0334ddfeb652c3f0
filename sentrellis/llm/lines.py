"""Line dedup: long lines that many documents share go, except in the document with the largest id.

Lines are normalised and hashed to 128 bits in Arrow batches; Spark counts distinct documents per hash in two
steps (per hash and document, then per hash), joins lines with the few hashes over the threshold, and puts each
text together again from the positions it keeps.

Defined cases: a null or empty text is one empty line; a row without an id stays as it is and does not count as
a document; rows of the same id count as one document; an empty table gives an empty result; further columns of
any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, encoded, materialise, prepare

MIN_CHARS = 40
MIN_DOCS = 5
_WS = WS.encode()


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, rid (hash of the text), pos and key hash of every line whose key has ``min_chars`` code points."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids, places, keys = [], [], [], []
            for doc, rid, text in zip(batch["doc_id"].to_pylist(), batch["rid"].to_pylist(), encoded(batch["text"]), strict=True):
                for i, line in enumerate((text or b"").split(b"\n")):
                    key = line.strip(_WS)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        ids.append(doc)
                        rids.append(rid)
                        places.append(i)
                        keys.append(xxhash.xxh128_digest(key.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(places, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "rid", "pos", "key"])

    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text")
    return own.mapInArrow(lines, "doc_id long, rid long, pos int, key binary")


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row`` (the document's own columns), n_lines, n_dropped and kept (the text that is left)."""
    prepare(docs.sparkSession)
    lines = materialise(hashed_lines(docs, min_chars))
    shared = lines.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    shared = materialise(shared.select("key", "keeper"))
    goes = lines.join(shared, "key").filter("doc_id <> keeper").groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("goes"))
    goes = goes.select(F.col("doc_id").alias("of"), F.col("rid").alias("of_rid"), "goes")
    own = docs.select(F.struct("*").alias("row"))
    same = (F.col("row.doc_id") == F.col("of")) & (F.xxhash64("row.text") == F.col("of_rid"))
    parts = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    out = own.join(goes, same, "left").withColumn("n_lines", F.size(parts).cast("long"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "goes"), lambda i: F.get(parts, i))
    return out.select(
        "row",
        "n_lines",
        F.when(F.col("goes").isNull(), 0).otherwise(F.size("goes")).cast("long").alias("n_dropped"),
        F.when(F.col("goes").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their shared lines removed. A text that loses nothing stays as it is, null included."""
    out = drop_shared_lines(docs, min_chars, min_docs).withColumn("t", F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")))
    return out.select(*(F.col("t").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
