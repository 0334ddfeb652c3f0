"""Writers: appended lines, grouped maps, single documents, reports and masked images."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_rows(df: DataFrame, path: str) -> None:
    """JSON lines added to a directory; existing files stay."""
    df.write.mode("append").json(path)


def write_new(df: DataFrame, path: str) -> None:
    """JSON lines, refused where something exists."""
    df.write.mode("errorifexists").json(path)


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def grouped(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key and rows: all other columns of a key's rows as an array in a stated order."""
    rest = [c for c in df.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order])))
    return df.groupBy(key).agg(rows.alias("rows"))


def map_lines(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One JSON object a key, {key: [rows]}: what a document with one map holds, as lines that scale."""
    return grouped(df, key, order).select(F.to_json(F.create_map(F.col(key).cast("string"), F.col("rows"))).alias("value"))


def array_document(df: DataFrame, order: list[str]) -> DataFrame:
    """All rows as one JSON array, for small results that a trainer reads as one file."""
    rest = [c for c in df.columns if c not in order]
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *rest)))).alias("value"))


def sorted_sets(df: DataFrame) -> DataFrame:
    """With every array column sorted, for sets have no order."""
    return df.select(*(F.array_sort(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


def report(parts: list[Column], digits: int = 2) -> Column:
    """Percentages joined by slashes."""
    return F.concat_ws("/", *(F.format_string(f"%.{digits}f", p * 100) for p in parts))


def masked_name(path: Column, masked: Column) -> Column:
    """Name of an image with an object masked: stem, "_masked_", object as it is, ending; leading dots begin no ending."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = r"(?<!^\.{0,99})\.[^.]*$"
    return F.concat(F.regexp_replace(name, ending, ""), F.lit("_masked_"), masked, F.regexp_extract(name, ending, 0))


def write_images(df: DataFrame, folder: str) -> None:
    """Bytes of ``content`` under ``name`` in a folder that all executors share; a task that runs again overwrites."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    df.select("name", "content").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
