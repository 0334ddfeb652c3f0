"""Documents in many tasks: quotes, escapes and brackets across cuts; prefixes of files; one file from many tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sentrellis.sources import documents

ODD = ['a,b', 'say "x, y"', "back\\slash\\", '\\"', "{[,]}", "line\nbreak, tab\t", "é中, 😀", "", ",", '",', "}", '"]']


def record(i):
    return {"id": i, "text": ODD[i % len(ODD)] * (i % 4), "list": [1, [2, ODD[(i + 5) % len(ODD)]], {"k,": None}], "e": {}, "n": i / 7}


def put(path, value, **how):
    path.write_text(value if isinstance(value, str) else json.dumps(value, **how), encoding="utf-8")
    return f"file://{path}"


@pytest.fixture()
def small_cuts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("how", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_members(spark, tmp_path, small_cuts, how):
    array, keyed = [record(i) for i in range(500)], {ODD[i % len(ODD)] + str(i): record(i) for i in range(500)}
    a, b = put(tmp_path / "a.json", array, **how), put(tmp_path / "b.json", keyed, **how)
    assert spark.read.option("lineSep", ",").text(a).rdd.getNumPartitions() >= 8
    rows = documents.json_members(spark, a).orderBy("pos").collect()
    assert [json.loads(r["value"]) for r in rows] == array and {r["key"] for r in rows} == {None}
    both = documents.json_members(spark, [a, b])
    got = {r["key"]: json.loads(r["value"]) for r in both.filter("key is not null").collect()}
    assert got == keyed and both.count() == 1000
    c = put(tmp_path / "c.json", {"info": {"data": [0]}, "x,\"": [1, 2], "data": array, "more": "data"}, **how)
    rows = documents.json_members(spark, c, "data").orderBy("pos").collect()
    assert [json.loads(r["value"]) for r in rows] == array
    rows = documents.json_members(spark, [put(tmp_path / "d.json", {"data": keyed}, **how), put(tmp_path / "e.json", {"data": [], "z": [5]}), b], "data").collect()
    assert {r["key"]: json.loads(r["value"]) for r in rows} == keyed


@pytest.mark.parametrize("text", ["[]", "{}", " [ ] \n", "", '{"x": 1}'])
def test_no_members(spark, tmp_path, text):
    path = put(tmp_path / "a.json", text)
    assert documents.json_members(spark, path, "data").collect() == []
    assert [r["key"] for r in documents.json_members(spark, path).collect()] == (["x"] if "x" in text else [])


def test_scalars(spark, tmp_path):
    rows = documents.json_members(spark, put(tmp_path / "a.json", '[1, "two, 2", null, true, [3,4], "a : b"]')).orderBy("pos").collect()
    assert [json.loads(r["value"]) for r in rows] == [1, "two, 2", None, True, [3, 4], "a : b"]


def test_prefix(spark, tmp_path, small_cuts):
    lines = [json.dumps({"id": i, "pad": "x" * 100}) for i in range(400)]
    whole = put(tmp_path / "whole.jsonl", "\n".join(lines))
    cut = put(tmp_path / "cut.jsonl", "\n".join([*lines[:250], "", "{broken", *lines[250:300], "worse", *lines[300:]]))
    none = put(tmp_path / "none.jsonl", "\n".join(["{", *lines]))
    assert spark.read.text(cut).rdd.getNumPartitions() >= 4
    good, bad = documents.read_prefix(spark, [whole, cut, none], "id long, pad string")
    assert sorted(r["id"] for r in good.collect()) == sorted([*range(400), *range(250)])
    assert {os.path.basename(r["file"]): r["value"] for r in bad.collect()} == {"cut.jsonl": "{broken", "none.jsonl": "{"}


def test_one_file_from_many_tasks(spark, tmp_path):
    rows = [{"k": ODD[i % len(ODD)] + str(i), "ord": i, "s": ODD[i % len(ODD)], "x": None if i % 3 else i} for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ord int, s string, x int").repartition(7)
    documents.write_document(df, f"file://{tmp_path}/a.json", ["ord"])
    assert json.loads((tmp_path / "a.json").read_text()) == rows
    documents.write_document(df, f"file://{tmp_path}/b.json", ["ord"], key="k")
    assert json.loads((tmp_path / "b.json").read_text()) == {r["k"]: {c: r[c] for c in ("ord", "s", "x")} for r in rows}
    documents.write_document(df.limit(0), f"file://{tmp_path}/c.json", ["ord"])
    assert json.loads((tmp_path / "c.json").read_text()) == []
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["a.json", "b.json", "c.json"]  # no parts are left
    fails = df.withColumn("s", F.when(F.col("ord") == 299, F.raise_error("lost")).otherwise(F.col("s")))
    with pytest.raises(Exception, match="lost"):
        documents.write_document(fails, f"file://{tmp_path}/d.json", ["ord"])
    assert not (tmp_path / "d.json").exists()
    got = documents.json_members(spark, f"file://{tmp_path}/b.json")
    assert {r["key"] for r in got.collect()} == {r["k"] for r in rows}
