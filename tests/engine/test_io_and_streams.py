"""Readers, writers, providers and the streaming forms on files."""

import json

import pytest
from pyspark.sql import functions as F

from sentrellis.operators import providers
from sentrellis.operators.providers import CONTRACTS, TableProvider, batched, bound, resolved
from sentrellis.sources import readers, writers
from sentrellis.streaming import state


def put(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_readers(spark, tmp_path):
    a = put(tmp_path / "a.jsonl", [{"id": 1, "image": "x.jpg"}, {"id": 2, "image": "y"}])
    b = put(tmp_path / "b.JSON", [[{"id": 3, "image": "z"}]])
    assert readers.read_json(spark, a).count() == 2 and readers.read_json(spark, b).count() == 1
    with pytest.raises(ValueError):
        readers.read_json(spark, str(tmp_path / "a.csv"))
    points = readers.data_points(readers.read_json(spark, a)).orderBy("image_path").collect()
    assert points[0]["image_id"] == "x.jpg" and points[0]["attributes"] == {"id": "1", "image": "x.jpg"}
    good, bad = readers.read_lines(spark, put(tmp_path / "c.jsonl", [{"id": 1}, "{broken", "", {"id": 2}]), "id long")
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and bad.count() == 1
    assert {r["name"]: r["value"] for r in readers.read_metrics(spark, put(tmp_path / "m.txt", ["a = 1", "b=2.5", "junk"])).collect()} == {"a": 1.0, "b": 2.5}
    assert readers.read_words(spark, put(tmp_path / "w.txt", ["dog", "", " cat "])).count() == 2
    doc = readers.read_json(spark, put(tmp_path / "d.json", [{"data": [{"q": 1}, {"q": 2}]}]))
    assert readers.field_rows(doc, "data").count() == 2
    registry = {"set": {"file_name": "a.jsonl", "columns": {"key": "id"}}, "hub": {"hf_hub_url": "x"}}
    assert "key" in readers.read_registered(spark, registry, "set", str(tmp_path)).columns
    with pytest.raises(NotImplementedError):
        readers.read_registered(spark, registry, "hub")


def test_tree_and_images(spark, tmp_path):
    (tmp_path / "r" / "s").mkdir(parents=True)
    put(tmp_path / "r" / "coco_pope_random.json", [{"x": 1}])
    put(tmp_path / "r" / "s" / "coco_pope_popular.json", [{"x": 2}])
    rows = readers.read_tree(spark, str(tmp_path / "r"), "*.json", "coco_pope")
    assert sorted(r["c"] for r in rows.select(readers.file_category(F.col("file")).alias("c")).collect()) == ["popular", "random"]
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    images = readers.read_images(spark, str(tmp_path), "*.png")
    assert images.select(readers.decoded_image(readers.encoded_image(F.col("content"))).alias("b")).first()["b"] == b"\x89PNG"
    named = images.select(writers.masked_name(F.col("path"), F.lit("hot dog")).alias("name"), "content")
    writers.write_images(named, f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "a_masked_hot dog.png").read_bytes() == b"\x89PNG"


@pytest.mark.parametrize("path,want", [("x/a.b.png", "a.b_masked_o.png"), ("a", "a_masked_o"), (".a", ".a_masked_o"), ("a..b", "a._masked_o.b"), ("..a", "..a_masked_o")])
def test_masked_names(spark, path, want):
    assert spark.range(1).select(writers.masked_name(F.lit(path), F.lit("o"))).first()[0] == want


def test_media_paths(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "id int, images array<string>")
    files = spark.createDataFrame([("/m/a",), ("/m/c",)], "path string")
    got = {r["id"]: r["images"] for r in readers.resolved_media(rows, "images", files, "/m").collect()}
    assert got == {1: ["/m/a", "b"], 2: ["/m/c"]}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, ["b", "a"]), ("k", 2, ["c"])], "key string, ord int, s array<string>")
    out = str(tmp_path / "out")
    writers.append_rows(rows, out)
    writers.append_rows(rows, out)
    assert spark.read.json(out).count() == 4
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        writers.write_new(rows, out)
    writers.snapshot(rows, out)
    assert spark.read.json(out).count() == 2
    assert [x["ord"] for x in json.loads(writers.map_lines(rows, "key", ["ord"]).first()["value"])["k"]] == [1, 2]
    assert len(json.loads(writers.array_document(rows, ["ord"]).first()["value"])) == 2
    assert writers.sorted_sets(rows).orderBy("ord").first()["s"] == ["a", "b"]


def test_providers(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    answers = TableProvider(spark.createDataFrame([("a", "x")], "k string, v string"), ["k"])(asked)
    assert [tuple(r) for r in answers.collect()] == [("a", "x")]
    upper = batched(lambda rows: [{"k": r["k"], "v": r["k"].upper()} for r in rows], "k string, v string")
    assert sorted(r["v"] for r in upper(asked).collect()) == ["A", "A", "B"]


def test_contracts(spark):
    asked, calls = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "prompt string, more int"), spark.sparkContext.accumulator(0)

    def judge(rows):
        calls.add(len(rows))
        return [{"prompt": r["prompt"], "answer": str(list(r))} for r in rows]

    got = bound(batched(judge, "prompt string, answer string"), CONTRACTS["judge"])(asked)
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", "['prompt']"), (None, "['prompt']")] and calls.value == 2
    with pytest.raises(ValueError, match="requests without prompt"):
        bound(judge, CONTRACTS["judge"])(asked.drop("prompt"))
    with pytest.raises(ValueError, match="answers without answer"):
        bound(lambda r: r, CONTRACTS["judge"])(asked)
    rows = spark.createDataFrame([(1, None, "it"), (2, "a dog.", "it"), (3, "a dog.", "he"), (4, None, None)], "id int, context string, sentence string")
    known = spark.createDataFrame([("a dog.", "it", "the dog"), ("a dog.", "it", "the dog"), (None, "it", "that")], "context string, sentence string, resolved string")
    got = resolved(rows, lambda r: known)
    assert sorted((r["id"], r["resolved"]) for r in got.collect()) == [(1, "that"), (2, "the dog"), (3, "he"), (4, None)]


STEP = "image_id string, step int, cand_idx array<int>, sentences array<string>, reps array<array<string>>, closed array<string>, open array<string>"


def test_context_over_a_stream(spark, tmp_path):
    rows = [
        ("i", 1, [0, 1], ["a dog", "a cat"], [["dog"], ["cat"]], ["dog"], ["dog"]),  # the dog is real, the cat hallucinated
        ("i", 2, [1, 0, 2], ["the dog", "a cat and a dog", "a bus"], [["dog"], ["cat", "dog"], ["bus"]], ["cat"], ["cat", "bus"]),  # the cat stays ruled
        ("i", 3, [0, 1], ["", ""], [[], []], [], []), ("i", 4, [0], ["late"], [[]], [], []), ("j", 2, [5], ["sole"], [[]], [], []),
    ]
    for row in sorted(rows, key=lambda r: r[1]):  # one step in a batch, so that all else is state
        spark.createDataFrame([row], STEP).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(STEP).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = state.context_stream(stream, ["dog", "cat"])
    out.writeStream.format("memory").queryName("contexts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    got = {(r["image_id"], r["step"]): r for r in spark.table("contexts").collect()}
    assert sorted(got) == [("i", 1), ("i", 2), ("i", 3), ("j", 2)]
    one, two, three = (got["i", k] for k in (1, 2, 3))
    assert (one["sentence"], one["context"], one["win"], one["nonhallu_objects"], one["hallu_objects"]) == ("a dog", "", [], ["dog"], ["cat"])
    # The bus is clean and new, so it is chosen; the dog is clean and known, so it is paired with the cat.
    assert (two["sentence"], two["context"], two["context_objects"], two["win"], two["lose"]) == ("a bus", "a dog", ["dog"], [1], [0])
    assert three["ended"] and three["cand_idx"] is None and three["context"] == "a dog a bus" and three["context_objects"] == ["bus", "dog"]
    assert got["j", 2]["cand_idx"] == 5 and not got["j", 2]["ended"]


def test_context_over_a_table(spark):
    """A table's steps, in any order, give what the processor with a state store gives, and ask no state store."""
    words = ["dog", "cat", "bus", "tree", ""]
    cands = lambda i, k: [((c + i) % 3 * 7, words[(i * k + c * c) % 5], [w for w in words[:4] if w == words[(i * k + c * c) % 5]]) for c in range((i + k) % 4)]
    steps = [(i, k, cands(i, k)) for i in range(40) for k in range(5)]
    rows = [(str(i), k, [c[0] for c in x], [c[1] for c in x], [c[2] for c in x], words[: (i + k) % 3], words[: i % 4]) for i, k, x in steps] + [(None, 1, [3], [None], [["dog"]], [], ["dog"])]
    table = spark.createDataFrame(rows[::2] + rows[1::2], STEP).repartition(3)
    got = state.context_stream(table, ["dog", "cat"])
    assert "TransformWithState" not in got._jdf.queryExecution().executedPlan().toString()
    with_store = table.groupBy("image_id").transformWithStateInPandas(state.ContextState(["dog", "cat"]), state.ContextState.OUTPUT, "Append", "None")
    _ = spark.streams.active  # starts what keeps track of state stores
    said = sorted(map(repr, got.collect()))
    assert said == sorted(map(repr, with_store.collect())) and 100 < len(said) < len(rows)


def test_append_once(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("i", 1), ("i", 1), ("j", 2)], "image_id string, step int")
    run = lambda: state.append_once(spark.readStream.schema(rows.schema).json(source), out, str(tmp_path / "cp"), ["image_id", "step"]).trigger(availableNow=True).start().awaitTermination(120)
    read = lambda: sorted(tuple(r)[:2] for r in state.appended(spark, out, rows.schema).collect())
    assert read() == []
    rows.coalesce(1).write.json(source)
    run()
    assert read() == [("i", 1), ("j", 2)]
    spark.createDataFrame([("k", 3)], rows.schema).coalesce(1).write.mode("append").json(source)
    held = state._lines
    monkeypatch.setattr(state, "_lines", lambda *_: 1 / 0)  # a batch that is lost before its rows
    with pytest.raises(Exception, match="ZeroDivision"):
        run()
    monkeypatch.setattr(state, "_lines", held)
    (tmp_path / "out" / "out" / "batch=000000000001").mkdir()  # and one that was lost between rows and manifest
    (tmp_path / "out" / "out" / "batch=000000000001" / "part-0.json").write_text('{"image_id": "x", "step": 9}\n')
    assert read() == [("i", 1), ("j", 2)]
    run()
    assert read() == [("i", 1), ("j", 2), ("k", 3)]
    (tmp_path / "cp" / "commits" / "1").unlink()  # the rows are there, but the query does not know it
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    before = (tmp_path / "out" / "out" / "batch=000000000001").stat().st_mtime_ns
    run()
    assert read() == [("i", 1), ("j", 2), ("k", 3)] and (tmp_path / "out" / "out" / "batch=000000000001").stat().st_mtime_ns == before


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert kept(spark.table("windows")) == kept(state.windowed_counts(events))


def test_pool(spark, tmp_path):
    """A flaky judge answers all, a request that always fails does not stop the others, and no more run at once than may."""
    asked = spark.createDataFrame([(f"q{i}",) for i in range(40)] + [("dead",), (None,)], "prompt string").coalesce(1)
    folder = str(tmp_path)

    def judge(request):
        import os
        import threading
        import time

        name = request["prompt"] or "none"
        calls = f"{folder}/{name}"
        with open(calls, "a") as f:
            f.write("x")
        with open(f"{folder}/at_once", "a") as f:
            f.write(f"{sum(t.name.startswith('ThreadPool') for t in threading.enumerate())}\n")
        time.sleep(0.01)
        if name == "dead" or os.path.getsize(calls) < 1 + hash(name[-1:]) % 3:
            raise ConnectionError("busy")
        return {"prompt": request["prompt"], "answer": name.upper()}

    out = spark.createDataFrame(providers.pooled(judge, "prompt string, answer string", workers=4, attempts=4, wait=0.01)(asked).collect(), "prompt string, answer string, error string")
    assert [r["prompt"] for r in out.collect()] == [r["prompt"] for r in asked.collect()]
    assert [tuple(r) for r in providers.failures(out).collect()] == [("dead", None, "ConnectionError: busy")]
    assert {r["answer"] for r in providers.answers(out).collect()} == {f"Q{i}" for i in range(40)} | {"NONE"}
    assert (tmp_path / "dead").stat().st_size == 4 and max(map(int, (tmp_path / "at_once").read_text().split())) <= 4


def test_stored_answers_of_null(spark):
    known = spark.createDataFrame([(None, "it", "that"), ("a", "it", "this")], "context string, sentence string, resolved string")
    asked = spark.createDataFrame([(None, "it"), ("b", "it")], "context string, sentence string")
    assert [tuple(r) for r in TableProvider(known, ["context", "sentence"])(asked).collect()] == [(None, "it", "that")]
