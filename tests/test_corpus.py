"""Corpora of files of all kinds, as Python reads them; large JSON arrays by many tasks."""

import json
import os
import random
import tempfile

import pytest

from quarry.sources import jsonfiles
from quarry.sources import readers as RD
from quarry.sources import sinks as SK
from quarry.sources.jsonfiles import elements
from quarry.suite import ingest


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="quarry-test-", dir="/tmp")


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def as_python(folder):
    """What Python's reading of the same files gives."""
    out = []
    for root, _, names in os.walk(folder):
        for n in names:
            ext = os.path.splitext(n)[1].lower()
            with open(os.path.join(root, n), encoding="utf-8", errors="replace") as f:
                if ext == ".json":
                    try:
                        data = json.load(f)
                    except ValueError:
                        continue
                    for item in data if isinstance(data, list) else [data] if isinstance(data, dict) else []:
                        fields = ("text", "content", "body", "input")[:4 if isinstance(data, list) else 3]
                        found = [item] if isinstance(item, str) else [item[k] for k in fields if isinstance(item.get(k), str)] if isinstance(item, dict) else []
                        out += [(n, x) for x in found[:1]]
                elif ext in (".txt", ".md", ".csv", ".tsv", ".rst"):
                    text = f.read()
                    out += [(n, text)] if text.strip() else []
    return sorted(out)


JSON = {
    "array": '[{"text": "a, [b] \\" {c"}, "d,e", {"input": "f", "x": [1, {"y": "]"}]}, 5, null, ["g"], {"body": 1, "content": "h\\\\"}]',
    "object": '{"text": 5, "content": "whole, object", "body": "no"}', "nested": '[[{"text": "deep"}], {"text": {"text": "x"}, "body": "y"}]',
    "empty": "[]", "blank_array": " [ \n ] ", "nothing": "", "string": '"just text, so"', "number": "12",
    "garbage_after": '[{"text": "x"}] tail', "two": '[{"text": "x"}], [{"text": "y"}]', "two_apart": '[{"text": "x"}] [{"text": "y"}]', "open": '[{"text": "x"}', "open_string": '[{"text": "x}]',
    "trailing_comma": '[{"text": "x"},]', "double_comma": '["x",,"y"]', "closed_twice": '["x"]]', "bad_inside": '["x", {"text": oops}]', "single": "['x']", "braces": '["x"}', "object_tail": '{"text": "x"} y', "escapes": '["\\\\\\\\", "\\\\\\"", "a\\\\\\\\,b", "\\u00e9\\u002c"]',
    "pretty": json.dumps([{"text": f"é {i}, [{i}]"} for i in range(20)], indent=2, ensure_ascii=False), "long": json.dumps([f"s{i}," * (i % 7) for i in range(500)]),
}


def test_every_json_file_as_python_parses_it(spark, tmp):
    for name, text in JSON.items():
        put(f"{tmp}/in/{name}.json", text)
    put(f"{tmp}/in/bytes.json", b'["a\xff\xfe", {"text": "\xf0\x9f\x98, b"}]')
    got = sorted((os.path.basename(r.path), r.text) for r in RD.read_text_corpus(spark, f"{tmp}/in").collect())
    assert got == as_python(f"{tmp}/in")


def test_one_array_is_read_by_many_tasks(spark, tmp):
    """Blocks of 300 bytes begin inside strings, after escapes and at any depth."""
    rng = random.Random(5)
    odd = ['"', "\\", ",", "[", "]", "{", "}", "\\\"", "é", " ", "\n", "x", '\\",', '],"']
    word = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))
    items = [rng.choice([word(), {"text": word(), "m": [word(), {word(): [1, 2.5, None]}]}, {"n": 1, "body": word()}, [word()], rng.randint(0, 9)]) for _ in range(600)]
    put(f"{tmp}/in/big.json", json.dumps(items, indent=rng.choice([None, 1])))
    put(f"{tmp}/in/cut.json", json.dumps(items)[:-3])
    put(f"{tmp}/in/small.json", json.dumps(["one", "two"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "300")
    try:
        found = elements(spark, f"{tmp}/in").collect()
        got = sorted((os.path.basename(r.path), r.text) for r in RD.read_json_text(spark, f"{tmp}/in").collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    big = {r.element_no: json.loads(r.text) for r in found if r.path.endswith("big.json")}
    assert [big[i] for i in range(len(big))] == items
    assert not any(r.path.endswith("cut.json") for r in found)
    assert got == as_python(f"{tmp}/in")


def test_text_files_and_folders(spark, tmp):
    put(f"{tmp}/in/a.TXT", b"bad \xff bytes\r\nand \xe2\x82 line\rends")
    put(f"{tmp}/in/sub/b.md", "# deep")
    put(f"{tmp}/in/c.csv", "x,y\n1,2\n")
    put(f"{tmp}/in/blank.rst", " \n\t")
    put(f"{tmp}/in/skip.png", "not text")
    put(f"{tmp}/in/sub/in/d.txt", "a folder of the same name")
    assert sorted((os.path.basename(r.path), r.text) for r in RD.read_text_corpus(spark, f"{tmp}/in").collect()) == as_python(f"{tmp}/in")
    top = RD.read_text_corpus(spark, f"{tmp}/in", recursive=False).collect()
    assert sorted(os.path.basename(r.path) for r in top) == ["a.TXT", "c.csv"]
    some = RD.read_text_corpus(spark, files=[f"{tmp}/in/skip.png", f"{tmp}/missing.txt", f"{tmp}/in", f"{tmp}/in/c.csv"]).collect()
    assert sorted(r.text for r in some) == ["not text", "x,y\n1,2\n"]
    assert RD.read_text_corpus(spark, f"{tmp}/nowhere").count() == 0
    assert RD.read_text_corpus(spark, f"{tmp}/in", [f"{tmp}/in/skip.png"]).count() == 5


def test_jsonl_with_bad_bytes(spark, tmp):
    put(f"{tmp}/x.jsonl", b'{"text": "a\xff"}\r\n{"text": "b"} tail\n\n{"message": "c"}\r{"prompt": "d"}')
    assert sorted(r.text for r in RD.read_text_corpus(spark, files=[f"{tmp}/x.jsonl"]).collect()) == ["a�", "c", "d"]


def test_folders_share_listing_tasks(spark, tmp):
    """300 folders are not 300 tasks of each listing."""
    for i in range(300):
        put(f"{tmp}/in/d{i}/x.txt", str(i))
    sc, before = spark.sparkContext, spark.conf.get(RD.LISTING_TASKS)
    sc.setJobGroup("listing", "")
    try:
        found = RD.read_text_corpus(spark, f"{tmp}/in")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup("listing")]
    tasks = [status.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if status.getStageInfo(s)]
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism
    assert spark.conf.get(RD.LISTING_TASKS) == before
    assert sorted(r.text for r in found.collect()) == sorted(map(str, range(300)))


def test_lines_of_files_are_written_as_they_are(spark, tmp):
    rows = [(f, i, bytes([0xFF, 65 + f]) * i) for f in range(40) for i in range(5)]
    lines = spark.createDataFrame(rows[::-1], "file long, n int, value binary")
    assert SK.write_text_files(lines, f"{tmp}/out", "file", "value", ["n"]) == 40
    assert SK.write_text_files(lines, f"{tmp}/out", "file", "value", ["n"]) == 40  # as by a task that runs again
    for f in range(40):
        assert os.listdir(f"{tmp}/out/file={f}") == ["lines.txt"]
        with open(f"{tmp}/out/file={f}/lines.txt", "rb") as got:
            assert got.read() == b"".join(bytes([0xFF, 65 + f]) * i + b"\n" for i in range(5))


def test_tokenized_texts_are_read_once(spark, tmp, monkeypatch):
    """The shards' layout reads texts that were taken from the files before."""
    spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp}/documents.parquet")
    write, read = SK.write_token_shards, []
    monkeypatch.setattr(SK, "write_token_shards", lambda docs, *a, **k: read.extend(docs.inputFiles()) or write(docs, *a, **k))
    row = ingest.q_tokenize_corpus(spark, tmp).first()
    assert read and all(f.endswith(".parquet") for f in read)
    assert (row.total_files, row.files_read, row.ids_read) == (3, 3, row.total_tokens)


def test_blocks_are_small_and_partitions_grow_with_bytes(spark, tmp, monkeypatch):
    """A range of bytes is many blocks, dealt to more partitions than the session's if it is large."""
    items = [["a,b", '"[', i] if i % 3 else {"text": f"{i},{{", "n": [1, [2, i]]} for i in range(3000)]
    put(f"{tmp}/in/one.json", json.dumps(items))
    put(f"{tmp}/in/two.json", json.dumps({"text": "x,y"}))
    put(f"{tmp}/in/three.json", "\u015b1, 2]")  # its first character's code is that of a bracket, and 256
    monkeypatch.setattr(jsonfiles, "BLOCK_FRAGMENTS", 64)
    monkeypatch.setattr(jsonfiles, "PARTITION_BYTES", 1 << 14)
    rows = jsonfiles.fragments(spark, f"{tmp}/in")
    assert rows.groupBy("path", "_blk").count().agg({"count": "max"}).first()[0] <= 64
    assert jsonfiles._partitions(rows) == -(-rows.selectExpr(f"sum(_bytes + {jsonfiles.ROW_BYTES})").first()[0] // (1 << 14)) > 50
    found = elements(spark, f"{tmp}/in").collect()
    one = {r.element_no: json.loads(r.text) for r in found if r.path.endswith("one.json")}
    assert [one[i] for i in range(len(one))] == items
    assert [r.text for r in found if not r.path.endswith("one.json")] == ['{"text": "x,y"}']
