"""Readers and sinks on small files written to a fresh temporary folder
(restating the reference's reader, shard and format tests)."""

import json
import os
import tempfile

import numpy as np
import pytest

from quarry.operators import chat as C
from quarry.operators import tokens as TK
from quarry.sources import readers as RD
from quarry.sources import sinks as SK


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="quarry-test-", dir="/tmp")


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_text_corpus_formats(spark, tmp):
    _w(f"{tmp}/in/test.txt", "Hello world")
    _w(f"{tmp}/in/a.jsonl", '{"text": "one"}\n\n{"text": "two"}\nnot json\n{"content": 5, "body": "three"}\n')
    _w(f"{tmp}/in/b.json", json.dumps([{"text": "four"}, "five", {"input": "six"}]))
    _w(f"{tmp}/in/image.png", "binary")
    _w(f"{tmp}/in/blank.md", "   \n")
    got = sorted(r.text for r in RD.read_text_corpus(spark, input_dir=f"{tmp}/in").collect())
    assert got == sorted(["Hello world", "one", "two", "three", "four", "five", "six"])
    only = RD.read_text_corpus(spark, files=[f"{tmp}/in/test.txt"]).collect()
    assert [r.text for r in only] == ["Hello world"]
    assert RD.read_text_corpus(spark, files=[f"{tmp}/in/image.png"]).count() == 1  # explicit files are not filtered


def test_jsonl_conversations_second_record(spark, tmp):
    _w(f"{tmp}/c.jsonl", json.dumps({"text": "t", "conversations": [{"value": "a"}, "b", {"x": 1}]}) + "\n")
    assert sorted(r.text for r in RD.read_jsonl_text(spark, f"{tmp}/c.jsonl").collect()) == ["a\nb", "t"]


def test_inventory_and_data_path(spark, tmp):
    base = f"{tmp}/datasets"
    _w(f"{base}/raw/sub/x.TXT", "hi")
    _w(f"{base}/loose.md", "loose")
    np.arange(10, dtype=np.uint32).tofile(os.path.join(tmp, "t.bin"))
    os.makedirs(f"{base}/tokens", exist_ok=True)
    os.replace(os.path.join(tmp, "t.bin"), f"{base}/tokens/shard_0000.bin")
    _w(f"{base}/tokens/readme.BIN", "case-sensitive suffix: not a shard")
    inv = RD.file_inventory(spark, base)
    row = inv.first()
    assert row.status == "mixed" and row.total_pretokenized_files == 1 and row.total_raw_files == 1
    assert row.raw_text_dir == f"{base}/raw"
    assert inv.select(RD.choose_data_path(inv, True).alias("p")).first().p == f"{base}/tokens"
    assert inv.select(RD.choose_data_path(inv, False).alias("p")).first().p == f"{base}/raw"
    empty = RD.file_inventory(spark, f"{tmp}/nothing").first()
    assert empty.status == "empty"


def test_chat_readers(spark, tmp):
    _w(f"{tmp}/o.jsonl", json.dumps({"messages": [{"role": "user", "content": "Hi"}, {"content": "Hello"}]}) + "\n"
       + json.dumps({"messages": []}) + "\n")
    o = RD.read_openai_chat(spark, f"{tmp}/o.jsonl").orderBy("turn").collect()
    assert [(r.role, r.content) for r in o] == [("user", "Hi"), ("user", "Hello")]
    call = '[{"id":"c1","type":"function","function":{"name":"f","arguments":"{\\"a\\": 1}"}}]'
    _w(f"{tmp}/t.jsonl", '{"messages": [{"role": "assistant", "tool_calls": ' + call + '}, {"role": "tool", "tool_call_id": "c1", "name": "f", "content": "r"}]}\n{"messages": []} tail\n')
    t = RD.read_openai_chat(spark, f"{tmp}/t.jsonl").orderBy("turn").collect()
    assert [(r.role, r.content, r.tool_calls, r.tool_call_id, r.name) for r in t] == [("assistant", "", call, None, None), ("tool", "r", None, "c1", "f")]
    _w(f"{tmp}/s.json", json.dumps([{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"},
                                                       {"from": "alien", "value": "z"}]}]))
    s = RD.read_sharegpt_chat(spark, f"{tmp}/s.json").orderBy("turn").collect()
    assert [r.role for r in s] == ["user", "assistant", "user"]
    _w(f"{tmp}/a.json", json.dumps([{"instruction": "Do", "input": "", "output": "Done"},
                                    {"instruction": "X", "input": "ctx", "output": ""}]))
    a = RD.read_alpaca(spark, f"{tmp}/a.json").collect()
    pairs = sorted((r.role, r.content) for r in a)
    assert pairs == [("assistant", "Done"), ("user", "Do"), ("user", "X\n\nctx")]


def test_files_of_any_name_are_read(spark, tmp):
    """A file is read as lines if it is named .jsonl, and as a whole otherwise, whatever its last letters."""
    for name in ("a.json", "b.jsonl", "html", "l", "x.onl", "fjsonl", "jsonl", "c.txtl"):
        _w(f"{tmp}/mixed/{name}", json.dumps({"conversations": [{"from": "human", "value": name}]}) + "\n")
    assert sorted(r.content for r in RD.read_sharegpt_chat(spark, f"{tmp}/mixed").collect()) == sorted(os.listdir(f"{tmp}/mixed"))


def test_preferences_and_benchmarks(spark, tmp):
    _w(f"{tmp}/p.jsonl", '{"prompt": "p", "chosen": "c"}\n{"prompt": "q", "chosen": "d", "rejected": "r"}\n')
    rows = RD.read_preferences(spark, f"{tmp}/p.jsonl").collect()
    assert [(r.prompt, r.rejected) for r in rows] == [("p", ""), ("q", "r")]
    _w(f"{tmp}/empty.jsonl", "")
    with pytest.raises(ValueError):
        RD.read_preferences(spark, f"{tmp}/empty.jsonl")
    _w(f"{tmp}/mmlu/algebra.jsonl", json.dumps({"question": "1+1", "choices": ["1", "2", "3", "4"], "answer": "1"}) + "\n")
    _w(f"{tmp}/mmlu/history.jsonl", json.dumps({"question": "when", "choice_A": "a", "choice_B": "b", "answer": "A"}) + "\n")
    b = {r.subject: r for r in RD.read_benchmark_items(spark, f"{tmp}/mmlu").collect()}
    assert b["algebra"].answer == "B" and b["history"].choices == ["a", "b"]
    only = RD.read_benchmark_items(spark, f"{tmp}/mmlu", ["history"]).collect()
    assert [r.subject for r in only] == ["history"]


def test_shards_round_trip(spark, tmp):
    texts = ["Document %d: " % i + "word " * 100 for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = f"{tmp}/tokens"
    written = SK.write_token_shards(docs, out, shard_size=500).orderBy("shard_id").collect()
    stream = []
    for t in texts:
        stream += [TK.BOS_ID] + list(t.encode()) + [TK.EOS_ID, 10]
    assert len(written) == (len(stream) + 499) // 500
    meta = json.load(open(f"{out}/meta.json"))
    assert meta["total_tokens"] == len(stream) and meta["dtype"] == "uint32"
    disk = np.concatenate([np.fromfile(f"{out}/shard_{i:04d}.bin", dtype=np.uint32) for i in range(len(written))])
    assert disk.tolist() == stream
    assert SK.manifest_check(spark, out).first().consistent
    back = RD.read_token_shards(spark, out, block_tokens=300).orderBy("shard_no", "block").collect()
    assert [t for r in back for t in r.tokens] == stream


def test_single_file_and_jsonl_sink(spark, tmp):
    _w(f"{tmp}/one.txt", "Hello tokens")
    n = SK.write_token_file(spark, f"{tmp}/one.txt", f"{tmp}/one.bin")
    assert n == len("Hello tokens") + 2 and os.path.getsize(f"{tmp}/one.bin") == 4 * n
    df = spark.createDataFrame([("héllo",), ("x",)], "text string")
    stats = SK.write_jsonl(df, "text", f"{tmp}/out.jsonl")
    assert stats["samples"] == 2 and stats["characters"] == 6


def test_register_function_schema(spark):
    def add(a: int, b: float = 1.0, note="x") -> float:
        """Adds."""
        return a + b
    rows = C.register_function(spark, add).orderBy("position").collect()
    assert [(r.param, r.type, r.required) for r in rows] == [("a", "integer", True), ("b", "number", False),
                                                             ("note", "string", False)]
    assert spark.sql("SELECT add(2, 0.5, 'n') AS v").first().v == 2.5
    sch = C.tool_schema(spark.createDataFrame(rows)).first()
    assert sch.prompt_line == "- add(a: integer): Adds."


def test_discover_and_union_sources(spark, tmp):
    for name in ("wiki", "code"):
        os.makedirs(f"{tmp}/mix/{name}", exist_ok=True)
        np.arange(5, dtype=np.uint32).tofile(f"{tmp}/mix/{name}/shard_0000.bin")
    os.makedirs(f"{tmp}/mix/empty", exist_ok=True)
    assert [r.name for r in RD.discover_sources(spark, f"{tmp}/mix").collect()] == ["code", "wiki"]
    _w(f"{tmp}/s1.jsonl", '{"text": "a"}\n{"text": "b"}\n')
    recs, status = RD.union_sources(spark, [("s1", f"{tmp}/s1.jsonl"), ("missing", f"{tmp}/nope.jsonl")], cap=1)
    assert recs.count() == 1
    assert {(r.source, r.ok) for r in status.collect()} == {("s1", True), ("missing", False)}
