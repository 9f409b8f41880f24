"""Chat and preference readers on files with repeated, malformed and trailing text."""

import json

from quarry.sources import readers as RD


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def turns(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.conv_key, {})[r.turn] = (r.role, r.content)
    return sorted(tuple(c[t] for t in sorted(c)) for c in by.values())


def test_equal_openai_lines_stay_apart(spark, tmp_path):
    line = json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]})
    got = turns(RD.read_openai_chat(spark, put(tmp_path / "c.jsonl", line, line, "not json")))
    assert got == [(("user", "a"), ("assistant", "b"))] * 2


def test_sharegpt_lines_and_arrays(spark, tmp_path):
    rows = [{"conversations": [{"from": "human", "value": str(i)}]} for i in (1, 2, 2)]
    want = [(("user", "1"),), (("user", "2"),), (("user", "2"),)]
    assert turns(RD.read_sharegpt_chat(spark, put(tmp_path / "s.jsonl", *map(json.dumps, rows), json.dumps(rows[0]) + " tail"))) == want
    assert turns(RD.read_sharegpt_chat(spark, put(tmp_path / "s.json", json.dumps(rows)))) == want


def test_alpaca_lines_and_arrays(spark, tmp_path):
    rows = [{"instruction": "i", "input": "", "output": "o"}] * 2 + [{"instruction": "j", "input": "k", "output": "o"}]
    want = [(("user", "i"), ("assistant", "o"))] * 2 + [(("user", "j\n\nk"), ("assistant", "o"))]
    assert turns(RD.read_alpaca(spark, put(tmp_path / "a.jsonl", *map(json.dumps, rows)))) == want
    assert turns(RD.read_alpaca(spark, put(tmp_path / "a.json", json.dumps(rows)))) == want


def test_malformed_preferences_are_left_out(spark, tmp_path):
    path = put(tmp_path / "p.jsonl", json.dumps({"prompt": "p", "chosen": "c"}), "not json")
    assert [tuple(r) for r in RD.read_preferences(spark, path).collect()] == [("p", "c", "")]


def test_text_after_a_json_value_is_an_error(spark):
    df = spark.createDataFrame([(x,) for x in ('{"a":1}', '{"a":1} tail', "1", "", "{")], "t string")
    got = [r.ok for r in df.select(RD.strict_json("t").isNotNull().alias("ok")).collect()]
    assert got == [True, False, True, False, False]


def test_repeated_and_prefixed_train_keys(spark):
    from quarry.operators import logs as LG

    df = spark.createDataFrame([(1, "train/loss=1 val/loss=2 train/loss=3")], "id long, line string")
    assert LG.parse_train_lines(df, "id", "line").first().metrics == {"train/loss": 3.0, "val/loss": 2.0}


def test_missing_values_are_in_no_bucket(spark):
    from quarry.operators import logs as LG

    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", None)], "n string, v double")
    assert sorted((r.bucket, r["count"]) for r in LG.value_histogram(df, "n", "v", 4).collect()) == [(0, 1), (3, 1)]


def test_uniform_reaches_every_index_of_a_large_source(spark):
    from quarry.operators import mixing as MX

    rows = spark.range(200).select((MX.uniform(1, "id") * 2.0**40).cast("long").alias("i")).collect()
    assert any(r.i % 2 for r in rows)
