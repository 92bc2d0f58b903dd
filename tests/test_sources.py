import json

import pytest
from pyspark.sql import functions as F

from corpusmith.sources import tables
from corpusmith.streaming.append import append_stream, periodic


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "é"}\n\n   \n{"a": null}\n')
    rows = tables.read_jsonl(spark, str(p), "a int, b string")
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, "é"), (None, None)]
    tables.write_jsonl(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_jsonl(spark, str(tmp_path / "out"), "a int, b string").collect()), key=str) == [(1, "é"), (None, None)]
    assert any('"b":null' in f.read_text() for f in (tmp_path / "out").glob("part*"))
    p.write_text('{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(p), "a int").collect()
    with pytest.raises(FileNotFoundError):
        tables.existing(spark, str(tmp_path / "none"))


def test_csv(spark, tmp_path):
    tables.write_summary_csv(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "s"))
    lines = next((tmp_path / "s").glob("part*")).read_text().splitlines()
    assert lines == ["a,b", ",1"]


def test_records(spark):
    rows = spark.createDataFrame([("x", [1.0, 3.0], 0), ("x", [0.0, 0.0], 1), ("y", [-1.0], 0)], "example_id string, teacher_relevance array<double>, row_idx int")
    last = {r["example_id"]: r["teacher_relevance"] for r in tables.normalize_rationale(tables.last_wins(rows, "example_id", "row_idx")).collect()}
    assert last == {"x": [0.5, 0.5], "y": [1.0]}


def test_cache_key():
    key = tables.cache_key({"b": 1, "a": "é"})
    assert len(key) == 24 and key == tables.cache_key(json.loads('{"a": "\\u00e9", "b": 1}'))


def test_shards(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"s{k}.jsonl").write_text(f'{{"a": {k}}}\n\n')
    paths = [str(tmp_path / f"s{k}.jsonl") for k in range(2)]
    assert sorted(map(tuple, tables.read_shards(spark, paths, "a int").collect())) == [(0, 0), (1, 1)]
    with pytest.raises(FileNotFoundError):
        tables.read_shards(spark, [*paths, str(tmp_path / "s2.jsonl")], "a int")


def test_checkpoints(spark):
    rows = spark.createDataFrame([("checkpoint-500",), ("checkpoint-1000",), ("last",)], "n string")
    assert rows.select(F.max_by("n", tables.checkpoint_step(F.col("n")))).first()[0] == "checkpoint-1000"


def test_append(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"a": {k}}}\n')
    assert append_stream(spark, source, "a int", sink, mark) == 2
    (tmp_path / "in" / "2.json").write_text('{"a": 2}\n')
    assert append_stream(spark, source, "a int", sink, mark) == 1
    assert sorted(r["a"] for r in spark.read.schema("a int").json(sink).collect()) == [0, 1, 2]
    seen = []
    act = periodic(2, lambda df, k: seen.append(k))
    for k in range(4):
        act(None, k)
    assert seen == [0, 2]
