import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmith.operators import builds, sampling
from corpusmith.sources.commits import rename_once
from corpusmith.streaming import append, samples


def rows(spark, n=200, shards=7):
    return spark.range(n).select("id", (F.col("id") % (shards - 1)).cast("int").alias("shard"))  # the last shard has no rows


def made(df):
    return df.withColumn("twice", F.col("id") * 2)


def check(spark, root, n=200):
    found = builds.merged(spark, root, 7, "id long, shard int, twice long").collect()
    assert Counter(r["id"] for r in found) == Counter(range(n)) and all(r["twice"] == 2 * r["id"] for r in found)


def test_build_and_merge(spark, tmp_path):
    root = str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        builds.merged(spark, root, 7, "id long")
    assert builds.build(rows(spark), root, 7, made, lot=3) == list(range(7))
    check(spark, root)
    assert builds.build(rows(spark), root, 7, made) == []
    assert sorted(os.listdir(root)) == [f"shard-{k:05d}-of-00007" for k in range(7)]
    with pytest.raises(ValueError):
        builds.build(rows(spark), root, 3, made)


@pytest.mark.parametrize("left", [0, 1, 4])
def test_a_killed_build_goes_on(spark, tmp_path, monkeypatch, left):
    """The run is lost while it puts shards in place."""
    root, real, moved = str(tmp_path / "b"), rename_once, []

    def lost(spark, source, path):
        if len(moved) == left:
            raise KeyboardInterrupt
        moved.append(path)
        return real(spark, source, path)

    monkeypatch.setattr(builds, "rename_once", lost)
    with pytest.raises(KeyboardInterrupt):
        builds.build(rows(spark), root, 7, made, lot=3)
    assert len(builds.finished(spark, root, 7)) == left
    monkeypatch.setattr(builds, "rename_once", real)
    asked = []
    assert len(builds.build(rows(spark), root, 7, lambda df: asked.append(df.count()) or made(df), lot=3)) == 7 - left
    assert sum(asked) == 200 - sum(r["count"] for r in rows(spark).where(F.col("shard").isin(list(range(left)))).groupBy("shard").count().collect())
    check(spark, root)


def test_two_builds_at_once_leave_one(spark, tmp_path):
    root = str(tmp_path / "b")
    both = []

    def other_first(df):
        if not both:
            both.append(1)
            builds.build(rows(spark), root, 7, made)
        return made(df)

    assert builds.build(rows(spark), root, 7, other_first) == []
    check(spark, root)


def put_file(folder, name, values):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(v) + "\n" for v in values))


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    source, sink, mark = tmp_path / "in", str(tmp_path / "out"), tmp_path / "mark"
    put_file(source, "a.json", [{"a": 1}, {"a": 2}])
    assert append.append_stream(spark, str(source), "a int", sink, str(mark)) == 1
    for name in os.listdir(mark / "commits"):  # lost after the write, before its commit
        os.remove(mark / "commits" / name)
    put_file(source, "b.json", [{"a": 3}])
    append.append_stream(spark, str(source), "a int", sink, str(mark))
    assert sorted(r["a"] for r in spark.read.json(sink).collect()) == [1, 2, 3]


SCHEMA = "k long, s string, text string"


def run_sample(spark, tmp_path, k=5):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = samples.keep_sample(stream, str(tmp_path / "sample"), str(tmp_path / "mark"), "s", "k", k).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, samples.current_sample(spark, str(tmp_path / "sample"), SCHEMA).collect()))


def test_every_prefix_is_the_sample_of_what_arrived(spark, tmp_path):
    assert samples.current_sample(spark, str(tmp_path / "sample"), SCHEMA).count() == 0
    arrived = []
    for batch in range(4):
        some = [{"k": batch * 100 + i, "s": "ab"[i % 2] if batch else "a", "text": f"t{i}"} for i in range(30)]
        put_file(tmp_path / "in", f"{batch}.json", some)
        arrived += some
        df = spark.createDataFrame([tuple(r[c] for c in ("k", "s", "text")) for r in arrived], SCHEMA)
        want = sorted(map(tuple, sampling.sample_per_source(df, "s", "k", 5).select("k", "s", "text").collect()))
        assert run_sample(spark, tmp_path) == want and len(want) == (10 if batch else 5)
        if batch == 2:  # the run is lost before its batch is committed, and plays it again
            last = max(os.listdir(tmp_path / "mark" / "commits"), key=lambda n: int(n) if n.isdigit() else -1)
            for name in (last, f".{last}.crc"):
                if os.path.exists(tmp_path / "mark" / "commits" / name):
                    os.remove(tmp_path / "mark" / "commits" / name)
            assert run_sample(spark, tmp_path) == want
    assert len([n for n in os.listdir(tmp_path / "sample") if n.startswith("batch=")]) <= 2
