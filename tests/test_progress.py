import time

from pyspark.sql import functions as F

from corpusmith.operators import progress


def test_progress(spark):
    p = progress.Progress("filter", total=1000)
    p.watch(spark.range(1000).where("id % 4 = 0"), most=F.max("id")).write.format("noop").mode("overwrite").save()
    found = p.report()
    assert found["rows"] == 250 and found["most"] == 996 and found["share"] == 0.25 and found["rows_per_second"] > 0
    assert progress.seconds_left(0, 10, 1.0) is None and progress.seconds_left(5, 10, 2.0) == 2.0 and progress.seconds_left(12, 10, 2.0) == 0


def test_stream_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": 1}\n{"a": 2}\n')
    listener = progress.StreamProgress()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("a int").json(str(tmp_path / "in"))
        q = stream.writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()
        until = time.time() + 20
        while not listener.batches and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert ("watched", 0, 2) in [b[:3] for b in listener.batches]
