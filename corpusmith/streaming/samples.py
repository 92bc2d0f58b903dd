"""A uniform sample of each source of a stream, at every moment.

A row's draw is a hash of its key, so the k rows of the least draws are a uniform sample of
whatever has arrived, in any order and cut of the batches, and the sample of two parts is that of
their samples: k rows a source are all that is kept. Each micro-batch merges its own k
least draws with the table of the batch before and writes the next table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmith.operators.sampling import sample_per_source
from corpusmith.sources.commits import exists, place


def _before(spark: SparkSession, root: str, batch: int) -> str | None:
    """The table of the last batch before this one. Of later ones, left by a run that was lost, nothing is read."""
    p, fs = place(spark, root)
    if not exists(spark, root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    numbers = [int(n.partition("=")[2]) for n in names if n.startswith("batch=")]
    # A table that was being written when a run was lost has no mark of success.
    whole = [n for n in numbers if n < batch and exists(spark, f"{root}/batch={n}/_SUCCESS")]
    return f"{root}/batch={max(whole)}" if whole else None


def keep_sample(stream: DataFrame, root: str, checkpoint: str, source: str, key: str, k: int, seed: int = 42, keep: int = 2):
    """A query that keeps k rows of each source of a stream in tables below root; to be started by .start().

    A batch that is played again after a crash reads the same table and replaces its own, so a
    row is never counted twice; rows that repeat a source and key are one. The last ``keep`` tables stay.
    """
    columns = stream.columns
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        rows, before = batch.select(*columns), _before(spark, root, number)
        if before:
            rows = rows.unionByName(spark.read.schema(stream.schema).parquet(before))
        # The least draws of each task's rows come first, then those of all.
        sample_per_source(rows.dropDuplicates([source, key]), source, key, k, seed).select(*columns).write.mode("overwrite").parquet(f"{root}/batch={number}")
        p, fs = place(spark, root)
        numbers = sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch="))
        for old in [n for n in numbers if n <= number][:-keep]:
            fs.delete(place(spark, f"{root}/batch={old}")[0], True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def current_sample(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The sample of all batches so far."""
    last = _before(spark, root, 1 << 62)
    return spark.read.schema(schema).parquet(last) if last else spark.createDataFrame([], schema)
