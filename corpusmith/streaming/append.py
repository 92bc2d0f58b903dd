"""Streaming: incremental append of records, and periodic logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, max_files: int = 1) -> int:
    """Append each new file's rows to sink as JSON lines, a micro-batch at a time; returns the batches that ran.

    The checkpoint remembers what was read, so a rerun adds only what is new. A batch that is
    played again after a crash replaces what it had written.
    """
    batches = []

    def put(df: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(source)
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(batches)


def periodic(every: int, act):
    """A foreachBatch function that acts on each ``every``-th batch."""

    def put(df: DataFrame, batch_id: int) -> None:
        if batch_id % every == 0:
            act(df, batch_id)

    return put
