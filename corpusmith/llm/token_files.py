"""Token-ID output: Parquet files of token lists, written and read by Spark.

File format: one row a document in ascending doc_id order: doc_id, n_tokens, part,
local_start and the list column ``tokens``. tokens is dictionary-encoded (bit-packed
indices of a vocabulary far below the dictionary page limit); the scalar columns are
delta-encoded (version 2 pages, no dictionary). Row groups and pages are bounded, and the
page index lets a reader fetch a range of doc_id, or the metadata columns alone, without
the token pages. ``part`` numbers the range partitions in order; a document's place in the
whole corpus is its part's offset plus local_start.

Scale: one range shuffle of the texts; encoding, writing and checksums are maps. Part
offsets are one row a file.

Cases: a null text is empty (the end id alone); null doc_ids come first; rows that repeat a
doc_id follow each other by text hash; an empty table gives no rows; further columns are
not carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.llm import common
from corpusmith.llm.encoding import crc, encoder

SLICE_ROWS = 2048
FILE_SCHEMA = "doc_id long, n_tokens long, part int, local_start long, tokens array<int>"
WRITE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def _encode(tokenizer: str, folder: str | None, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        enc, part, at = encoder(tokenizer, folder), TaskContext.get().partitionId(), 0
        for batch in common.slices(batches, SLICE_ROWS):
            flat, n = enc.encode(batch.column(1))
            values = np.insert(flat, np.cumsum(n), end_id).astype(np.int32)
            n = n + 1
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(at + ends[:-1]),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)),
                ],
                names=["doc_id", "n_tokens", "part", "local_start", "tokens"],
            )
            at += int(ends[-1])

    return common.tidied(run)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, folder: str | None = None) -> None:
    """Encode docs(doc_id, text) and write them in the module's format, in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # As many files as the scan has tasks at least, so that a part stays as small as a split.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ranged = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ranged.mapInArrow(_encode(tokenizer, folder, end_id), FILE_SCHEMA).write.options(**WRITE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, each with start: the ids of all documents before it."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(offsets), "part").withColumn("start", F.col("base") + F.col("local_start"))


def _checksum(batches):
    for batch in common.slices(batches, SLICE_ROWS):
        tokens = batch.column(3)
        ends = tokens.offsets.to_numpy().astype(np.int64)
        flat = memoryview(np.ascontiguousarray(tokens.flatten().to_numpy(zero_copy_only=False), "<i4")).cast("B")
        ends = 4 * (ends - ends[0])
        sums = [crc(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.record_batch([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(files: DataFrame) -> DataFrame:
    rows = files.select("doc_id", "start", "n_tokens", "tokens")
    return rows.mapInArrow(common.tidied(_checksum), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", 2)
    return token_digest(read_tokens(spark, path))
