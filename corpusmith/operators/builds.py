"""Sharded builds that go on where they stopped.

The folder of a build is its manifest: a shard is finished when its folder stands there, and
it is put there by one rename, whole or not at all. A run takes the shards that are missing,
a lot of them in one Spark job, each written aside. A run that is killed leaves finished
shards and folders aside that nothing reads; two runs at once lose work, never rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.sources.commits import aside, exists, place, rename_once

LOT = 16


def shard_path(root: str, shards: int, shard: int) -> str:
    return f"{root.rstrip('/')}/shard-{shard:05d}-of-{shards:05d}"


def finished(spark: SparkSession, root: str, shards: int) -> list[int]:
    """Shards whose folders stand."""
    return [k for k in range(shards) if exists(spark, shard_path(root, shards, k))]


def build(rows: DataFrame, root: str, shards: int, make: Callable[[DataFrame], DataFrame], shard: str = "shard", lot: int = LOT) -> list[int]:
    """Make the shards that are missing; the numbers of those that this run has put in place.

    rows: with a column of shard numbers (0 to shards - 1), which make has to keep. A shard
    without rows gets an empty folder. Whatever else a number is, is an error.
    """
    spark = rows.sparkSession
    if not rows.where(f"{shard} is null or {shard} not between 0 and {shards - 1}").isEmpty():
        raise ValueError("a row's shard is out of range")
    done = set(finished(spark, root, shards))
    todo, put = [k for k in range(shards) if k not in done], []
    for at in range(0, len(todo), lot):
        some = todo[at : at + lot]
        away = aside(root)
        make(rows.where(F.col(shard).isin(some))).withColumn("_shard", F.col(shard)).write.partitionBy("_shard").parquet(away)
        for k in some:
            part = f"{away}/_shard={k}"
            if not exists(spark, part):
                p, fs = place(spark, part)
                fs.mkdirs(p)
            if rename_once(spark, part, shard_path(root, shards, k)):
                put.append(k)
        p, fs = place(spark, away)
        fs.delete(p, True)
    return put


def merged(spark: SparkSession, root: str, shards: int, schema: str) -> DataFrame:
    """Rows of all shards; an error where one is missing."""
    missing = sorted(set(range(shards)) - set(finished(spark, root, shards)))
    if missing:
        raise FileNotFoundError(", ".join(shard_path(root, shards, k) for k in missing[:3]))
    return spark.read.schema(schema).parquet(*(shard_path(root, shards, k) for k in range(shards)))
