"""Sources and sinks: JSON lines, catalogs, unions, caches and rationale records."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.operators.spans import normalize_distribution


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_summary_csv(df: DataFrame, path: str) -> None:
    """Columns in sorted order, missing cells empty, in one file (a summary is a few rows)."""
    df.select(sorted(df.columns)).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def existing(spark: SparkSession, path: str) -> str:
    """The path, if it is there; else an error. Nothing is fetched."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return path


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, that of the greatest order. An aggregate, so partial results combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def normalize_rationale(df: DataFrame) -> DataFrame:
    return df.withColumn("teacher_relevance", normalize_distribution(F.col("teacher_relevance")))


def cache_key(meta: dict) -> str:
    """Name of a cached result: the hash of its description."""
    return hashlib.sha256(json.dumps(meta, ensure_ascii=True, sort_keys=True).encode()).hexdigest()[:24]


def cache_key_column(meta_json: Column) -> Column:
    return F.substring(F.sha2(meta_json, 256), 1, 24)


def read_shards(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Shard files in shard order, with their number; a missing one is an error."""
    for p in paths:
        existing(spark, p)
    frames = [read_jsonl(spark, p, schema).withColumn("shard", F.lit(k)) for k, p in enumerate(paths)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def checkpoint_step(name: Column) -> Column:
    """Number at the end of a checkpoint's name, -1 for none."""
    return F.coalesce(F.element_at(F.split(name, "-"), -1).try_cast("int"), F.lit(-1))


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by order: a top-n, kept small in each task before they meet."""
    return df.orderBy(*order).limit(n)
