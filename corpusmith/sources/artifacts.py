"""JSON documents, stage metadata and exported checkpoints, through Hadoop's file systems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.operators import sampling
from corpusmith.sources.tables import checkpoint_step, write_jsonl


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One JSON document (a summary, a run's settings), keys in sorted order; parents are made, a file there is replaced."""
    p, fs = _file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray((json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def persist_stage(df: DataFrame, folder: str, source: str, key: str, per_source: int = 3, seed: int = 42) -> None:
    """Metadata of a blend (rows by source) and a few rows of each source, below folder."""
    spark = df.sparkSession
    counts = {r[source]: r["n"] for r in df.groupBy(source).agg(F.count("*").alias("n")).collect()}
    write_json(spark, f"{folder}/blend_metadata.json", {"counts": counts, "total_samples": sum(counts.values())})
    write_jsonl(sampling.sample_per_source(df, source, key, per_source, seed).drop("draw"), f"{folder}/sampled_rows.jsonl")


def resumable_checkpoint(names: DataFrame, best: str | None = None) -> str | None:
    """Of checkpoint names (column name), best if it is there, else that of the greatest step; None for none."""
    found = names.agg(F.max_by("name", F.struct(checkpoint_step(F.col("name")), "name")).alias("last"), F.max(F.col("name") == F.lit(best)).alias("has_best")).first()
    return best if found["has_best"] else found["last"]


def export_checkpoint(spark: SparkSession, stage: str, target: str, best: str | None = None) -> str:
    """Copy a stage's best or last checkpoint folder to target; its state then names target as the best. Returns the source."""
    p, fs = _file_system(spark, stage)
    there = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    rows = spark.createDataFrame([(n,) for n in there if n.startswith("checkpoint-")], "name string")
    chosen = resumable_checkpoint(rows, best)
    if chosen is None:
        raise RuntimeError(f"no checkpoint to export in {stage}")
    out, out_fs = _file_system(spark, target)
    if out_fs.exists(out):
        out_fs.delete(out, True)
    source = spark._jvm.org.apache.hadoop.fs.Path(f"{stage.rstrip('/')}/{chosen}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, out_fs, out, False, spark._jsc.hadoopConfiguration())
    state = f"{target.rstrip('/')}/trainer_state.json"
    at, state_fs = _file_system(spark, state)
    if state_fs.exists(at):
        value = read_json(spark, state)
        if value.get("best_model_checkpoint"):
            value["best_model_checkpoint"] = target
        write_json(spark, state, value)
    return f"{stage.rstrip('/')}/{chosen}"
