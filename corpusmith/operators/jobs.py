"""Job matrices and what is left of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.text import slugify
from corpusmith.operators.prompts import ACTS, catalog


def _listed(spark: SparkSession, name: str, values: Sequence, kind: str) -> DataFrame:
    return spark.createDataFrame([(v, k) for k, v in enumerate(values)], f"{name} {kind}, {name}_order int")


def benchmark_jobs(spark: SparkSession, datasets: Sequence[str], acts: Sequence[str], read_times: Sequence[int], base_models: Sequence[str], own_model: str | None) -> DataFrame:
    """Datasets x acts x read counts x models in that nesting; small by construction, so a cross join."""
    if bad := [a for a in acts if a not in ACTS]:
        raise ValueError(f"unknown acts {bad}")
    models = [("base", m) for m in base_models] + ([("compressed", own_model)] if own_model else [])
    model = spark.createDataFrame([(*m, k) for k, m in enumerate(models)], "kind string, model_name string, model_order int")
    rows = _listed(spark, "dataset_name", datasets, "string").join(catalog(spark).select("dataset_name", "supports_pal"), "dataset_name")
    rows = rows.crossJoin(_listed(spark, "act", acts, "string")).where((F.col("act") != "pal") | F.col("supports_pal"))
    rows = rows.crossJoin(_listed(spark, "read_times", read_times, "int")).crossJoin(model)
    name = F.concat_ws("__", "kind", "dataset_name", "act", F.concat(F.lit("read"), F.col("read_times")), slugify(F.col("model_name")))
    return rows.select(name.alias("job_name"), "kind", "dataset_name", "model_name", "act", "read_times", "dataset_name_order", "act_order", "read_times_order", "model_order")


def heldout_jobs(spark: SparkSession, base_models: Sequence[str], scenarios: Sequence[str], own_model: str, thinking: Sequence[bool]) -> DataFrame:
    """Base: models x thinking x scenarios; own: scenarios x thinking."""
    repeats = {"base_no_hint": 1, "base_prompt_twice": 2}
    base = [("base", s, m, t, repeats[s]) for m in base_models for t in thinking for s in scenarios]
    own = [("compressed", s, own_model, t, None) for s in ("compressed_with_hint", "compressed_masked_hint") for t in thinking]
    schema = "job_idx int, kind string, scenario string, model_name string, enable_thinking boolean, prompt_repeat_count int"
    rows = spark.createDataFrame([(k, *j) for k, j in enumerate(base + own)], schema)
    mode = F.when(F.col("enable_thinking"), "thinking_on").otherwise("thinking_off")
    return rows.withColumn("job_name", F.concat_ws("__", "scenario", mode, slugify(F.col("model_name"))))


def pending(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done, "job_name", "left_anti")


def finished(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done, "job_name", "left_semi")
