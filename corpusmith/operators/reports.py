"""Summaries of predictions and their roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from corpusmith.functions.metrics import average
from corpusmith.operators.prompts import ARC

COUNTS = ("num_samples", "strict_correct_num", "strict_null_num", "relaxed_correct_num", "relaxed_null_num", "correct_num", "null_num", "no_boxed_num")


def _rates() -> list[Column]:
    n = F.col("num_samples")
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    names = {
        "strict_accuracy": "strict_correct_num", "strict_null_rate": "strict_null_num", "relaxed_accuracy": "relaxed_correct_num",
        "relaxed_null_rate": "relaxed_null_num", "accuracy": "correct_num", "null_rate": "null_num", "no_boxed_rate": "no_boxed_num",
    }
    return [share(c).alias(name) for name, c in names.items()]


def summarize_runs(records: DataFrame, *keys: str) -> DataFrame:
    """records: strict_parsed, relaxed_parsed, strict_score, relaxed_score, no_boxed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = records.groupBy(*keys).agg(
        F.count("*").alias("num_samples"),
        total("strict_score").alias("strict_correct_num"),
        F.count_if(F.col("strict_parsed").isNull()).alias("strict_null_num"),
        total("relaxed_score").alias("relaxed_correct_num"),
        F.count_if(F.col("relaxed_parsed").isNull()).alias("relaxed_null_num"),
        total("relaxed_score").alias("correct_num"),
        F.count_if(F.col("relaxed_parsed").isNull()).alias("null_num"),
        total("no_boxed").alias("no_boxed_num"),
    )
    return counts.select(*keys, *COUNTS, *_rates())


def arc_total(summaries: DataFrame, *keys: str) -> DataFrame:
    """One row over both ARC datasets for each key; rates anew from the sums."""
    rows = summaries.where(F.col("dataset_name").isin(*ARC)).groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    return rows.where("num_samples > 0").select(F.lit("arc_total").alias("dataset_name"), *keys, *COUNTS, *_rates())


def metric_means(records: DataFrame, *keys: str) -> DataFrame:
    """Means of what metric columns the records have."""
    return records.groupBy(*keys).agg(
        F.count("*").alias("num_samples"),
        *(average(F.col(c)).alias(c) for c in ("exact_match", "token_f1", "rouge_l_f1") if c in records.columns),
    )


def union_sorted(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns are the sorted union of all, missing cells null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(sorted(out.columns))


def no_boxed(raw: Column, act: Column) -> Column:
    return ((act != "pal") & (raw != "") & ~F.lower(raw).contains("boxed")).cast("int")


#: Names of training outputs and the names that logs have for them.
LOSSES = {
    "answer_loss": "loss_ans",
    "mh_align_loss": "loss_align",
    "rationale_loss": "loss_rat",
    "teacher_relevance_entropy": "teacher_rel_entropy",
    "student_relevance_entropy": "student_rel_entropy",
    "rationale_top1_hit": "teacher_student_top1_hit",
    "rationale_top3_overlap": "teacher_student_top3_overlap",
    "gate_l1_loss": "gate_l1_loss",
    "projector_raw_l2_loss": "projector_raw_l2_loss",
}


def loss_metrics(outputs: DataFrame, *keys: str) -> DataFrame:
    """keys and the known outputs under their log names as doubles. Numbers stay, lists of one number give it, all else is null."""

    def scalar(c: str) -> Column:
        kind = outputs.schema[c].dataType
        if isinstance(kind, ArrayType):
            return F.when(F.size(c) == 1, F.get(F.col(c), 0).cast("double"))
        return F.col(c).cast("double") if isinstance(kind, NumericType) else F.lit(None).cast("double")

    return outputs.select(*keys, *(scalar(c).alias(name) for c, name in LOSSES.items() if c in outputs.columns))
