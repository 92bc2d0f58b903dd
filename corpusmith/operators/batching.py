"""Ragged arrays to padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions.answers import bound


def pad_truncate(df: DataFrame, ids: str, batch: str, limit: int, pad: int) -> DataFrame:
    """ids cut to limit and padded to the longest of their batch."""
    cut = F.slice(F.col(ids), 1, limit)
    longest = F.max(F.size(cut)).over(Window.partitionBy(batch))
    return df.withColumn(ids, F.concat(cut, F.array_repeat(F.lit(pad), longest - F.size(cut))))


def label_mask(ids: Column, prompt_length: Column, pad: int, hidden: int = -100) -> Column:
    """ids with the prompt's places and pad ids hidden."""
    return F.transform(ids, lambda x, i: F.when((i < prompt_length) | (x == pad), F.lit(hidden)).otherwise(x))


def ragged_transpose(df: DataFrame, batch: str, row: str, targets: str) -> DataFrame:
    """A row for each batch and target index: how many rows have one, and the first and last of them by row.

    A batch's rows meet as they are, so that no row for each target is shuffled or sorted.
    """
    listed = df.select(batch, F.struct(F.col(row).alias("r"), F.col(targets).alias("t")).alias("x")).groupBy(batch).agg(F.collect_list("x").alias("_rows"))
    longest = F.array_max(F.transform("_rows", lambda x: F.when(x["t"].isNull(), 0).otherwise(F.size(x["t"]))))

    def at(k: Column) -> Column:
        have = F.transform(F.filter("_rows", lambda x: F.size(x["t"]) > k), lambda x: F.struct(x["r"].alias("r"), F.get(x["t"], k).alias("t")))
        return bound(lambda s: F.struct(k.alias("target_idx"), F.size(s["h"]).cast("long").alias("active"), F.array_min(s["h"])["t"].alias("first_target"), F.array_max(s["h"])["t"].alias("last_target")), h=have)

    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1))
    return listed.select(batch, F.explode(F.transform(places, at)).alias("_of")).select(batch, "_of.*")
