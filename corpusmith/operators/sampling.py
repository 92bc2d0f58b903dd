"""Blends, samples, splits, shards and row indexes.

Draws follow the order of md5(seed:key), ties by key: the same in any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def draw_key(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


ROWS_A_RANGE = 100_000
SAMPLES_A_RANGE = 32


def range_bounds(df: DataFrame, keys: Sequence[str], ranges: int, rows: int) -> list[Row]:
    """ranges - 1 rows of keys that cut df into ranges of about equal size, from a sample of SAMPLES_A_RANGE rows a range."""
    if ranges < 2 or not rows:
        return []
    share = min(1.0, SAMPLES_A_RANGE * ranges / rows)
    found = df.select(*keys).sample(share, seed=7).orderBy(*keys).collect()
    return [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []


def range_of(df: DataFrame, keys: Sequence[str], bounds: list[Row]) -> Column:
    """Number of the range that a row's keys fall into, by bisection: a function of the keys alone, so that each scan gives the same."""
    if not bounds:
        return F.lit(0)
    literal = lambda row: F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(keys, row, strict=True)))
    edges, key = F.array(*map(literal, bounds)), F.struct(*keys)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    onward = lambda at, step: (at + step <= len(bounds)) & (F.get(edges, at + step - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(onward(at, step), at + step).otherwise(at))


def _ranged(df: DataFrame, keys: Sequence[str], ranges: int | None) -> DataFrame:
    """df with the number of its range in ``_p``."""
    n = df.count()
    return df.withColumn("_p", range_of(df, keys, range_bounds(df, keys, ranges or -(-n // ROWS_A_RANGE), n)))


def with_row_index(df: DataFrame, *order: str, name: str = "row_idx", n_ranges: int | None = None) -> DataFrame:
    """A global index from 0 by order, without gathering the rows in one task.

    Bounds are sampled once and are constants of the plan from then on, so the count of each
    range and the rows that are numbered in it can't disagree, however often and wherever a
    task runs. Only keys are read to count; rows are shuffled once.
    """
    rows = _ranged(df, order, n_ranges)
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = rows.groupBy(F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    joined = numbered.join(F.broadcast(offsets), F.col("_p") == F.col("_q"))
    return joined.withColumn(name, F.col("_base") + F.col("_i") - 1).drop("_p", "_q", "_i", "_base")


def blend_counts(ratios: Sequence[int], epoch_size: int | None, lengths: Sequence[int] | None = None) -> list[int]:
    """Rows to take from each source. Without epoch_size: as many whole ratio units as every source can give."""
    if not ratios or any(r <= 0 for r in ratios):
        raise ValueError("ratios must be positive")
    if epoch_size is None:
        if lengths is None or len(lengths) != len(ratios):
            raise ValueError("without an epoch size the lengths are needed")
        unit = min(n // r for n, r in zip(lengths, ratios, strict=True))
        return [r * unit for r in ratios]
    if epoch_size <= 0:
        raise ValueError("the epoch size must be positive")
    total = sum(ratios)
    counts = [epoch_size * r // total for r in ratios]
    for k in range(epoch_size - sum(counts)):
        counts[k] += 1
    return counts


def with_group_index(df: DataFrame, group: str, *order: str, name: str = "draw", n_ranges: int | None = None) -> DataFrame:
    """An index from 1 within each group by order; a group of any size is spread over many tasks.

    Ranges are of group and order (see with_row_index); the part of a group in a range is
    numbered there, and a table of one count a part gives each its offset.
    """
    rows = _ranged(df, (group, *order), n_ranges)
    before = Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("_p").alias("_q"), F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    offsets = parts.select("_q", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_p", group).orderBy(*order)))
    joined = numbered.join(offsets, (F.col("_p") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(name, F.col("_base") + F.col("_i")).drop("_p", "_q", "_g", "_i", "_base")


def sample_per_source(df: DataFrame, source: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each source, uniform without replacement."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy(source).orderBy(draw_key(F.col(key), seed), key)  # so small a rank is cut off before the shuffle
    return df.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= k)


def ratio_blend(df: DataFrame, source: str, key: str, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """counts[s] rows of each source s, in draw order, without replacement."""
    take = F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))
    drawn = df.where(F.col(source).isin(list(counts))).withColumn("_draw", draw_key(F.col(key), seed))
    ranked = with_group_index(drawn, source, "_draw", key).drop("_draw")
    return ranked.where(F.col("draw") <= F.try_element_at(take, F.col(source)))


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n draws by a hash of the draw's number; draw_idx counts them."""
    rows = with_row_index(df, key)
    size = df.count()
    if n <= 0 or not size:
        return rows.limit(0).withColumn("draw_idx", F.lit(0).cast("long")).drop("row_idx")
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw_idx"), (hashed % size).alias("row_idx"))
    return draws.join(rows, "row_idx").drop("row_idx")


def eval_size(n: int, share: float) -> int:
    if not 0 < share < 1:
        raise ValueError("the share lies between 0 and 1")
    size = max(1, int(n * share))
    if size >= n:
        raise ValueError("nothing is left to train on")
    return size


def train_eval_split(df: DataFrame, key: str, share: float = 0.02, seed: int = 42) -> DataFrame:
    """A column split: the last rows in draw order are for evaluation."""
    n = df.count()
    size = eval_size(n, share)
    ranked = with_row_index(df.withColumn("_draw", draw_key(F.col(key), seed)), "_draw", key, name="_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") >= n - size, "eval").otherwise("train")).drop("_draw", "_rank")


def shard_of(index: Column, n: int, shards: int) -> Column:
    """Shard of a row index: contiguous, sizes differ by one at most, the first are larger."""
    size, more = divmod(n, shards)
    edge = more * (size + 1)
    return F.when(index < edge, F.floor(index / (size + 1))).otherwise(more + F.floor((index - edge) / max(1, size))).cast("int")


def shard_range(n: int, shards: int, shard: int, start: int = 0, limit: int | None = None) -> tuple[int, int]:
    if not 0 <= shard < shards:
        raise ValueError("no such shard")
    start = min(max(start, 0), n)
    end = n if limit is None else min(n, start + max(0, limit))
    size, more = divmod(end - start, shards)
    a = start + shard * size + min(shard, more)
    return a, a + size + (shard < more)


def shard_name(stem: str, ext: str, shards: int, shard: Column) -> Column:
    return F.format_string(f"{stem}.shard-%05d-of-%05d{ext}", shard, F.lit(shards))


def batch_id(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("long")
