"""Approximate nearest neighbours by shifted Hilbert orderings of projected vectors.

``n_curves`` orthonormal projections to ``dims`` axes, each with its own shift, give every
vector as many Hilbert keys. Each ordering is range-partitioned in Spark and yields ranks;
a query's window is the rows within ``window`` of all rows to either side of its rank. The
windows' rows are scored against the query in blocks, each block keeps its best, and the
merge drops repeats and reranks by the exact inner product in double precision.

Scale: an ordering is cut into blocks of ``block_rows`` ranks, queries into blocks of
``20 * block_rows`` ranks; a group is a pair of blocks within reach, so its memory is
bounded. Equal vectors are told apart by vec_id in the ordering, so no key can be hot. The
window is a share of the rows, so that recall does not fall as the table grows; the work
therefore grows as queries times rows, as the README says with figures.

Projections' means and spreads come from a bounded sample (``sample_rows`` least hashes);
every row is indexed.

Cases: vectors that are null, zero or hold null or non-finite components take no part, nor
do rows without vec_id. Vectors are neighbours within their dimension: one that at least
``COMMON`` of the rows have (100 dimensions at most) is searched by its own orderings, the
rows of rarer ones are compared in blocks with all of their dimension. Rows that repeat a
vec_id count once, with the least vector; an empty table gives no rows; further columns are
not carried along.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.llm import common

N_CURVES = 16
DIMS = 8
BITS = 4
WINDOW = 0.05
BLOCK_ROWS = 16_384
SAMPLE_ROWS = 4096
COMMON = 0.01
K = 20
FOUND = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (a row of coordinates below 2**bits) on the Hilbert curve; dims * bits is at most 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the curve's turns, from the coarsest level
        q = 1 << level
        low = q - 1
        for i in range(dims):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level) & 1
    return key


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vec: each id once, usable vectors. A written table."""
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("vec"))
    return common.materialize(rows, "vectors")[0]


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _curves(dim: int, n_curves: int, dims: int, seed: int) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    return [np.linalg.qr(r.normal(size=(dim, dim)))[0][:, : min(dims, dim)] for _ in range(n_curves)]


def _keys(bases: list[np.ndarray], centre: list, spread: list, shifts: np.ndarray, bits: int):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), batch.num_rows)
            for c, basis in enumerate(bases):
                at = np.clip(((x @ basis - centre[c]) / spread[c] + 3) / 6, 0, 1)
                cells = np.minimum((at + shifts[c]) / 1.5 * (1 << bits), (1 << bits) - 1).astype(np.int64)
                yield pa.record_batch(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_keys(cells, bits)), batch.column(0)], names=["curve", "key", "vec_id"]
                )

    return run


def _places(batches):
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        curve = batch.column(0).to_numpy()
        idx = np.empty(len(curve), np.int64)
        for c in np.unique(curve):
            rows = np.flatnonzero(curve == c)
            idx[rows] = seen.get(int(c), 0) + np.arange(len(rows))
            seen[int(c)] = seen.get(int(c), 0) + len(rows)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.full(len(curve), part, np.int32)), pa.array(idx)], names=["curve", "vec_id", "part", "idx"])


def _best(reach: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        rank, ids = table.column("rank").to_numpy(), table.column("vec_id").to_numpy()
        vec = _matrix(table.column("vec"), len(ids))
        q, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        x = x[np.argsort(ids[x], kind="stable")]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q) if len(x) else 0, 128):
            some = q[at : at + 128]
            s = vec[some] @ vec[x].T
            s[(np.abs(rank[some][:, None] - rank[x]) > reach) | (ids[some][:, None] == ids[x])] = -np.inf
            for row, i in zip(s, some, strict=True):
                if len(x) > k:
                    cut = -np.partition(-row, k - 1)[k - 1]
                    cut -= 1e-9 * (1 + abs(cut)) if np.isfinite(cut) else 0
                else:
                    cut = -np.inf
                near = np.flatnonzero((row >= cut) & np.isfinite(row))
                if not len(near):
                    continue
                exact = np.zeros(len(near))
                for d in range(vec.shape[1]):  # one order of adding, so equal vectors get equal scores
                    exact += vec[i, d] * vec[x[near], d]
                top = np.lexsort((ids[x[near]], -exact))[:k]
                out.append((np.full(len(top), ids[i]), ids[x[near[top]]], exact[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def _by_curves(
    rows: DataFrame, n: int, is_query, k: int, n_curves: int, dims: int, bits: int, window: float, block_rows: int, sample_rows: int, seed: int
) -> DataFrame:
    """query_id, vec_id and score of what the windows of all orderings hold of rows of one dimension, the k best of each block."""
    sample = common.least_hashes(rows, "vec_id", sample_rows).toArrow()
    x = _matrix(sample.column("vec"), sample.num_rows)
    bases = _curves(x.shape[1], n_curves, dims, seed)
    centre = [(x @ b).mean(axis=0) for b in bases]
    spread = [np.maximum((x @ b).std(axis=0), 1e-12) for b in bases]
    shifts = np.random.default_rng(seed + 1).random((n_curves, bases[0].shape[1])) / 2
    reach = max(2 * k, int(np.ceil(window * n)))

    keyed = rows.select("vec_id", "vec").mapInArrow(_keys(bases, centre, spread, shifts, bits), "curve int, key long, vec_id long")
    ordered = keyed.repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    places, _ = common.materialize(ordered.mapInArrow(_places, "curve int, vec_id long, part int, idx long"), "places")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = places.groupBy("curve", "part").agg(F.count("*").alias("n")).select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = places.join(F.broadcast(offsets), ["curve", "part"]).select("curve", "vec_id", (F.col("base") + F.col("idx")).alias("rank"))
    return _in_blocks(ranked.join(rows, "vec_id"), F.lit(n), reach, is_query, k, block_rows)


def _by_all(rows: DataFrame, is_query, k: int, block_rows: int) -> DataFrame:
    """The same from all rows of a query's dimension, for rows of rare dimensions."""
    d = F.size("vec").alias("curve")
    rank = F.row_number().over(Window.partitionBy(d).orderBy("vec_id")) - 1
    ranked = rows.select(d, "vec_id", "vec", rank.cast("long").alias("rank"))
    sizes = ranked.groupBy("curve").agg(F.count("*").alias("n"))
    return _in_blocks(ranked.join(sizes, "curve"), F.col("n"), 1 << 60, is_query, k, block_rows)


def _in_blocks(ranked: DataFrame, n, reach: int, is_query, k: int, block_rows: int) -> DataFrame:
    """Each query (of n rows of its curve) with the rows within reach of its rank, in groups of a block of rows and one of queries."""
    ask_rows = 20 * block_rows
    last = n.cast("long") - 1
    rank = F.col("rank").cast("long")
    near = F.least(F.lit(reach).cast("long"), last)
    block = lambda r, size: F.floor(F.least(F.greatest(r, F.lit(0).cast("long")), last) / size)
    own = ranked.select(
        "curve", block(rank, block_rows).alias("rb"), F.explode(F.sequence(block(rank - near, ask_rows), block(rank + near, ask_rows))).alias("qb"),
        F.lit(False).alias("asks"), rank.alias("rank"), "vec_id", "vec",
    )
    asks = ranked.where(is_query).select(
        "curve", F.explode(F.sequence(block(rank - near, block_rows), block(rank + near, block_rows))).alias("rb"), block(rank, ask_rows).alias("qb"),
        F.lit(True).alias("asks"), rank.alias("rank"), "vec_id", "vec",
    )
    return own.union(asks).groupBy("curve", "rb", "qb").applyInArrow(_best(reach, k), FOUND)


def nearest(
    vectors: DataFrame,
    is_query=None,
    k: int = K,
    n_curves: int = N_CURVES,
    dims: int = DIMS,
    bits: int = BITS,
    window: float = WINDOW,
    block_rows: int = BLOCK_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by largest inner product."""
    spark = vectors.sparkSession
    is_query = F.pmod(F.col("vec_id"), F.lit(20)) == 0 if is_query is None else is_query
    rows = valid_vectors(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("vec").alias("d")).count().where(F.col("count") >= max(2, COMMON * n)).orderBy(F.desc("count"), "d").collect()
    found = [_by_curves(rows.where(F.size("vec") == x["d"]), x["count"], is_query, k, n_curves, dims, bits, window, block_rows, sample_rows, seed) for x in sizes]
    if sum(x["count"] for x in sizes) < n:
        found.append(_by_all(rows.where(~F.size("vec").isin([x["d"] for x in sizes])), is_query, k, block_rows))
    merged = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))
