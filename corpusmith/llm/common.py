"""Shared helpers: reading tables, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_TASK, EDGES_A_TASK = 20_000, 100_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir. One of our own only on a single machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="corpusmith-"))
    return f"file://{_OWN_SCRATCH[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/corpusmith-{uuid.uuid4().hex}-{name}"


def few(df: DataFrame, rows: int, per_task: int = ROWS_A_TASK) -> DataFrame:
    """df, of about so many rows, made by no more tasks than have per_task rows each.

    Only small tables are affected: they would else be written as a file for each shuffle
    partition. Beyond shuffle.partitions * per_task rows df stays as it is.
    """
    n = max(1, -(-rows // per_task))
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def materialize(df: DataFrame, name: str, rows: int | None = None, per_task: int = ROWS_A_TASK, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors.

    The write's own shuffle files are removed when it ends; nothing else can read them.
    rows: about how many rows it has, where that is known (see few). compression: zstd suits tables of texts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df if rows is None else few(df, rows, per_task)).write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Distributed union-find over edges(a long, b long): (node, component) for each node of an edge.

    component is the smallest node id reachable. Alternates large-star and small-star
    contraction until no edge changes; each round is written to the shared folder, so
    lineage stays short. DataFrame operations only. An empty input gives an empty result.
    rows: about how many edges there are, where that is known.
    Self-loops and repeated edges are harmless; edges with a null end are ignored.
    """
    spark = edges.sparkSession
    cur, path = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", rows, EDGES_A_TASK
    )
    old = None
    for _ in range(max_rounds):
        n, mark = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or old == (n, mark):
            break
        old = (n, mark)
        # Large star: every neighbour above u hangs onto the least of u's closed neighbourhood.
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its lesser neighbours hang onto the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt, nxt_path = materialize(small, "edges", 2 * n, EDGES_A_TASK)
        drop_path(spark, path)
        cur, path = nxt, nxt_path
    else:
        raise RuntimeError("connected components did not converge")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def least_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of the least hashes of key; ties by key.

    A bound on the hash, from the count of rows, leaves about twice as many before they are
    sorted, so that each task hands on its share alone.
    """
    h = F.xxhash64(key)
    n = rows.count()
    if n > 4 * most:
        rows = rows.where(h < -(1 << 63) + int((1 << 64) * 2 * most / n))
    return rows.orderBy(h, key).limit(most)


def tidied(run, *caches):
    """run(batches), after which caches are emptied and freed memory goes back to the system.

    Python workers outlive a task; what an idle one keeps, the next stage lacks.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for c in caches:
                c.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(batches, rows: int = 512):
    """Arrow batches cut into smaller ones, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
