"""Attention by mergeable softmax states, without a row for any pair of query and key.

Keys lie in tiles. A tile gives each query a state of its own: for each head the greatest
logit, the sum of the weights under it, the part of that sum that falls on memory keys, and
the weighted sum of values. Two states of one query combine into one, so partial results meet
like those of any aggregate; the output and the memory's share of the attention are read off
the last state. Heads may share keys and values (grouped queries).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a tile, and queries of the block that meets it. What is shuffled falls with both: a key goes to each block of its group, a query and its states to each tile.
TILE, QUERIES = 8192, 8192
KEYS_AT_ONCE, QUERIES_AT_ONCE = 1024, 256  # whose logits are held at a time
FAN = 32  # states that are combined at a time

STATE = "struct<top:array<double>,mass:array<double>,memory:array<double>,value:array<array<double>>>"


F64 = pa.list_(pa.float64())
ARROW_STATE = pa.struct([("top", F64), ("mass", F64), ("memory", F64), ("value", pa.list_(F64))])


def _matrix(column: pa.ChunkedArray, heads: int) -> np.ndarray:
    """(heads, rows, width) of a column of vectors."""
    flat = pc.list_flatten(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    rows = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), heads, -1)
    return rows.transpose(1, 0, 2)


def _ends(rows: int, width: int) -> pa.Array:
    return pa.array(np.arange(rows + 1, dtype=np.int32) * width)


def _lists(v: np.ndarray) -> pa.Array:
    """A list for each row of v."""
    return pa.ListArray.from_arrays(_ends(*v.shape), pa.array(np.ascontiguousarray(v).reshape(-1)))


def _states(heads: int, kv_heads: int, causal: bool):
    def run(rows: pa.Table) -> pa.Table:
        q, k = (rows.filter(pc.equal(rows.column("is_key"), x)) for x in (False, True))
        if not len(q) or not len(k):  # places are hashed, so a tile may be empty
            return q.select(["grp", "id", "tile"]).slice(0, 0).append_column("state", pa.array([], ARROW_STATE))
        query, key, value = _matrix(q.column("vec"), heads), _matrix(k.column("vec"), kv_heads), _matrix(k.column("value"), kv_heads)
        share, n = heads // kv_heads, len(q)
        top = np.full((heads, n), -np.inf)
        mass, memory, sums = np.zeros((heads, n)), np.zeros((heads, n)), np.zeros((heads, n, value.shape[2]))
        pos_q, pos_k = q.column("pos").to_numpy(), k.column("pos").to_numpy()
        of_memory = np.asarray(k.column("memory").to_numpy(zero_copy_only=False), np.float64)
        for a in range(0, n, QUERIES_AT_ONCE):
            for b in range(0, len(k), KEYS_AT_ONCE):
                x, y = slice(a, a + QUERIES_AT_ONCE), slice(b, b + KEYS_AT_ONCE)
                logits = np.stack([query[h, x] @ key[h // share, y].T for h in range(heads)]) / np.sqrt(query.shape[2])
                if causal:
                    logits = np.where((pos_k[None, y] > pos_q[x, None])[None], -np.inf, logits)
                new = np.maximum(top[:, x], logits.max(axis=2))
                base = np.where(np.isfinite(new), new, 0)
                old, weights = np.exp(top[:, x] - base), np.exp(logits - base[:, :, None])
                mass[:, x] = mass[:, x] * old + weights.sum(axis=2)
                memory[:, x] = memory[:, x] * old + weights @ of_memory[y]
                sums[:, x] = sums[:, x] * old[:, :, None] + np.stack([weights[h] @ value[h // share, y] for h in range(heads)])
                top[:, x] = new
        seen = np.isfinite(top).any(axis=0)
        lists = lambda v: _lists(v[:, seen].T)
        values = _lists(sums[:, seen].transpose(1, 0, 2).reshape(-1, sums.shape[2]))
        state = pa.StructArray.from_arrays([lists(top), lists(mass), lists(memory), pa.ListArray.from_arrays(_ends(int(seen.sum()), heads), values)], fields=list(ARROW_STATE))
        cols = {"grp": q.column("grp"), "id": q.column("id"), "tile": q.column("tile")}
        kept = {c: v.filter(pa.array(seen)) for c, v in cols.items()}
        return pa.table({**kept, "state": state})

    return run


def combined(a: Column, b: Column) -> Column:
    """Two states of one query as one."""

    def at(h: Column) -> Column:
        top = F.greatest(F.get(a["top"], h), F.get(b["top"], h))
        # the head's factors are bound to a lambda's variable, or they would be worked out once a component
        factors = F.struct(F.exp(F.get(a["top"], h) - top).alias("x"), F.exp(F.get(b["top"], h) - top).alias("y"), top.alias("top"))

        def head(s: Column) -> Column:
            both = lambda c: F.get(a[c], h) * s["x"] + F.get(b[c], h) * s["y"]
            value = F.zip_with(F.get(a["value"], h), F.get(b["value"], h), lambda x, y: x * s["x"] + y * s["y"])
            return F.struct(s["top"].alias("top"), both("mass").alias("mass"), both("memory").alias("memory"), value.alias("value"))

        return F.transform(F.array(factors), head)[0]

    heads = F.transform(F.sequence(F.lit(0), F.size(a["top"]) - 1), at)
    part = lambda hs, c: F.transform(hs, lambda x: x[c]).alias(c)
    return F.transform(F.array(heads), lambda hs: F.struct(*(part(hs, c) for c in ("top", "mass", "memory", "value"))))[0]


def merged(states: DataFrame, *by: str) -> DataFrame:
    """One state for each value of by."""
    listed = states.groupBy(*by).agg(F.collect_list("state").alias("s"))
    return listed.select(*by, F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", 0), combined).alias("state"))


def attention(queries: DataFrame, keys: DataFrame, heads: int = 1, kv_heads: int = 1, causal: bool = False, tile: int = TILE) -> DataFrame:
    """grp, id, out (a vector a head) and memory_share (a number a head) of each query that has a key.

    queries: grp, id, pos, vec (heads * width numbers). keys: grp, id, pos, vec and value (kv_heads *
    width numbers each), memory (whether a key is one of the memory's). A query attends to the keys
    of its grp, if causal to those at its pos or before. Each query is dealt to its grp's tiles,
    each key to its grp's blocks of queries; only states are shuffled after that.
    """
    if heads % kv_heads:
        raise ValueError("heads must be a multiple of kv_heads")
    count = lambda df, size, name: df.groupBy("grp").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = count(keys, tile, "tiles").join(count(queries, QUERIES, "blocks"), "grp")
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None)  # vectors travel in their own type and are made double where they are multiplied
    q = queries.join(sizes, "grp").select("grp", "id", "pos", "vec", none.cast(keys.schema["value"].dataType).alias("value"), none.cast("boolean").alias("memory"), place("blocks").alias("block"), every("tiles").alias("tile"), F.lit(False).alias("is_key"))
    k = keys.join(sizes, "grp").select("grp", "id", "pos", "vec", "value", F.coalesce("memory", F.lit(False)).alias("memory"), every("blocks").alias("block"), place("tiles").alias("tile"), F.lit(True).alias("is_key"))
    kind = lambda c: queries.schema[c].dataType.simpleString()
    rows = q.union(k).repartition("grp", "block", "tile")
    states = rows.groupBy("grp", "block", "tile").applyInArrow(_states(heads, kv_heads, causal), f"grp {kind('grp')}, id {kind('id')}, tile int, state {STATE}")
    some = merged(states.withColumn("tile", F.floor(F.col("tile") / FAN)), "grp", "id", "tile")
    last = merged(some, "grp", "id")
    mass = F.col("state.mass")
    out = F.zip_with("state.value", mass, lambda v, m: F.transform(v, lambda x: x / m))
    return last.select("grp", "id", out.alias("out"), F.zip_with("state.memory", mass, lambda r, m: r / m).alias("memory_share"))
