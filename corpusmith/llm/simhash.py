"""SimHash near-duplicates by a binary trie self-join.

Fingerprint: ASCII-lower-cased words, word shingles with repeats, XXH64 of each (seed 42);
a bit is 1 if set in over half the hashes. No words: fingerprint zero.

Links are all pairs of distinct fingerprints at ``budget`` or fewer differing bits, found by
a self-join of their binary trie: node pairs are walked together from the root, differing
bits are added up, and a pair is dropped once they exceed the budget. Spark deals the
fingerprints to subtries: of budget + 1 blocks of bits, a pair agrees in one at least, so each
fingerprint goes to one bucket a block, that of the block's leading bits, as many as give
buckets of about ``node_rows``. A bucket that is larger than twice that is dealt anew by the
whole block, then by budget + 1 blocks of the bits left, and so on: distinct fingerprints
that agree in all but 13 bits fill no large bucket. Buckets return a spanning forest of
their links, not all pairs; distributed union-find joins the forests.

Scale: copies fall together before the join (a fingerprint is taken once), so a group of
copies costs one row. Each fingerprint is dealt budget + 1 times, and so often again where its
bucket is large. Nothing is broadcast.

Cases: a null text is empty; texts without words are linked to each other and to whatever
fingerprint lies near zero; rows that repeat a doc_id get one row each; a null doc_id gets
the least doc_id of its component, null if that has none; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import common

SHINGLE_WORDS = 3
BUDGET = 2
NODE_ROWS = 4096


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(size: int):
    def run(batches):
        for batch in common.slices(batches, 1024):
            fps = np.array([fingerprint(x, size) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return common.tidied(run)


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(
        _fingerprints(size), "doc_id long, fp long"
    )


def _pairs_within(x: np.ndarray, y: np.ndarray, same: bool, first_bit: int, spent: int, budget: int, frontier: int = 1 << 15):
    """Index pairs (i, j) of sorted distinct x and y within the budget, by walking both tries together.

    All of x share their first first_bit bits, as do all of y; these differ in ``spent`` bits.
    same: x is y, and a pair counts once. A node is a range of the sorted array. Yields arrays
    of at most about ``frontier`` pairs.
    """
    if not len(x) or not len(y):
        return
    todo = [(first_bit, np.array([[0, len(x), 0, len(y), spent]], np.int64))]
    one = np.uint64(1)
    while todo:
        depth, f = todo.pop()
        if len(f) > frontier:
            half = len(f) // 2
            todo += [(depth, f[:half]), (depth, f[half:])]
            continue
        area = (f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2])
        leaf = (area <= 32) | (depth >= 64)
        small, f = f[leaf], f[~leaf]
        if len(small):
            area = area[leaf]
            width = small[:, 3] - small[:, 2]
            which = np.repeat(np.arange(len(small)), area)
            k = np.arange(len(which)) - np.repeat(np.cumsum(area) - area, area)
            i, j = small[which, 0] + k // width[which], small[which, 2] + k % width[which]
            near = np.bitwise_count(x[i] ^ y[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if not len(f):
            continue
        # The first row of each node whose bit at this depth is 1.
        shift = np.uint64(63 - depth)
        mids = []
        for lo, hi, v in ((f[:, 0], f[:, 1], x), (f[:, 2], f[:, 3], y)):
            goal = (((v[lo] >> shift) >> one << one) | one) << shift  # the node's prefix, then a 1
            mids.append(np.clip(np.searchsorted(v, goal), lo, hi))
        m, w = mids
        a0, a1, b0, b1, e = f.T
        nxt = [
            np.stack([a0, m, b0, w, e], 1),
            np.stack([m, a1, w, b1, e], 1),
            np.stack([a0, m, w, b1, e + 1], 1),
        ]
        other = np.stack([m, a1, b0, w, e + 1], 1)
        if same:  # (1, 0) below one node mirrors (0, 1)
            other = other[~((a0 == b0) & (a1 == b1))]
        f = np.concatenate([*nxt, other])
        f = f[(f[:, 0] < f[:, 1]) & (f[:, 2] < f[:, 3]) & (f[:, 4] <= budget)]
        if len(f):
            todo.append((depth + 1, f))


def _forest(n: int, links) -> list[tuple[int, int]]:
    """Links that join different trees, in union-find over n items."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in links:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def _parts(mask: int, parts: int) -> list[int]:
    """mask's bits, from the top, cut into so many masks of about equal size."""
    bits = [b for b in range(63, -1, -1) if mask >> b & 1]
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, ways: list[list[tuple[int, int]]]) -> DataFrame:
    """rows (g, way, fp) in the buckets that each way leads to: g of what the fingerprint has under a mask, and the next way."""
    target = lambda way, mask: F.struct(F.lit(way).alias("way"), F.lit(_signed(mask)).alias("mask"))
    to = F.get(F.array(*(F.array(*(target(*x) for x in xs)) for xs in ways)), F.col("way"))
    rows = rows.select("g", "fp", F.explode(to).alias("t"))
    return rows.select(F.xxhash64("g", "t.way", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("g"), "t.way", "fp")


def _walk(firsts: list[int], budget: int):
    """The walk of one bucket. Its way names the first of the bits that its fingerprints share; these are turned to the top."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        up, down = np.uint64(firsts[key[1].as_py()]), np.uint64(-firsts[key[1].as_py()] % 64)
        fp = rows.column("fp").to_numpy().view(np.uint64)
        fp = np.sort(fp << up | fp >> down) if up else np.sort(fp)
        forest = np.array(_forest(len(fp), _pairs_within(fp, fp, True, 0, 0, budget)), np.int64).reshape(-1, 2)
        signed = (fp >> up | fp << down if up else fp).view(np.int64)
        return pa.table({"a": pa.array(signed[forest[:, 0]], pa.int64()), "b": pa.array(signed[forest[:, 1]], pa.int64())})

    return run


def near_links(distinct: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs within the budget do. distinct: fp, each once, a written table."""
    n = distinct.count()
    limit = max(2 * node_rows, 1 << budget + 1)  # blocks of a larger bucket have a bit each at least
    bits = max(0, (n - 1) // node_rows).bit_length()
    blocks = _parts((1 << 64) - 1, budget + 1)
    firsts = [64 - x.bit_length() for x in blocks]  # of each way; later ways keep that of the block they come from
    fixed = [((1 << min(bits, x.bit_count())) - 1) << x.bit_length() - min(bits, x.bit_count()) for x in blocks]
    rows = _dealt(distinct.select(F.lit(0).alias("g"), F.lit(0).alias("way"), "fp"), [list(enumerate(fixed))])
    known = len(fixed)
    begin, links = 0, None
    while True:
        sizes = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        kept, _ = common.materialize(rows.join(sizes.hint("shuffle_hash"), "g"), "cells", n)
        small = kept.where(F.col("n") <= limit).groupBy("g", "way").applyInArrow(_walk(list(firsts), budget), "a long, b long")
        links = small if links is None else links.union(small)
        big = kept.where(F.col("n") > limit)
        if big.isEmpty():
            return links
        # Large buckets: the rest of the block first, then blocks of the bits that aren't fixed yet.
        ways: list[list[tuple[int, int]]] = [[] for _ in range(known)]
        for way in range(begin, known):
            block = blocks[way] if begin == 0 else 0
            more = [block] if block & ~fixed[way] else _parts(~fixed[way] & (1 << 64) - 1, budget + 1)
            for mask in more:
                ways[way].append((len(fixed), mask))
                fixed.append(fixed[way] | mask)
                firsts.append(firsts[way])
        rows, begin, known = _dealt(big.select("g", "way", "fp"), ways), known, len(fixed)


def components(docs: DataFrame, size: int = SHINGLE_WORDS, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of each row."""
    prints, _ = common.materialize(fingerprints(docs, size), "fingerprints")
    n = prints.count()
    reps, reps_path = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct", n)
    joined = common.connected_components(near_links(reps, budget), rows=n)
    merged, merged_path = common.materialize(joined.join(reps, joined.node == reps.fp).select("fp", "component", "rep"), "components", n)
    least = merged.groupBy("component").agg(F.min("rep").alias("least"))
    found = merged.join(least, "component").select("fp", "least")
    labels, _ = common.materialize(reps.join(found, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "labels", n)
    for path in (reps_path, merged_path):
        common.drop_path(docs.sparkSession, path)
    return common.few(prints.join(labels, "fp").select("doc_id", "fp", "component_id"), n)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS, budget: int = BUDGET) -> DataFrame:
    """docs with one row of each component: the row of its smallest doc_id. Rows without doc_id stay."""
    found = components(docs, size, budget)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    # The rows travel as one struct, so that no column of theirs can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    kept = rows.join(keep, F.col("d.doc_id") == F.col("kept_id"), "left_semi")
    return kept.union(rows.where("d.doc_id is null")).select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))
