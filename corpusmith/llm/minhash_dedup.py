"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set: its distinct shingles of ``SIZE`` words (A-Z lower-cased, cut at ASCII
white space; fewer words: the whole sequence as one). Signature: ``PLACES`` minima of
independent hashes of the set, ``BITS`` bits of each. Two sets of similarity s differ in a
place with probability (1 - s) * (1 - 2^-BITS), so ``PLACES`` and the threshold give the
signature distance (places that differ) that a pair at the threshold exceeds with a
probability below ``MISS``: 33 of 96. The join loses no pair within that distance: places
are split into ``chunks`` so many that in one of them at most ``ERRORS`` differ (17 for 33
and one error), and a set is indexed under each chunk with each choice of so many places
left out. Whoever shares a key is a candidate.

Links of candidates are confirmed on full sets (64-bit hashes of shingles, so that two
shingles fall together with a probability of 2^-64). Not all pairs of a bucket are made:
every set is compared with its bucket's least one, and union-find joins what is near. In
buckets that still have several components, sets are compared with another head, ``TURNS``
times, so that most of a large family falls together at little cost. Then only sets outside of a bucket's largest component are compared with the rest of it, in
blocks of ``BLOCK``: where links abound few are left, and no link between components is
lost. In a block, signature distances come first, each pair is looked at in the first bucket
that it shares alone, and links are handed on as a forest. So components are those of all
pairs within the distance.

Scale: equal sets fall together before the join. A set has a fixed number of keys (96).
Buckets are counted with partial sums, members meet their head by a join that may be split,
and full sets are made only of those that pass the signatures; blocks are bounded.

Cases: a null, empty or blank text has no shingles and is linked with nothing; rows that
repeat a doc_id get one row each; a null doc_id gets the least doc_id of its component, null
if that has none (and isn't kept); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import common

SIZE = 5
THRESHOLD = 85  # per cent
PLACES, BITS, ERRORS = 96, 16, 1
MISS = 1e-6
TURNS = 3  # of other heads
BLOCK = 2048  # sets that are compared pair by pair
AT_ONCE = 1 << 15  # shingles that are hashed at a time
PAIRS_AT_ONCE = 1 << 13
MAX_WORDS = 200_000  # in a worker's cache
WAYS = 1 << 10  # ways to leave out places of a chunk, at most; the low bits of a key name its way
PRIME = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """Hash of each word (bytes), made when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = self[word] = xxh64_intdigest(word, 11)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: list[str | None], size: int, words: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and their numbers."""
    from xxhash import xxh64_intdigest

    listed = [(t or "").encode().lower().split() for t in texts]  # bytes: A-Z alone, and exactly \x20 \x09-\x0D
    n = np.fromiter(map(len, listed), np.int64, len(listed))
    flat = np.fromiter((h for x in listed for h in map(words.__getitem__, x)), np.uint64, int(n.sum()))
    if len(words) > MAX_WORDS:
        words.clear()
    rolled = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(PRIME) + flat[k : k + len(rolled)]
    rolled = _mixed(rolled)
    ends = np.cumsum(n)
    parts = []
    for x, k, at in zip(listed, n.tolist(), (ends - n).tolist(), strict=True):
        if k >= size:
            part = np.sort(rolled[at : at + k - size + 1])
            parts.append(part[np.r_[True, part[1:] != part[:-1]]])
        else:
            parts.append(np.array([xxh64_intdigest(b" ".join(x), 13)] if k else [], np.uint64))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.fromiter(map(len, parts), np.int64, len(parts))


def _seeds(places: int) -> np.ndarray:
    return _mixed((np.arange(1, 3 * places + 1, dtype=np.uint64)) * np.uint64(PRIME)).astype(np.uint32).reshape(3, places) | np.uint32(1)


def signatures(flat: np.ndarray, n: np.ndarray, places: int = PLACES) -> np.ndarray:
    """BITS bits of each of the minima, a row for each set; sets without shingles have no meaning."""
    out = np.full((len(n), places), 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(len(n)), n)
    low = flat.astype(np.uint32)
    xor, one, two = _seeds(places)
    for at in range(0, len(flat), AT_ONCE):
        x, of = low[at : at + AT_ONCE], owner[at : at + AT_ONCE]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        rows = of[starts]
        for k in range(places):
            h = (x ^ xor[k]) * one[k]
            h ^= h >> np.uint32(15)
            h *= two[k]
            out[rows, k] = np.minimum(out[rows, k], np.minimum.reduceat(h, starts))
    return (out & np.uint32((1 << BITS) - 1)).astype(np.uint16)


def least_distance(places: int = PLACES, threshold: int = THRESHOLD, miss: float = MISS) -> int:
    """Signature distance that a pair at the threshold exceeds with a probability below miss."""
    p = (1 - threshold / 100) * (1 - 2.0**-BITS)
    tail, t = 1.0, -1
    while tail >= miss:
        t += 1
        tail -= comb(places, t) * p**t * (1 - p) ** (places - t)
    return t


def chunks(places: int, distance: int, errors: int = ERRORS) -> list[tuple[int, int]]:
    """Ranges of places; sets within the distance differ in at most ``errors`` places of one of them."""
    count = distance // (errors + 1) + 1
    edges = [places * k // count for k in range(count + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def masks(places: int, distance: int, errors: int = ERRORS) -> list[tuple[int, list[int]]]:
    """(chunk, places that count) for each way to leave out as many places of a chunk as may differ."""
    from itertools import combinations

    return [(c, [k for k in range(a, b) if k not in out]) for c, (a, b) in enumerate(chunks(places, distance, errors)) for out in combinations(range(a, b), errors)]


def _sets(size: int, signed: bool):
    """doc_id, n, hi, lo and the signature or the full set of each text."""
    words = _Hashes()

    def run(batches):
        from xxhash import xxh128_digest

        for batch in common.slices(batches, 256):
            flat, n = shingle_sets(batch.column(1).to_pylist(), size, words)
            ends = np.cumsum(n)
            raw = [flat[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            keys = np.frombuffer(b"".join(map(xxh128_digest, raw)), np.int64).reshape(-1, 2)
            what = [r.tobytes() for r in signatures(flat, n)] if signed else raw
            cols = [batch.column(0), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(what, pa.binary())]
            yield pa.record_batch(cols, names=["doc_id", "n", "hi", "lo", "body"])

    return common.tidied(run, words)


def sets_of(docs: DataFrame, size: int, signed: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(_sets(size, signed), "doc_id long, n long, hi long, lo long, body binary")


def _keys(ways: list[tuple[int, list[int]]]):
    def run(batches):
        for batch in common.slices(batches, 1024):
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(np.uint64)
            out = np.empty((batch.num_rows, len(ways)), np.uint64)
            for w, (_, places) in enumerate(ways):
                key = np.zeros(batch.num_rows, np.uint64)
                for k in places:
                    key = _mixed(key * np.uint64(PRIME) ^ sig[:, k])
                out[:, w] = key * np.uint64(WAYS) + np.uint64(w)
            ids = np.repeat(batch.column(0).to_numpy(), len(ways))
            yield pa.record_batch([pa.array(out.view(np.int64).ravel()), pa.array(ids)], names=["g", "id"])

    return run


def buckets(reps: DataFrame, ways: list) -> DataFrame:
    """g, id, head and n of each bucket that sets share."""
    rows = reps.select("id", "body").mapInArrow(_keys(ways), "g long, id long")
    heads = rows.groupBy("g").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    return rows.join(heads.hint("shuffle_hash"), "g")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _within(distance: int):
    def run(batches):
        for batch in common.slices(batches, 2048):
            near = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(axis=1) <= distance
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return run


def near_by_signature(pairs: DataFrame, reps: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) whose signatures are within the distance."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("body").alias(f"{c}_sig"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sig", "b_sig").mapInArrow(_within(distance), "a long, b long")


def _is_near(x: bytes, y: bytes, threshold: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _confirmed(threshold: int):
    def run(batches):
        for batch in common.slices(batches, 256):
            near = [_is_near(x, y, threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    side = lambda c: members.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("full").alias(f"{c}_full"))
    sizes = F.expr(f"100 * least(a_n, b_n) >= {threshold} * greatest(a_n, b_n)")
    both = pairs.join(side("a").drop("a_full"), "a").join(side("b").drop("b_full"), "b").where(sizes).select("a", "b")
    both = both.join(side("a").drop("a_n"), "a").join(side("b").drop("b_n"), "b")
    return both.select("a", "b", "a_full", "b_full").mapInArrow(_confirmed(threshold), "a long, b long")


def open_rows(shared: DataFrame, found: DataFrame) -> DataFrame:
    """g, id, component of the buckets of several components, and each bucket's n, most and largest (component).

    A bucket of two sets is its head pair, which has been compared.
    """
    rows = shared.where("n > 2").select("g", "id").join(found, F.col("id") == F.col("node"), "left").select("g", "id", F.coalesce("component", "id").alias("component"))
    counts = rows.groupBy("g", "component").agg(F.count("*").alias("size"))
    largest = F.max_by("component", F.struct("size", -F.col("component")))
    of = counts.groupBy("g").agg(F.sum("size").alias("n"), F.max("size").alias("most"), F.count("*").alias("parts"), largest.alias("largest"))
    return rows.join(of.where("parts > 1").drop("parts"), "g")


def other_heads(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of different components: each set and another head of one of its buckets, a large one."""
    heads = rows.groupBy("g").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", "g", F.lit(turn))).alias("h"))
    large = F.max_by("g", F.struct(F.log2("n").cast("int"), F.xxhash64("g", F.lit(turn))))
    pairs = rows.groupBy("id", "component").agg(large.alias("g")).join(heads, "g").where(F.col("component") != F.col("h.component"))
    return pairs.select(F.greatest("id", "h.id").alias("a"), F.least("id", "h.id").alias("b")).distinct()


def open_blocks(rows: DataFrame) -> DataFrame:
    """g, i, j, side, id and component: sets outside of their bucket's largest component (side 0) against the bucket (side 1), in blocks."""
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    rows = rows.select("g", "id", "component", "largest", blocks(F.col("n") - F.col("most")).alias("bi"), blocks(F.col("n")).alias("bj"))
    place = lambda c: F.pmod(F.xxhash64("id", "g"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    opened = rows.where("component <> largest").select("g", place("bi").alias("i"), every("bj").alias("j"), F.lit(0).alias("side"), "id", "component")
    return opened.union(rows.select("g", every("bi").alias("i"), place("bj").alias("j"), F.lit(1).alias("side"), "id", "component"))


def _candidates(g: int, x: dict, y: dict, ways: list, distance: int):
    """Index pairs within the distance, of different components, whose first shared bucket is g."""
    places = x["sig"].shape[1]
    edges = [a for a, _ in chunks(places, distance)]
    own = ways[g & WAYS - 1][0]
    first_way = next(w for w, (c, _) in enumerate(ways) if c == own)
    step = max(1, PAIRS_AT_ONCE // max(1, len(y["sig"])))
    for at in range(0, len(x["sig"]), step):
        differ = x["sig"][at : at + step, None] != y["sig"][None]
        near = (differ.sum(axis=2) <= distance) & (x["component"][at : at + step, None] != y["component"][None])
        i, k = np.nonzero(near)
        differ = differ[i, k]
        chunk = np.argmax(np.add.reduceat(differ, edges, axis=1, dtype=np.int16) <= ERRORS, axis=1) if len(i) else i
        i, k, differ = (v[chunk == own] for v in (i, k, differ))
        way = np.full(len(i), -1)
        for w in range(len(ways) - 1, first_way - 1, -1):
            if ways[w][0] == own:
                way[~differ[:, ways[w][1]].any(axis=1)] = w
        yield from zip((at + i[way == (g & WAYS - 1)]).tolist(), k[way == (g & WAYS - 1)].tolist(), strict=True)


def _sides(rows: pa.Table, *more: str) -> list[dict]:
    out = []
    for side in (0, 1):
        part = rows.filter(pc.equal(rows.column("side"), side))
        one = {c: part.column(c).to_numpy() for c in ("id", "component")} | {"sig": _matrix(part.column("body"))}
        out.append(one | {c: part.column(c).to_pylist() for c in more})
    return out


def _open(ways: list, distance: int):
    """Of a block, the sets that have a candidate."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        g, i, j = (k.as_py() for k in key)
        x, y = _sides(rows)
        found = np.array(list(_candidates(g, x, y, ways, distance)), np.int64).reshape(-1, 2)
        ids = [one["id"][np.unique(found[:, k])] for k, one in enumerate((x, y))]
        n = len(ids[0]) + len(ids[1])
        side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        cols = [pa.array([g] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(side, pa.int32()), pa.array(np.concatenate(ids), pa.int64())]
        return pa.table(cols, names=["g", "i", "j", "side", "id"])

    return run


def _linked(ways: list, distance: int, threshold: int):
    """Of a block of full sets, links that join what all its links join."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x, y = _sides(rows, "full")
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        links = []
        for a, b in _candidates(key[0].as_py(), x, y, ways, distance):
            one, two = root(int(x["component"][a])), root(int(y["component"][b]))
            if one != two and _is_near(x["full"][a], y["full"][b], threshold):
                parent[max(one, two)] = min(one, two)
                links.append((int(x["id"][a]), int(y["id"][b])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def open_links(shared: DataFrame, found: DataFrame, members: DataFrame, ways: list, distance: int, threshold: int) -> DataFrame:
    """Links between components that the head pairs have left apart."""
    blocks = open_blocks(open_rows(shared, found))
    some = blocks.join(members.select("id", "body"), "id").groupBy("g", "i", "j").applyInArrow(_open(ways, distance), "g long, i int, j int, side int, id long")
    some, _ = common.materialize(some, "open")
    rows = some.join(members, "id").join(found, F.col("id") == F.col("node"), "left").select("g", "i", "j", "side", "id", F.coalesce("component", "id").alias("component"), "body", "full")
    return rows.groupBy("g", "i", "j").applyInArrow(_linked(ways, distance, threshold), "a long, b long")


def components(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable) of each row."""
    spark = docs.sparkSession
    distance = least_distance(PLACES, threshold)
    ways = masks(PLACES, distance)
    prints, _ = common.materialize(sets_of(docs, size, True), "prints")
    total = prints.count()
    reps = prints.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("body").alias("body"))
    reps, reps_path = common.materialize(reps.withColumn("id", F.monotonically_increasing_id()), "distinct", total)
    shared, shared_path = common.materialize(buckets(reps, ways), "buckets", total)
    # From here on, only sets that share a bucket matter; their full sets are made from their documents.
    some = reps.join(shared.select("id").distinct(), "id", "left_semi")
    known = some.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    full = sets_of(texts, size, False).groupBy("hi", "lo").agg(F.first("body").alias("full"))
    members, members_path = common.materialize(some.join(full, ["hi", "lo"]).select("id", "n", "body", "full"), "members", total)
    heads = shared.where("id > head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    pairs, pairs_path = common.materialize(near_by_signature(heads, members, distance), "pairs", total)
    links, links_path = common.materialize(confirmed(pairs, members, threshold), "links", total)
    found = common.connected_components(links, rows=total)
    joined = lambda more: common.connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), rows=total)
    for turn in range(TURNS):
        some_pairs = near_by_signature(other_heads(open_rows(shared, found), turn), members, distance)
        more, more_path = common.materialize(confirmed(some_pairs, members, threshold), "links", total)
        met = not more.isEmpty()
        found = joined(more) if met else found
        common.drop_path(spark, more_path)
        if not met:
            break
    more, more_path = common.materialize(open_links(shared, found, members, ways, distance, threshold), "links", total)
    if not more.isEmpty():
        found = joined(more)
    merged, merged_path = common.materialize(found.join(reps, F.col("node") == F.col("id")).select("hi", "lo", "component", "rep"), "components", total)
    least = merged.groupBy("component").agg(F.min("rep").alias("least"))
    linked = merged.join(least, "component").select("hi", "lo", "least")
    labels, _ = common.materialize(reps.join(linked, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("least", "rep").alias("component_id")), "labels", total)
    for path in (reps_path, shared_path, members_path, pairs_path, links_path, more_path, merged_path):
        common.drop_path(spark, path)
    own = prints.where("n > 0").join(labels, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return common.few(own.union(prints.where("n = 0").select("doc_id", "n", "doc_id")), total)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(common.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= {THRESHOLD} * (x.n + y.n - m)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(node) AS component_id, n.doc_id = min(node) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
