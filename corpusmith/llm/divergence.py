"""Source divergence audit: how the word use of a language's sources differs.

Null texts, languages and sources read as ''. Terms are runs of letters (A-Z lower-cased)
and characters beyond ASCII; a language keeps the terms of at least ``MIN_DOCS`` of its
documents. A group (lang, source) and a language give a kept term of ``count`` occurrences
there the scaled probability p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)); two
probabilities differ by f = floor((p - q)^2 / (p + q)). All arithmetic is in integers.

Terms (the k that stand out most in a group, against its language): upper-bound search. A
group's terms of one count form a bucket; all have the same p, and f falls as q rises, so
f(p, least q) bounds the bucket. The best buckets that hold k candidates are evaluated
first; their kth value leaves only unseen buckets whose bound is not strictly below it.
These are evaluated next, after which the kth value can only rise: the search is over.

Pairs (each two sources of a language, over all kept terms): postings. Where two groups both
have a term, its postings give f(p, q) less what the rest of the sum supposes of it; that
rest takes each group's buckets against the other's probability of an absent term.
Postings are dealt by term to numpy in Arrow batches, and only sums a pair leave a task.

Scale: words are counted in the tasks that read them; what is shuffled is a row for a term of
a group and part of the input. A term's postings are one row a source, and there are as many
pairs of sources as the result has rows. No table is broadcast by hint.

Cases: groups and languages without kept terms have pairs of value 0 and no terms; ties go to
the lesser item in UTF-8; repeated rows count as often as they stand; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.llm import common

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
MAX_ENTRIES = 200_000  # terms that a task counts before it hands them on
PIECE = 1 << 20  # bytes of a text that are split at a time
POSTINGS_A_BLOCK = 20_000
PAIRS_AT_ONCE = 1 << 19

#: Bytes that are no part of a term become blanks, A-Z lower case; bytes from 0x80 on are parts of characters beyond ASCII.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str | None):
    """Lists of a text's terms (UTF-8), a bounded piece of it at a time."""
    raw = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _count(batches):
    counts: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        cols = [], [], [], [], []
        for (lang, source), (n, docs) in counts.items():
            for col, more in zip(cols, ([lang] * (len(n) + 1), [source] * (len(n) + 1), [None, *n], [0, *n.values()], [0, *(docs[t] for t in n)]), strict=True):
                col.extend(more)
        counts.clear()
        kinds = pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        table = pa.table([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], names=["lang", "source", "term", "n", "docs"])
        yield from table.to_batches(10_000)

    for batch in common.slices(batches, 256):
        for text, lang, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in terms_of(text):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in counts.values()) > MAX_ENTRIES:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it), and a row without term for each group."""
    rows = docs.select(*(common.text_or_empty(c).alias(c) for c in ("text", "lang", "source")))
    parts = rows.mapInArrow(common.tidied(_count), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, kept: str) -> Column:
    """Scaled probability of a term of n occurrences, exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({total} + 2 * {kept} as decimal(20,0))")


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def first_items(buckets: DataFrame, k: int) -> DataFrame:
    """The best buckets of each group that hold k candidates together."""
    best = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumn("before", F.coalesce(F.sum("size").over(best), F.lit(0))).where(F.col("before") < k).drop("before")


def top_terms(postings: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value and rank of the k terms of each group that stand out most. postings: written, with p and q."""
    over = postings.where("p > q")
    buckets = over.groupBy("lang", "source", "n").agg(F.min("q").alias("least"), F.count("*").alias("size"), F.first("p").alias("p"))
    buckets, path = common.materialize(buckets.select("lang", "source", "n", "size", difference("p", "least").alias("bound")), "buckets")
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(some: DataFrame) -> DataFrame:
        rows = over.join(some.select("lang", "source", "n"), ["lang", "source", "n"]).select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))
        return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

    seen = first_items(buckets, k)
    kth = ranked(seen).where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
    # A group without a kth value has had all its buckets evaluated.
    more = buckets.join(seen.select("lang", "source", "n"), ["lang", "source", "n"], "left_anti").join(kth, ["lang", "source"]).where("bound >= kth")
    found, _ = common.materialize(ranked(seen.select("lang", "source", "n").union(more.select("lang", "source", "n"))), "terms")
    common.drop_path(buckets.sparkSession, path)
    return found


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shared(rows: pa.Table) -> pa.Table:
    """Sums a, b, value over the terms that groups a < b both have, of a block of postings sorted by term and group."""
    rows = rows.sort_by([("term", "ascending"), ("g", "ascending")])
    g, p, p0 = (rows.column(c).to_numpy() for c in ("g", "p", "p0"))
    term = rows.column("term").combine_chunks().dictionary_encode()
    codes = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    lengths = np.diff(np.r_[starts, len(codes)])
    keys, sums = [], []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        v = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
        order = np.lexsort((g[j], g[i]))
        a, b = g[i][order], g[j][order]
        edge = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        keys.append(np.stack([a[edge], b[edge]]))
        sums.append(np.add.reduceat(v[order], edge))

    for k in np.unique(lengths):
        if k < 2:
            continue
        at, step = starts[lengths == k], max(1, PAIRS_AT_ONCE // int(k))
        # pairs (row, row + d) of each posting list
        for lo in range(0, len(at), step):
            base = at[lo : lo + step]
            for d in range(1, int(k)):
                i = (base[:, None] + np.arange(k - d)).ravel()
                for cut in range(0, len(i), PAIRS_AT_ONCE):
                    add(i[cut : cut + PAIRS_AT_ONCE], i[cut : cut + PAIRS_AT_ONCE] + d)
    a, b = np.concatenate(keys, axis=1) if keys else np.empty((2, 0), np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(np.concatenate(sums) if sums else [], pa.int64())})


def _both_ways(rows: DataFrame) -> DataFrame:
    return rows.select("a", "b", "value").union(rows.select("b", "a", "value"))


def pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value and rank of each other source of the language. groups: lang, source, g (a number), p0 and kept; written."""
    per_block = F.greatest(F.lit(1), F.ceil(F.count("*") / POSTINGS_A_BLOCK))
    blocks = postings.groupBy("lang").agg(per_block.alias("blocks"))
    dealt = postings.join(blocks, "lang").join(groups.select("lang", "source", "g", "p0"), ["lang", "source"])
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "g", "p", "p0")
    # Dealt by hand: rows that lie by language already would else stay so, all blocks of a language in one task.
    shared = dealt.repartition("lang", "block").groupBy("lang", "block").applyInArrow(_shared, "a long, b long, value long")
    shared = shared.groupBy("a", "b").agg(F.sum("value").alias("value"))

    one = groups.select("lang", F.col("g").alias("a"), F.col("p0").alias("pa"), "kept")
    two = groups.select("lang", F.col("g").alias("b"), F.col("p0").alias("pb"))
    all_pairs = one.join(two, "lang").where("a <> b")
    # A term that a has and b, as supposed, hasn't: what it adds to the sum over terms that neither has.
    buckets = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("size"), F.first("p").alias("p"))
    buckets = buckets.join(groups.select("lang", "source", F.col("g").alias("a"), F.col("p0").alias("pa")), ["lang", "source"])
    alone = buckets.join(two, "lang").where("a <> b").select("a", "b", (F.col("size") * (difference("p", "pb") - difference("pa", "pb"))).alias("value"))
    alone = alone.groupBy("a", "b").agg(F.sum("value").alias("value"))
    none = all_pairs.select("a", "b", F.coalesce(F.col("kept") * difference("pa", "pb"), F.lit(0)).cast("long").alias("value"))
    total = none.union(_both_ways(alone)).union(_both_ways(shared)).groupBy("a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source", F.col("g").alias("a"))
    items = groups.select(F.col("source").alias("item"), F.col("g").alias("b"))
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.join(names, "a").join(items, "b").select("lang", "source", "item", "value", F.row_number().over(rank).alias("rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    spark = docs.sparkSession
    counts, counts_path = common.materialize(term_counts(docs), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept, kept_path = common.materialize(kept, "kept")
    # The rows without term keep the groups that have no kept one.
    known = counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    langs = kept.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("kept"))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "lang_total", "kept")
    groups = groups.withColumn("p0", F.when(F.col("kept") > 0, probability("0L", "total", "kept")))
    groups, groups_path = common.materialize(groups.withColumn("g", F.monotonically_increasing_id()), "groups")
    postings = known.join(groups.select("lang", "source", "total", "lang_total", "kept"), ["lang", "source"])
    postings = postings.select("lang", "source", "term", "n", probability("n", "total", "kept").alias("p"), probability("in_lang", "lang_total", "kept").alias("q"))
    postings, postings_path = common.materialize(postings, "postings")
    terms = top_terms(postings, k)
    found, _ = common.materialize(pairs(postings, groups), "pairs")
    for path in (counts_path, kept_path, groups_path, postings_path):
        common.drop_path(spark, path)
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(found, "pair").union(part(terms, "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


_F = "((p - q) * (p - q)) // (p + q)"
_P = f"1 + ({SCALE}::HUGEINT * ({{}} + 2)) // ({{}} + 2 * v)"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT lang, sum(lc) AS ln, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS gn FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_P.format("coalesce(n, 0)", "coalesce(gn, 0)")} AS p, {_P.format("lc", "ln")} AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT lang, source, item, sum({_F}) AS value FROM (SELECT a.lang, a.source, b.source AS item, a.p AS p, b.p AS q FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, {_F} FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
