"""Line dedup: fuzzy lines by MinHash, DataFrame operations only.

A line is what stands between line feeds; blank lines take no part. Equal lines fall
together first, by two 64-bit hashes. A line's shingles are its runs of ``size`` characters
(the whole line where it is shorter); ``bands * rows`` minima of their hashes are its
signature: row r of every band uses a hash of its own, under another exclusive or in each
band. Lines that agree in all minima of a band share a bucket.

Links. In each bucket, every line is compared with the bucket's least line, and in a bucket of
over ``GROUP`` lines also with the least of those that share another band; union-find joins
what is near. In buckets that still have several components, the lines outside of the largest
meet one block of ``TURN_BLOCK`` lines of the bucket, and the likeliest of them is verified; this is
done ``TURNS`` times in buckets of several blocks, so that most of a large family falls together
at little cost. Then the
lines outside of a bucket's largest component are compared with all of its lines that are of
other components, in blocks: where links abound, few lines are left, and no link between
components is lost. A comparison first counts equal minima in
two sketches (a byte of each minimum) and drops the pair where a pair at the threshold would
have fewer with a probability below ``MISS``. Then two bitmaps (a bit of ``WORDS * 64`` for
each shingle) are compared: bits that differ are as many shingles that differ at least, so a
pair with more of them than the threshold allows is dropped without loss. Lines whose buckets
hold two lines each have none: their pairs are verified at once. In buckets that are
compared in blocks, lines of ``FINE_FROM`` shingles or more have a second bitmap of ``FINE``
times the size, since the first one fills up. Repetitive lines have fewer shingles than places:
where the second bitmap has clearly fewer bits than the places would set, the different shingles
(64-bit hashes) are counted. What is left is verified by the exact Jaccard similarity of the
shingle sets. Of each component the earliest line (least doc_id, then line number) is kept.

Recall: at 3 rows and 8 bands, a pair of similarity 0.8 shares a bucket with probability
0.997; simulated with these permutations 0.993 at 5 distinct shingles, 0.996 at 10 and more.

Scale: texts are shuffled once, by line hash. Buckets are counted with partial sums before
the shuffle, and a bucket's members meet its least line in a join that may be split, so a
bucket of any size is no task's alone; so are the blocks of a bucket's comparisons.

Cases: a null or empty text has no lines; rows that repeat a doc_id and line number are one
place, and are kept or dropped together; ties cannot arise between places; lines of rows
without doc_id count as earliest; an empty table gives no rows; further columns do not
matter to line_verdicts, and drop_lines passes them on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import common

SIZE = 8
ROWS = 3
BANDS = 8
THRESHOLD = 0.8
CHUNK = 8192  # shingles of a line that are listed at a time
STEP = 4  # neighbouring shingles that are hashed in one row
GROUP = 16  # lines of a bucket beyond which its groups that share another band have heads as well
TURNS = 2  # in which a line meets one block
TURN_BLOCK = 64  # lines that a line meets in a turn
BLOCK = 256  # lines of a block that are compared pair by pair
PAIRS_A_TASK = 4096  # that are verified
LONG = 500_000  # characters of a line whose shingles are no longer listed in one row
MISS = 1e-4
PACKED = 6  # bytes of a sketch in one long
SLICES = 2  # in which the texts of lines that share a bucket are shuffled
WORDS = 32  # longs of a bitmap
FINE = 8  # times as many has the second bitmap of a line
FINE_FROM = 256  # of at least so many shingles


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line and its two hashes, of lines that aren't blank."""
    pos = F.posexplode(F.split(F.col("text"), "\n", -1))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), pos.alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"\S")).select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """id, h1, h2, line and its first place, a row for each different line. To be written before ids are used."""
    found = lines_of(docs).groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    return found.select(F.monotonically_increasing_id().alias("id"), "*")


def _word(k: int) -> int:
    """A fixed 64-bit word for each permutation (a multiple of the golden ratio's bits, mixed)."""
    x = (k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def _wide(lines: DataFrame, unit: int) -> DataFrame:
    """Lines in UTF-16 or UTF-32, where every unit is two or four bytes, so that cutting needs no search."""
    return lines.select("id", F.encode("line", {2: "UTF-16BE", 4: "UTF-32"}[unit]).alias("wide"))


def _last(wide: str, size: int, unit: int) -> Column:
    """Place of the last shingle."""
    return F.greatest((F.octet_length(wide) / unit).cast("int") - size, F.lit(0))


def _places(rows: DataFrame, last: Column, step: int) -> DataFrame:
    """rows with ``i``: every step-th place up to last, listed in chunks."""
    keep = [F.col(c) for c in rows.columns]
    chunks = rows.select(*keep, last.alias("last")).select(*keep, "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(CHUNK))).alias("at"))
    return chunks.select(*keep, "last", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + (CHUNK - step), F.col("last")), F.lit(step))).alias("i"))


def shingle_groups(lines: DataFrame, size: int, group: int = STEP, unit: int = 2) -> DataFrame:
    """id, s0, s1, ...: hashes of neighbouring shingles, the last repeated to fill a row, and the place of a line's last one. unit: bytes of a character, 4 for code points."""
    rows = _places(_wide(lines, unit), _last("wide", size, unit), group)
    return rows.select("id", *(F.xxhash64(F.expr(f"substring(wide, {unit} * least(i + {k}, last) + 1, {unit * size})")).alias(f"s{k}") for k in range(group)), "last")


def signatures(lines: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id, the band hashes and the sketch (p0, p1, ...) of each distinct line."""
    found = shingle_groups(lines, size)
    of = [[f"s{k}" for k in range(STEP)]]
    for r in range(1, rows):
        found = found.select("*", *(F.xxhash64(c).alias(f"{c}r") for c in of[-1]))
        of.append([f"{c}r" for c in of[-1]])
    words = {(b, r): F.lit(_word(b * rows + r)) for b in range(bands) for r in range(rows)}
    minima = [F.min(F.least(*(F.col(c).bitwiseXOR(words[b, r]) for c in of[r]))).alias(f"m{b * rows + r}") for b in range(bands) for r in range(rows)]
    sig = found.groupBy("id").agg(*minima)
    band = [F.xxhash64(F.lit(b), *(f"m{b * rows + r}" for r in range(rows))) for b in range(bands)]
    packed = []
    for at in range(0, bands * rows, PACKED):
        total = F.lit(0).cast("long")
        for k in range(at, min(at + PACKED, bands * rows)):
            total = total.bitwiseOR(F.shiftleft(F.col(f"m{k}").bitwiseAND(F.lit(255)), 8 * (k - at)))
        packed.append(total.alias(f"p{at // PACKED}"))
    return sig.select("id", F.array(*band).alias("bands"), *packed)


def least_agreement(n: int, threshold: float) -> int:
    """Equal minima that a pair at the threshold has at least, but for a share of MISS."""
    total = 0.0
    for k in range(n + 1):
        total += comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if total > MISS:
            return k
    return n


def agreement(n: int, a: str, b: str) -> Column:
    """Equal bytes of two sketches in columns a0, a1, ... and b0, b1, ...; their unused bytes are equal."""
    differ = F.lit(0)
    low, high = int("7f" * PACKED, 16), int("80" * PACKED, 16)
    for k in range(-(-n // PACKED)):
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        differ = differ + F.bit_count(((x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x)).bitwiseAND(F.lit(high)))
    return F.lit(n) - differ


def bitmaps(lines: DataFrame, size: int) -> DataFrame:
    """id, the bitmap of a line's shingles (map), how many they are at most (places) and the second bitmap of a long line (fine)."""
    places = F.greatest(F.length("line") - size, F.lit(0)) + 1
    word, bit = (lambda s: f"cast(shiftright({s}, 6) & {WORDS - 1} as int)"), (lambda s: f"shiftleft(1L, cast({s} & 63 as int))")
    of, listed, n = range(STEP), F.array(*(f"w{w}" for w in range(WORDS))), F.max("last").alias("last")
    short = shingle_groups(lines.where(places < FINE_FROM), size, unit=4)
    short = short.select("id", "last", *(F.expr(word(f"s{k}")).alias(f"at{k}") for k in of), *(F.expr(bit(f"s{k}")).alias(f"bit{k}") for k in of))
    words = [F.bit_or(F.expr(" | ".join(f"if(at{k} = {w}, bit{k}, 0L)" for k in of))).alias(f"w{w}") for w in range(WORDS)]
    short = short.groupBy("id").agg(*words, n).select("id", listed.alias("map"), F.lit(None).cast("array<bigint>").alias("fine"), "last")
    # A long line's shingles are dealt to FINE bitmaps, which make its second one; their union is its first.
    long = shingle_groups(lines.where(places >= FINE_FROM).repartition("id"), size, unit=4).select("id", "last", F.explode(F.array(*(f"s{k}" for k in of))).alias("s"))
    long = long.select("id", "last", F.expr(f"cast(shiftright(s, {5 + WORDS.bit_length()}) & {FINE - 1} as int)").alias("part"), F.expr(word("s")).alias("at"), F.expr(bit("s")).alias("bit"))
    long = long.groupBy("id", "part").agg(*(F.bit_or(F.expr(f"if(at = {w}, bit, 0L)")).alias(f"w{w}") for w in range(WORDS)), n)
    long = long.groupBy("id").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)), n, F.map_from_entries(F.collect_list(F.struct("part", listed))).alias("parts"))
    none = F.array_repeat(F.lit(0).cast("long"), WORDS)
    fine = F.flatten(F.array(*(F.coalesce(F.try_element_at("parts", F.lit(k)), none) for k in range(FINE))))
    return short.union(long.select("id", listed, fine, "last")).select("id", "map", "fine", (F.col("last") + 1).alias("places"))


def repetitive(maps: DataFrame) -> DataFrame:
    """Lines with a second bitmap that has clearly fewer bits than different shingles at all their places would set."""
    bits = FINE * WORDS * 64
    expected = bits * (1 - F.exp(-F.col("places") / bits))
    return maps.where(F.aggregate("fine", F.lit(0), lambda t, x: t + F.bit_count(x)) < 0.9 * expected)


def counted(maps: DataFrame, lines: DataFrame, size: int) -> tuple[DataFrame, list[str]]:
    """maps, where places of a repetitive line are the number of its different shingles, and what was written. maps: bitmaps, written."""
    few, few_path = common.materialize(lines.select("id", "line").join(repetitive(maps).select("id"), "id", "left_semi"), "repetitive", maps.count(), compression="zstd")
    if few.isEmpty():
        return maps, [few_path]
    shingle = F.explode(F.array(*(f"s{k}" for k in range(STEP)))).alias("s")
    counts = shingle_groups(few, size, unit=4).select("id", shingle).distinct().groupBy("id").agg(F.count("*").cast("int").alias("n"))
    counts, counts_path = common.materialize(counts, "counts", few.count())
    return maps.join(counts, "id", "left").withColumn("places", F.coalesce("n", "places")).drop("n"), [few_path, counts_path]


def may_be_near(threshold: float, a: str, b: str) -> Column:
    """Whether the bitmaps and places in columns a, a_places, b and b_places allow the threshold; never false for a pair that reaches it.

    Of sets of x and y shingles, d of which are in one alone, (x + y - d) / (x + y + d) are shared;
    d is no less than the bits that differ, x and y no more than the places. For a pair's second bitmaps the same holds.
    """
    differ = reduce(add, (F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))) for w in range(WORDS)))
    return _allow(threshold, differ, F.col(f"{a}_places") + F.col(f"{b}_places"))


def _allow(threshold: float, differ: Column, places: Column) -> Column:
    return differ * (1 + threshold) <= places * (1 - threshold) + 1e-6


def _mapped(rows: DataFrame, maps: DataFrame, key: str, name: str, how: str = "inner") -> DataFrame:
    """rows with the bitmap and places of the line in column key."""
    return rows.join(maps.select(F.col("id").alias(key), F.col("map").alias(name), F.col("places").alias(f"{name}_places")), key, how)


def _with_heads(rows: DataFrame) -> DataFrame:
    """rows(g, id) with the group's least line (head) and number of lines (n); groups of one line go."""
    heads = rows.groupBy("g").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    return rows.join(heads.hint("shuffle_hash"), "g")


def buckets(sig: DataFrame) -> DataFrame:
    """g, id, head and n of the buckets that lines share."""
    return _with_heads(sig.select(F.explode("bands").alias("g"), "id"))


def refined(shared: DataFrame, sig: DataFrame) -> DataFrame:
    """The same for lines of a large bucket that share another band."""
    rows = shared.where(F.col("n") > GROUP).select(F.col("g").alias("bucket"), "id").join(sig.select("id", "bands"), "id")
    rows = rows.select("bucket", "id", F.explode("bands").alias("other")).where("bucket <> other")
    return _with_heads(rows.select(F.xxhash64(F.least("bucket", "other"), F.greatest("bucket", "other")).alias("g"), "id").distinct())


def _sketched(rows: DataFrame, sig: DataFrame, n: int, key: str, prefix: str) -> DataFrame:
    """rows with the sketch of the line in column key."""
    packed = [F.col(f"p{k}").alias(f"{prefix}{k}") for k in range(-(-n // PACKED))]
    return rows.join(sig.select(F.col("id").alias(key), *packed), key)


def _profiled(rows: DataFrame, sig: DataFrame, maps: DataFrame, n: int) -> DataFrame:
    """rows with the sketch, both bitmaps and the places of the line in column id, in x0, x1, ..., w, w_places and fine."""
    of = maps.select("id", F.col("map").alias("w"), F.col("places").alias("w_places"), "fine")
    return _sketched(rows, sig, n, "id", "x").join(of, "id")


def head_pairs(groups: DataFrame, sig: DataFrame, maps: DataFrame, n: int, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of a line and its group's least line whose sketches agree enough and whose bitmaps, where both have one, allow it."""
    pairs = groups.where("id > head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    pairs = _sketched(_sketched(pairs, sig, n, "a", "x"), sig, n, "b", "y")
    pairs = pairs.where(agreement(n, "x", "y") >= least_agreement(n, threshold)).select("a", "b")
    pairs = _mapped(_mapped(pairs, maps, "a", "u", "left"), maps, "b", "v", "left")
    return pairs.where(F.coalesce(may_be_near(threshold, "u", "v"), F.lit(True))).select("a", "b")


def open_rows(shared: DataFrame, found: DataFrame) -> DataFrame:
    """g, id, component, whether it is outside of the bucket's largest component, and the bucket's numbers of blocks (bi, bj; bt in a turn).

    Of buckets of several components; a bucket of two lines is its head pair, which has been compared.
    """
    rows = shared.where("n > 2").select("g", "id").join(found, F.col("id") == F.col("node"), "left").select("g", "id", F.coalesce("component", "id").alias("component"))
    counts = rows.groupBy("g", "component").agg(F.count("*").alias("size"))
    largest = F.max_by("component", F.struct("size", -F.col("component")))
    of = counts.groupBy("g").agg(F.sum("size").alias("n"), F.max("size").alias("most"), F.count("*").alias("parts"), largest.alias("largest")).where("parts > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    of = of.select("g", "largest", blocks(F.col("n") - F.col("most")).alias("bi"), blocks(F.col("n")).alias("bj"), F.ceil(F.col("n") / TURN_BLOCK).cast("int").alias("bt"))
    return rows.join(of, "g").select("g", "id", "component", (F.col("component") != F.col("largest")).alias("open"), "bi", "bj", "bt")


def _sides(rows: DataFrame, n: int, at_one: list[Column], at_two: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Lines outside of their bucket's largest component (a), and all lines (b), with their places; both with sketches and bitmaps."""
    packed = range(-(-n // PACKED))
    one = rows.where("open").select("g", *at_one, F.col("id").alias("a"), F.col("component").alias("ca"), *(f"x{k}" for k in packed), F.col("w").alias("u"), F.col("w_places").alias("u_places"), F.col("fine").alias("fu"))
    two = rows.select("g", *at_two, F.col("id").alias("b"), F.col("component").alias("cb"), *(F.col(f"x{k}").alias(f"y{k}") for k in packed), F.col("w").alias("v"), F.col("w_places").alias("v_places"), F.col("fine").alias("fv"))
    return one, two


def _near(n: int, threshold: float) -> Column:
    differ = F.aggregate(F.zip_with("fu", "fv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    fine = F.coalesce(_allow(threshold, differ, F.col("u_places") + F.col("v_places")), F.lit(True))
    return (F.col("ca") != F.col("cb")) & (agreement(n, "x", "y") >= least_agreement(n, threshold)) & may_be_near(threshold, "u", "v") & fine


def _block(c: str, *of) -> Column:
    return F.pmod(F.xxhash64("id", "g", *of), F.col(c)).cast("int")


def turn_pairs(rows: DataFrame, known: DataFrame, n: int, threshold: float, turn: int) -> DataFrame:
    """Distinct pairs (a, b) as open_pairs has them, but a line meets one block of its bucket alone, and is paired with the likeliest there."""
    one, two = _sides(rows, n, [_block("bt", F.lit(turn)).alias("j")], [_block("bt").alias("j")])
    met = one.join(two, ["g", "j"]).where(_near(n, threshold))
    met = met.select("g", F.col("a").alias("of"), agreement(n, "x", "y").alias("n"), F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).join(known, ["a", "b"], "left_anti")
    return met.groupBy("g", "of").agg(F.max(F.struct("n", "a", "b")).alias("m")).select("m.a", "m.b").distinct()


def open_pairs(rows: DataFrame, known: DataFrame, n: int, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a bucket, may be near and aren't known. rows: open_rows with sketches and bitmaps, written.

    Lines outside of a bucket's largest component meet all its lines, in blocks.
    """
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one, two = _sides(rows, n, [_block("bi").alias("i"), every("bj").alias("j")], [every("bi").alias("i"), _block("bj").alias("j")])
    pairs = one.join(two, ["g", "i", "j"]).where(_near(n, threshold))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(known, ["a", "b"], "left_anti")


def _shingles(line: str, size: int) -> str:
    """SQL for the list of a line's shingles."""
    return f"if(length({line}) < {size}, array({line}), regexp_extract_all({line}, '(?s)(?=(.{{{size}}}))', 1))"


def _near_short(both: DataFrame, size: int, threshold: float) -> DataFrame:
    """a, b and whether they are near, by the lists of their shingles."""
    x, y = _shingles("la", size), _shingles("lb", size)
    return both.select("a", "b", F.expr(f"size(array_intersect({x}, {y})) >= {threshold}D * size(array_union({x}, {y}))").alias("near"))


def _near_long(both: DataFrame, size: int, threshold: float) -> DataFrame:
    """The same for lines whose lists would not fit in memory: a row for each shingle, dealt by pair and shingle."""
    n = [F.greatest(F.length(c) - size, F.lit(0)) for c in ("la", "lb")]
    both = both.select("a", "b", "la", "lb", n[0].alias("na"))
    rows = _places(both, F.col("na") + F.greatest(F.length("lb") - size, F.lit(0)) + 1, 1)
    cut = f"if(i <= na, substring(la, i + 1, {size}), substring(lb, i - na, {size}))"
    sides = rows.select("a", "b", F.expr(cut).alias("s"), F.expr("if(i <= na, 1, 2)").alias("side")).groupBy("a", "b", "s").agg(F.bit_or("side").alias("side"))
    shares = sides.groupBy("a", "b").agg(F.count("*").alias("either"), F.sum(F.when(F.col("side") == 3, 1).otherwise(0)).alias("both"))
    return shares.select("a", "b", (F.col("both") >= threshold * F.col("either")).alias("near"))


def verified_links(pairs: DataFrame, lines: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs of a written table whose exact Jaccard similarity reaches the threshold."""
    spark = lines.sparkSession
    n = pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts, texts_path = common.materialize(lines.select("id", "line").join(ids, "id", "left_semi"), "texts", 2 * n, compression="zstd")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    is_long = F.greatest(F.length("la"), F.length("lb")) > LONG
    # The verdicts are written before they are filtered, or the filter would list the shingles once more.
    judged, _ = common.materialize(_near_short(both.where(~is_long), size, threshold), "judged", n, PAIRS_A_TASK)
    links = judged.where("near").select("a", "b")
    if not texts.where(F.length("line") > LONG).isEmpty():
        links = links.union(_near_long(both.where(is_long), size, threshold).where("near").select("a", "b"))
        links, _ = common.materialize(links, "links", n)
    common.drop_path(spark, texts_path)
    return links


def shared_lines(known: DataFrame, lines: DataFrame, n_lines: int) -> tuple[DataFrame, list[str]]:
    """known with their lines, and what was written. All lines' texts are shuffled for it, a slice at a time, so that they never lie on disk twice."""
    slices = []
    for k in range(SLICES):
        one = F.pmod("id", F.lit(SLICES)) == k
        slices.append(common.materialize(known.where(one).join(lines.where(one).select("id", "line"), "id"), "shared-lines", n_lines // SLICES, compression="zstd"))
    paths = [path for _, path in slices]
    return known.sparkSession.read.schema(slices[0][0].schema).parquet(*paths), paths


def components(lines: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, texts_read: Callable[[], None] | None = None) -> DataFrame:
    """(node, component) by id, of lines that have a near copy. lines: distinct_lines, written; texts_read: called once they are no longer read."""
    spark, n, n_lines = lines.sparkSession, bands * rows, lines.count()
    sig, sig_path = common.materialize(signatures(lines, size, bands, rows), "signatures", n_lines)
    shared, shared_path = common.materialize(buckets(sig), "buckets", n_lines)
    # From here on, only lines that share a bucket matter.
    ids = shared.select("id").distinct()
    known, known_path = common.materialize(sig.join(ids, "id", "left_semi"), "signatures", n_lines)
    common.drop_path(spark, sig_path)
    some, some_paths = shared_lines(known, lines, n_lines)
    common.drop_path(spark, known_path)
    if texts_read:
        texts_read()
    # Two lines that share no larger bucket are one pair: bitmaps would cost more than it takes to verify it.
    several = some.join(shared.where("n > 2").select("id").distinct(), "id", "left_semi")
    maps, maps_path = common.materialize(bitmaps(several, size), "bitmaps", n_lines)
    paths = [shared_path, *some_paths, maps_path]
    maps, more_paths = counted(maps, some, size)
    fine, fine_path = common.materialize(refined(shared, some), "groups", n_lines)
    pairs, pairs_path = common.materialize(head_pairs(shared.union(fine), some, maps, n, threshold), "pairs", n_lines)
    n_pairs = pairs.count()
    found = common.connected_components(verified_links(pairs, some, size, threshold), rows=n_pairs)
    paths += [*more_paths, fine_path, pairs_path]
    # In a bucket of one block, a turn would meet all lines that the last step meets.
    large = shared.where(F.col("n") > TURN_BLOCK)
    for turn in range(0 if not large.isEmpty() else TURNS, TURNS + 1):
        rows = open_rows(large if turn < TURNS else shared, found)
        rows, rows_path = common.materialize(_profiled(rows, some, maps, n), "open", n_lines)
        more = turn_pairs(rows, pairs, n, threshold, turn) if turn < TURNS else open_pairs(rows, pairs, n, threshold)
        more, more_path = common.materialize(more, "pairs", n_lines)
        common.drop_path(spark, rows_path)
        paths.append(more_path)
        if more.isEmpty():
            continue
        links = verified_links(more, some, size, threshold)
        if not links.isEmpty():
            edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
            found = common.connected_components(edges, rows=n_pairs)
        pairs = pairs.union(more)
    for path in paths:
        common.drop_path(spark, path)
    return found


def labels(docs: DataFrame, **kw) -> DataFrame:
    """h1, h2 and the place that is kept (head), a row for each different line."""
    lines, path = common.materialize(distinct_lines(docs), "lines", compression="zstd")
    n, written = lines.count(), []

    def keep_places() -> None:
        written.extend(common.materialize(lines.drop("line"), "places", n))
        common.drop_path(docs.sparkSession, path)

    found = components(lines, texts_read=keep_places, **kw)
    places, places_path = written
    firsts = places.select("id", "first").join(found, F.col("id") == F.col("node")).select("id", "first", "component")
    heads = firsts.groupBy("component").agg(F.min("first").alias("head"))
    heads = firsts.join(heads, "component").select("id", "head")
    out, _ = common.materialize(places.join(heads, "id", "left").select("h1", "h2", F.coalesce("head", "first").alias("head")), "labels", n)
    common.drop_path(docs.sparkSession, places_path)
    return out


def line_verdicts(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, line_no, the place that is kept of its component, and kept, a row for each line that isn't blank."""
    found, kept = labels(docs, **kw), F.struct("doc_id", "line_no").eqNullSafe(F.col("head"))
    rows = lines_of(docs).select("doc_id", "line_no", "h1", "h2").join(found, ["h1", "h2"])
    rows = rows.select("doc_id", "line_no", F.col("head.doc_id").alias("kept_doc_id"), F.col("head.line_no").alias("kept_line_no"), kept.alias("kept"))
    return common.few(rows, found.count())


def drop_lines(docs: DataFrame, **kw) -> DataFrame:
    """docs with the lines taken out that are not kept; texts left without a line go. All columns stay."""
    gone = line_verdicts(docs, **kw).where("not kept and doc_id is not null").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    gone, _ = common.materialize(gone.withColumnRenamed("doc_id", "gone_id"), "gone")
    # The rows travel as one struct, so that no column of theirs can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d")).join(gone, F.col("d.doc_id") == F.col("gone_id"), "left")
    text, whole = F.col("d.text"), F.col("gone").isNull()
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")
    rows = rows.withColumn("rest", F.when(whole, text).otherwise(rest)).where(whole | F.col("rest").rlike(r"\S"))
    new = {"text": F.col("rest")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("d.n_chars")).otherwise(F.length("rest").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(common.table(spark, sf_dir, "documents"))
