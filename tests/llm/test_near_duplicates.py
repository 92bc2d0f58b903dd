"""SimHash, line dedup, connected components, nearest neighbours and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import DOCS, empty, messy, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmith.llm import common, hilbert_ann, line_dedup, simhash

SF = "/root/testdata/sf0.001"


def classes(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# Components.
@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    got = {x["node"]: x["component"] for x in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(600, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}


def test_no_components(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert common.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


# SimHash.
def plain_fingerprint(text, size=3):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB É \n\t", max_size=40))
def test_fingerprint(text):
    for size in (3, 5):
        assert simhash.fingerprint(text, size) == plain_fingerprint(text, size)


def near_values(seed, n=120):
    r = np.random.default_rng(seed)
    out = []
    for base in r.integers(0, 2**63, n, dtype=np.uint64):
        for _ in range(5):
            v = base
            for k in r.integers(0, 64, r.integers(0, 4)):
                v ^= np.uint64(1) << np.uint64(k)
            out.append(v)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("budget", [0, 2, 3, 5])
def test_trie_join(budget):
    v = near_values(budget)
    got = {p for i, j in simhash._pairs_within(v, v, True, 0, 0, budget, 64) for p in zip(i.tolist(), j.tolist(), strict=True)}
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= budget), strict=True) if i < j}


@pytest.mark.parametrize("node_rows", [4096, 40, 3])
def test_near_links(spark, node_rows):
    v = near_values(9)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(df, 2, node_rows).collect()]
    at = {int(x): k for k, x in enumerate(v.view(np.int64))}
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    assert all(d[at[a], at[b]] <= 2 for a, b in links)
    assert classes(len(v), [(at[a], at[b]) for a, b in links]) == classes(len(v), list(zip(*np.nonzero(d <= 2), strict=True)))


def check_components(rows, docs):
    fps = {k: plain_fingerprint(t) for k, t in docs.items()}
    keys = sorted(fps)
    v = np.array([fps[k] for k in keys], np.uint64)
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    want = classes(len(keys), list(zip(*np.nonzero(d <= 2), strict=True)))
    for r in rows:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == keys[want[keys.index(r["doc_id"])]]


def test_simhash_query(spark):
    from corpusmith.llm.queries import QUERIES

    rows = QUERIES["op5_simhash"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    check_components(rows, docs)


def test_simhash_edges(spark):
    docs = messy(spark, clash=True)
    rows = simhash.components(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got[0] == got[1] == got[2] == 0 and got[4] == got[5] == 4 and got[None] is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*(k for k, v in got.items() if k is not None and v == k), 4, 4, None])
    assert simhash.components(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


# Lines.
def shingles(line, size=8):
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def line_classes(docs):
    """(doc_id, line_no) to the first place of its component, by brute force."""
    places = [(k, i, x) for k, t in sorted(docs.items()) for i, x in enumerate((t or "").split("\n")) if x.strip()]
    lines = list(dict.fromkeys(x for _, _, x in places))
    sets = [shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = dict(zip(lines, classes(len(lines), links), strict=True))
    first = {}
    for k, i, x in places:
        first.setdefault(comp[x], (k, i))
    return {(k, i): first[comp[x]] for k, i, x in places}


def test_line_query(spark):
    from corpusmith.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_line_dedup"](spark, SF).collect()
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"]) for r in rows}
    want = line_classes(docs)
    assert len(rows) == len(want) == len(got) and got == want
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["kept_doc_id"], r["kept_line_no"])) for r in rows)


def test_near_lines(spark):
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(400)]
    docs = {}
    for k in range(60):
        line = list(r.choice(words, 40))
        docs[2 * k] = "head%d\n" % k + " ".join(line)
        line[int(r.integers(40))] = "changed"
        docs[2 * k + 1] = " ".join(line) + "\n\n  \ntail"
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], DOCS)
    want = line_classes(docs)
    assert {(x["doc_id"], x["line_no"]): (x["kept_doc_id"], x["kept_line_no"]) for x in line_dedup.line_verdicts(df).collect()} == want
    out = {x["doc_id"]: x for x in line_dedup.drop_lines(df).collect()}
    for k, t in docs.items():
        rest = "\n".join(x for i, x in enumerate(t.split("\n")) if want.get((k, i), (k, i)) == (k, i))
        assert (out[k]["text"] == rest and out[k]["n_chars"] == len(rest)) if rest.strip() else k not in out


def test_line_edges(spark):
    docs = messy(spark, clash=True)
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns
    rows = {}
    for r in out.collect():
        rows.setdefault(r["doc_id"], []).append(r["text"])
    assert rows[0] == [None] and rows[1] == [""]  # nothing to take out
    assert rows[7] == ["line one is here and is quite long\nline two is here and is quite long too"]
    assert rows[8] == ["another line that stands alone in all of this"]
    assert 5 not in rows and len(rows[4]) == 3  # 5 repeats 4; the rows that are one place stay together
    assert rows[11] == [texts()[11]]
    assert line_dedup.line_verdicts(empty(spark)).count() == 0 and line_dedup.drop_lines(empty(spark)).count() == 0


def test_long_line_shingles(spark):
    line = "".join(chr(97 + k * k % 26) for k in range(3 * line_dedup.CHUNK + 5))
    df = spark.createDataFrame([(1, line), (2, "é" * 5), (3, ""), (4, "exactly 8"), (5, line[: line_dedup.CHUNK + 7]), (6, line[: line_dedup.CHUNK + 8])], "id long, line string")
    hashes = line_dedup.shingle_groups(df, 8).select("id", F.explode(F.array(*(f"s{k}" for k in range(line_dedup.STEP)))).alias("h"))
    got = {r["id"]: r["n"] for r in hashes.groupBy("id").agg(F.count_distinct("h").alias("n")).collect()}
    assert got == {r["id"]: len(shingles(r["line"])) for r in df.collect()}


def check_lines(spark, docs):
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], DOCS)
    got = {(x["doc_id"], x["line_no"]): (x["kept_doc_id"], x["kept_line_no"]) for x in line_dedup.line_verdicts(df).collect()}
    want = line_classes(docs)
    assert got.keys() == want.keys()
    return sum(got[k] != want[k] for k in want)


def families(r):
    """Families of variants, some near each other, that share buckets with their least line and yet aren't near it."""
    words = ["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    for _ in range(10):
        base = list(r.choice(words, 24))
        for _ in range(40):
            line = list(base)
            for at in r.integers(0, 24, r.integers(1, 5)):
                line[at] = str(r.choice(words))
            yield " ".join(line)


def short_lines(r):
    """Pairs of 9 and 8 shingles, of similarity 8 / 9."""
    for _ in range(300):
        line = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 16))
        yield from (line, line[:-1])


def test_line_families(spark):
    r = np.random.default_rng(0)
    assert check_lines(spark, dict(enumerate([*families(r), *short_lines(r)]))) == 0


def one_bucket(r):
    base = "".join(r.choice(list("abcdefghij"), 150))
    for k in range(90):
        cut = int(r.integers(20, 60))
        line = base[:-cut] + "".join(r.choice(list("klmnopqrst"), cut))
        yield from (line, line + "x") if k % 3 == 0 else (line,)


def long_lines(r):
    for _ in range(12):
        base = "".join(r.choice(list("abcdefghij é\U0001f600"), int(r.integers(60, 300))))
        yield from (base, base[:40] + "?" + base[41:], base + base[:30], base[: len(base) // 2] + "z" * 20)


def test_bounds(spark, monkeypatch):
    """Buckets over the bound are refined, and lines over theirs compared shingle by shingle, with the same result."""
    monkeypatch.setattr(line_dedup, "GROUP", 12)
    monkeypatch.setattr(line_dedup, "LONG", 120)
    r = np.random.default_rng(5)
    assert check_lines(spark, dict(enumerate([*one_bucket(r), *long_lines(r)]))) == 0


def test_agreement(spark):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        a = r.integers(0, 256, 24)
        b = np.where(r.random(24) < 0.5, a, r.integers(0, 256, 24))
        pack = lambda v: [int(sum(int(x) << 8 * i for i, x in enumerate(v[at : at + 6]))) for at in range(0, 24, 6)]
        rows.append((*pack(a), *pack(b), int((a == b).sum())))
    df = spark.createDataFrame(rows, ", ".join([f"a{k} long" for k in range(4)] + [f"b{k} long" for k in range(4)]) + ", want int")
    assert df.where(line_dedup.agreement(24, "a", "b") != F.col("want")).count() == 0
    assert line_dedup.least_agreement(24, 0.8) == 11


def test_bitmaps_drop_no_near_pair(spark):
    r = np.random.default_rng(7)
    rows = []
    for k in range(400):
        a = list(r.choice(list("abcdefghij é\U0001f600"), int(r.integers(1, 700))))
        b = list(a)
        for at in r.integers(0, len(a), int(r.integers(0, 12))):
            b[at] = "?"
        rows += [(2 * k, "".join(a)), (2 * k + 1, "".join(b) + "x" * int(r.integers(0, 30)))]
    df = spark.createDataFrame(rows, "id long, line string")
    maps = line_dedup.bitmaps(df, 8)
    both = line_dedup._mapped(line_dedup._mapped(spark.range(400).select((2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b")), maps, "a", "u"), maps, "b", "v")
    found = {x["a"]: x["m"] for x in both.select("a", line_dedup.may_be_near(0.8, "u", "v").alias("m")).collect()}
    sets = {k: shingles(t) for k, t in rows}
    share = {k: len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, 800, 2)}
    assert all(found[k] for k, x in share.items() if x >= 0.8) and sum(x >= 0.8 for x in share.values()) > 50
    assert not any(found[k] for k, x in share.items() if x < 0.6) and sum(x < 0.6 for x in share.values()) > 50


def test_few_pairs_are_verified(spark, monkeypatch):
    """In families of variants, most of which are not near each other, few pairs but the near ones are verified."""
    seen, real = [], line_dedup.verified_links
    monkeypatch.setattr(line_dedup, "verified_links", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    lines = list(families(np.random.default_rng(0)))
    assert check_lines(spark, dict(enumerate(lines))) == 0
    sets = [shingles(x) for x in dict.fromkeys(lines)]
    near = sum(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert sum(seen) < 2 * near + len(sets), (seen, near)


def test_long_and_repetitive_lines_are_verified_if_near(spark, monkeypatch):
    """Bitmaps fill up in long lines, and lines that repeat themselves have fewer shingles than places: neither lets pairs pass that aren't near."""
    r = np.random.default_rng(11)
    words = ["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(2000)]
    lines = []
    for n, times, of in ((200, 1, 70), (40, 8, 70)):
        base = list(r.choice(words, n, replace=False))
        for k in range(of):
            line = list(base)
            for at in r.choice(n, n // (60 if k % 10 == 0 else 18) + 1, replace=False):
                line[at] = str(r.choice(words))
            lines.append(" ".join(line * times))
    seen, real = [], line_dedup.verified_links
    monkeypatch.setattr(line_dedup, "verified_links", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    assert check_lines(spark, dict(enumerate(lines))) == 0
    sets = [shingles(x) for x in lines]
    near = sum(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert near > 20 and sum(seen) < 2 * near + 2 * len(sets), (seen, near)


def test_long_lines_have_no_row_a_shingle(spark):
    """Bitmaps of long lines are made without grouping by line and shingle, a table of which spilled twice the input."""
    df = spark.createDataFrame([(1, "ab" * 400), (2, "".join(chr(97 + k * k % 26) for k in range(400)))], "id long, line string")
    plan = line_dedup.bitmaps(df, 8)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"keys=\[id#\d+L, part#", plan) and not re.search(r"keys=\[id#\d+L, s#", plan)


def test_repetitive_lines_are_counted(spark):
    r = np.random.default_rng(12)
    plain, once = ("".join(r.choice(list("abcdefghijklmnop"), n)) for n in (3000, 250))
    rows = [(1, plain), (2, once * 12), (3, once), (4, "ab" * 300), (5, "short")]
    df = spark.createDataFrame(rows, "id long, line string")
    maps, paths = line_dedup.counted(common.materialize(line_dedup.bitmaps(df, 8), "maps")[0], df, 8)
    got = {x["id"]: x["places"] for x in maps.collect()}
    assert got == {k: len(shingles(t)) for k, t in rows} and got[4] == 2 and len(paths) == 2


def test_texts_lie_on_disk_no_longer_than_needed(spark, monkeypatch):
    """Texts of all lines are shuffled in slices, and go before lines that share a bucket are compared."""
    r, seen = np.random.default_rng(13), []
    write, drop = common.materialize, common.drop_path
    monkeypatch.setattr(common, "materialize", lambda df, name, *a, **kw: (seen.append(name), write(df, name, *a, **kw))[1])
    monkeypatch.setattr(common, "drop_path", lambda spark, path: (seen.append("drop " + path[-6:]), drop(spark, path))[1])
    assert check_lines(spark, dict(enumerate([*families(r), *short_lines(r)]))) == 0
    assert seen.count("shared-lines") == line_dedup.SLICES > 1 and seen.index("drop -lines") < seen.index("bitmaps")


def test_bitmaps_are_of_buckets_of_several_lines(spark, monkeypatch):
    """Lines that share buckets with one other alone are verified without bitmaps."""
    r, seen, real = np.random.default_rng(14), [], line_dedup.bitmaps
    monkeypatch.setattr(line_dedup, "bitmaps", lambda lines, *a: (seen.append(lines.count()), real(lines, *a))[1])
    assert check_lines(spark, dict(enumerate(short_lines(r)))) == 0
    assert len(seen) == 1 and seen[0] < 60  # of 600 lines


def test_small_buckets_take_no_turn(spark, monkeypatch):
    """A turn is for buckets of several blocks; in others the last step meets the same lines."""
    r = np.random.default_rng(6)
    turns, real = [], line_dedup.turn_pairs
    monkeypatch.setattr(line_dedup, "turn_pairs", lambda *a: (turns.append(1), real(*a))[1])
    lines = [x for _ in range(3) for x in dict.fromkeys(one_bucket(r))][:40]
    assert check_lines(spark, dict(enumerate(lines))) == 0 and not turns
    monkeypatch.setattr(line_dedup, "TURN_BLOCK", 4)
    assert check_lines(spark, dict(enumerate(lines))) == 0 and len(turns) == line_dedup.TURNS


# Nearest neighbours.
def test_hilbert_is_a_curve():
    for dims, bits in ((2, 3), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_ann.hilbert_keys(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = np.zeros(len(x))
            for d in range(x.shape[1]):
                s += q[d] * x[:, d]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall(spark):
    from corpusmith.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = brute(v.vec_id.to_numpy(), np.stack(v.embedding.values).astype(float))
    rows = QUERIES["op2_hilbert_ann"](spark, sf).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = {q: dict(s) for q, s in want.items()}
    assert all(exact[q].get(a, s) == s for q, found in got.items() for a, s in found)
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in got.values())


def test_vector_edges(spark):
    rows = [(k, [float(k % 5), 1.0, 0.5], 0) for k in range(45)] + [(100, None, 0), (120, [0.0] * 3, 0), (140, [1.0, None, 2.0], 0), (160, [float("nan"), 1.0, 1.0], 0)]
    rows += [(180, [float("inf"), 1.0, 1.0], 0), (200, [1.0, 2.0], 0), (None, [1.0, 1.0, 1.0], 0), (20, [0.0, 1.0, 0.5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    got = {}
    for r in sorted(hilbert_ann.nearest(df, block_rows=16).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.arange(45)
    want = brute(ids, np.array([[float(k % 5), 1.0, 0.5] for k in ids]))
    assert got == want  # 20 has two vectors, of which the least counts; 200 has none beside it in its dimension
    few = df.where("vec_id in (0, 1, 2)")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in hilbert_ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert hilbert_ann.nearest(df.limit(0)).count() == 0


def test_dimensions(spark, monkeypatch):
    """Vectors of every dimension find their neighbours in it, common or rare."""
    r = np.random.default_rng(12)
    dims = {7: 300, 5: 90, 3: 41, 2: 2, 1: 1}
    vecs, at = {}, 0
    for d, n in dims.items():
        for _ in range(n):
            vecs[at] = r.normal(size=d)
            at += 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in vecs.items()], "vec_id long, embedding array<double>")
    want = {}
    for d in dims:
        ids = np.array([k for k, v in vecs.items() if len(v) == d])
        want |= {int(q): [i for i, _ in f] for q, f in brute(ids, np.stack([vecs[k] for k in ids])).items() if f}
    for share in (0.01, 0.15, 2.0):  # all but the last two searched by orderings, the two commonest, none
        monkeypatch.setattr(hilbert_ann, "COMMON", share)
        got = {}
        for x in hilbert_ann.nearest(df, block_rows=32, window=1.0).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append(x["vec_id"])
        assert got == want


# Pipeline.
def test_pipeline(spark):
    import corpus_pipeline
    from corpusmith.llm import pii, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_dedup", "pii", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    w, b = toxicity.train(docs, labels)
    bad = {r["doc_id"] for r in toxicity.score(docs, w, b).where("score >= 0.5").collect()}
    clean = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in bad}
    first = line_classes(clean)
    rest = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if first.get((k, i), (k, i)) == (k, i)) for k, t in clean.items()}
    rest = {k: t for k, t in rest.items() if t.strip() or t == clean[k]}
    keys = sorted(rest)
    v = np.array([plain_fingerprint(rest[k], 5) for k in keys], np.uint64)
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    heads = {keys[c] for c in classes(len(keys), list(zip(*np.nonzero(d <= 3), strict=True)))}
    from corpusmith.llm.encoding import CachedEncoder

    enc = CachedEncoder("word_bpe_49k.json")
    want = {k: len(enc.ids(pii._masked(rest[k], pii.model()))) // 4 + 1 for k in heads}
    got = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = messy(spark, clash=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs, _ = common.materialize(out, "stage")
    none = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_variants_of_one_line(spark):
    """A bucket that far exceeds a block, with as many components as lines that stand apart."""
    r = np.random.default_rng(11)
    words = ["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    base, texts = list(r.choice(words, 24)), []
    for _ in range(900):
        line = list(base)
        for at in r.integers(0, 24, r.integers(1, 5)):
            line[at] = str(r.choice(words))
        texts.append(" ".join(line))
    assert check_lines(spark, dict(enumerate(texts))) == 0
