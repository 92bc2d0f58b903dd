import pytest
from helpers_core import one
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmith.operators import formatters as fmt
from corpusmith.operators import jobs, kernels, masking, prompts, reports, sampling, spans


def test_blend_counts():
    assert sampling.blend_counts((50, 35, 15), 200_000) == [100_000, 70_000, 30_000]
    assert sampling.blend_counts((4, 4, 2), 11) == [5, 4, 2]
    assert sampling.blend_counts((4, 4, 2), None, (100, 90, 10)) == [20, 20, 10]
    for bad in (((), 5), ((1, 0), 5), ((1, 1), 0)):
        with pytest.raises(ValueError):
            sampling.blend_counts(*bad)
    with pytest.raises(ValueError):
        sampling.blend_counts((1, 1), None)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=4), st.integers(1, 500))
def test_blend_counts_add_up(ratios, n):
    assert sum(sampling.blend_counts(ratios, n)) == n


@pytest.mark.parametrize(("n", "k", "want"), [(10, 4, [(0, 3), (3, 6), (6, 8), (8, 10)]), (2, 3, [(0, 1), (1, 2), (2, 2)])])
def test_shards(spark, n, k, want):
    assert [sampling.shard_range(n, k, i) for i in range(k)] == want
    rows = spark.range(n).select("id", sampling.shard_of(F.col("id"), n, k).alias("s")).collect()
    assert all(want[r["s"]][0] <= r["id"] < want[r["s"]][1] for r in rows)


def test_split(spark):
    rows = sampling.train_eval_split(spark.range(100).withColumnRenamed("id", "k"), "k").collect()
    again = sampling.train_eval_split(spark.range(100).withColumnRenamed("id", "k").repartition(7), "k").collect()
    split = {r["k"]: r["split"] for r in rows}
    assert len(split) == 100 and sum(v == "eval" for v in split.values()) == 2
    assert split == {r["k"]: r["split"] for r in again}
    assert sampling.eval_size(10, 0.02) == 1
    for n, t in ((1, 0.02), (10, 0), (10, 1)):
        with pytest.raises(ValueError):
            sampling.eval_size(n, t)


def test_row_index(spark):
    rows = sampling.with_row_index(spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(9), "k", n_ranges=6)
    assert all(r["k"] == r["row_idx"] for r in rows.collect()) and rows.count() == 1000
    assert sampling.with_row_index(spark.range(0).withColumnRenamed("id", "k"), "k").count() == 0


def test_sampling_counts(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("s"))
    assert {r["s"]: r["count"] for r in sampling.sample_per_source(rows, "s", "k", 5).groupBy("s").count().collect()} == {"0": 5, "1": 5, "2": 5}
    assert sampling.ratio_blend(rows, "s", "k", {"0": 4, "2": 40}).groupBy("s").count().collect() in ([("0", 4), ("2", 33)], [("2", 33), ("0", 4)])
    assert sampling.sample_with_replacement(rows, "k", 250).count() == 250
    assert sampling.sample_with_replacement(rows.limit(0), "k", 5).count() == 0
    with pytest.raises(ValueError):
        sampling.sample_per_source(rows, "s", "k", 0)


def test_formatters(spark):
    n = F.lit(None).cast("string")
    assert one(spark, fmt.instruction_prompt(n, F.lit(""))) == "None"
    assert one(spark, fmt.instruction_prompt(F.lit("a"), F.lit("b"))) == "a\n\nInput:\nb"
    assert one(spark, fmt.instruction_prompt(F.lit(""), F.lit("b"))) == "b"
    assert one(spark, fmt.query_context_prompt(F.lit("q"), F.lit(" c "))) == "q\n\nContext:\nc"
    assert one(spark, fmt.problem_prompt(n)) == "Problem:"
    assert one(spark, fmt.either(F.lit(""), F.lit(" "), F.lit("x"))) == " "
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.lit("a").alias("content")))
    assert [one(spark, c) for c in fmt.first_pair(msgs)] == ["", ""]
    assert fmt.context_entries([["t", ["a", " ", None]], {"name": "n", "text": " x "}, {"title": ""}, 5, {"title": "", "sentences": []}]) == [("t", ["a"]), ("n", ["x"])]


def test_multihop(spark):
    rows = spark.createDataFrame([("q?", [("t", ["a", " "]), ("", ["b"]), (None, [])])], "q string, c array<struct<title:string,sentences:array<string>>>")
    assert rows.select(fmt.multihop_prompt(F.col("q"), F.col("c"))).first()[0] == "Question:\nq?\n\nContext:\n[t]\na\n\n[Untitled]\nb"
    rows = spark.createDataFrame([("q?", None)], "q string, c array<struct<title:string,sentences:array<string>>>")
    assert rows.select(fmt.multihop_prompt(F.col("q"), F.col("c"))).first()[0] == "Question:\nq?\n\nContext:"


def test_visible_prompt(spark):
    with pytest.raises(Exception, match="unknown mode"):
        one(spark, fmt.visible_prompt(F.lit("odd"), F.lit("a"), F.lit("b")))


def test_prompts(spark):
    q = F.lit("1+1?")
    assert one(spark, prompts.reread_prompt(q, "gsm", "cot", 2)).startswith("\nQ: 1+1? \n\nRead the question again: 1+1?\n\nYour final")
    assert one(spark, prompts.reread_prompt(q, "gsm", "cot", 1)).endswith("\nA: Let's think step by step.")
    assert one(spark, prompts.reread_prompt(q, "gsm", "vanilla", 1)).endswith("\nA:")
    assert "# Read the question again: 1+1?" in one(spark, prompts.reread_prompt(q, "gsm", "pal", 2))
    for bad in (("gsm", "odd", 1), ("gsm", "cot", 0), ("aqua", "pal", 1)):
        with pytest.raises(ValueError):
            prompts.reread_prompt(q, *bad)
    assert one(spark, prompts.flat_choice_question(F.lit("q"), F.array(F.lit("A)21"), F.lit("B)22")))) == "q Answer Choices: (A) 21 (B) 22"
    assert one(spark, prompts.normalize_name(F.lit("d/arc-e.jsonl"))) == "arc_e"
    with pytest.raises(Exception, match="unknown dataset"):
        one(spark, prompts.known_name(F.lit("arc-e")))
    with pytest.raises(Exception, match="unknown act"):
        one(spark, prompts.supports_act(F.lit("odd"), F.lit(True)))


def test_jobs(spark):
    names = [d[0] for d in prompts.DATASETS]
    assert jobs.benchmark_jobs(spark, names, ("vanilla", "cot"), (1, 2), ("m",), "p").count() == 104
    assert jobs.benchmark_jobs(spark, ["aqua", "gsm"], ("pal",), (1,), ("m",), None).count() == 1
    assert jobs.heldout_jobs(spark, ("m",), ("base_no_hint", "base_prompt_twice"), "p", (True, False)).count() == 8
    with pytest.raises(ValueError):
        jobs.benchmark_jobs(spark, names, ("odd",), (1,), (), "p")


def test_segment():
    assert spans.segment(" \n ") == []
    text = "Intro:\n" + "This is a sentence that is long enough. " * 3 + "\n[Title]\nok"
    found = spans.segment(text)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!:[]\n", max_size=300))
def test_segment_covers(text):
    found = spans.segment(text)
    gaps = [0, *(x for s in found for x in s), len(text)]
    assert all(not text[a:b].strip() for a, b in zip(gaps[::2], gaps[1::2], strict=True))


def test_spans(spark):
    t = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 5), (1, 2, 6, 9), (1, 3, 9, 9)], "d int, tok int, tok_start int, tok_end int")
    s = spark.createDataFrame([(1, 0, 3, 9), (1, 1, 5, 6)], "d int, span int, start int, end int")
    assert [tuple(r) for r in spans.token_spans(t, s, "d").collect()] == [(1, 0, 1, 3)]
    f = lambda h, n, at=0: one(spark, spans.find_subsequence(F.lit(h) if h else F.array().cast("array<int>"), F.lit(n) if n else F.array().cast("array<int>"), at))
    assert f([1, 2, 3, 2, 3], [2, 3]) == 1 and f([1, 2, 3, 2, 3], [2, 3], 2) == 3
    assert f([1], [2]) is None and f([1], []) is None and f([], [1]) is None and f([1], [1, 2]) is None


def test_distribution(spark):
    d = lambda a: one(spark, spans.normalize_distribution(F.lit(a) if a else F.array().cast("array<double>")))
    assert d([-1.0, 1.0, 3.0]) == [0, 0.25, 0.75] and d([0.0, 0.0]) == [0.5, 0.5] and d([]) == []


def test_masking(spark):
    t, row = F.lit("Ada met 3 cats in Rome"), F.lit(5)
    assert one(spark, masking.mask_tokens(t, row, 1.0)) == "[MASK] met [MASK] cats in [MASK]"
    assert one(spark, masking.mask_tokens(t, row, 0.0)) == "Ada met 3 cats in Rome"
    assert one(spark, masking.mask_tokens(t, row, 0.5, 1)) == one(spark, masking.mask_tokens(t, row, 0.5, 1))
    assert one(spark, masking.mask_words_of(F.lit("a.b a.b c"), F.lit("a.b"), row, 1.0, 0.0)) == "[MASK] [MASK] c"
    assert abs(one(spark, masking.target_probability(F.lit(1), F.lit(3), 0.25, 0.8)) - 0.525) < 1e-12
    assert one(spark, masking.target_probability(F.lit(0), F.lit(1), 0.25, 0.8)) == 0.8


def test_kernels(spark):
    assert [round(x, 3) for x in kernels.alignment_weights(4)] == [0.2, 0.467, 0.733, 1.0]
    assert kernels.alignment_weights(0) == [] and kernels.alignment_weights(2) == [0.3, 1.0]
    for n in (1, 2, 3, 5):
        assert [round(one(spark, kernels.alignment_weight(F.lit(i), F.lit(n))), 9) for i in range(n)] == [round(x, 9) for x in kernels.alignment_weights(n)]
    assert one(spark, kernels.cosine(F.lit([0.0]), F.lit([1.0]))) is None
    assert one(spark, kernels.top_places(F.lit([1.0, 3.0, 3.0]), 2)) == [1, 2]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate([5.0, 1.0, 0.0])], "g int, t int, x double")
    assert [r["t"] for r in kernels.nucleus(rows, "g", "t", "x", 0.0).collect()] == [0]


def test_reports(spark):
    rows = spark.createDataFrame([("a", "1", "1", 1, 1, 0), ("a", None, "2", 0, 0, 1)], "d string, strict_parsed string, relaxed_parsed string, strict_score int, relaxed_score int, no_boxed int")
    r = reports.summarize_runs(rows, "d").first()
    assert (r["num_samples"], r["strict_accuracy"], r["strict_null_num"], r["no_boxed_rate"]) == (2, 0.5, 1, 0.5)
    none = reports.summarize_runs(rows.limit(0)).first()
    assert (none["num_samples"], none["accuracy"]) == (0, 0.0)
    means = reports.metric_means(spark.createDataFrame([(1.0, 0.5), (0.0, 1.0)], "exact_match double, token_f1 double")).first()
    assert (means["exact_match"], means["token_f1"]) == (0.5, 0.75)
    u = reports.union_sorted([spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([(2,)], "a int")])
    assert u.columns == ["a", "b"] and u.count() == 2
    assert one(spark, reports.no_boxed(F.lit("x"), F.lit("cot"))) == 1
    assert one(spark, reports.no_boxed(F.lit("x"), F.lit("pal"))) == 0


def test_group_index(spark):
    """One group holds most rows; ties and null groups are numbered as well."""
    rows = [("hot" if k % 10 else f"s{k % 3}" if k % 4 else None, k % 50, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, a int, k int")
    got = {}
    for r in sampling.with_group_index(df.repartition(7), "g", "a", "k").collect():
        got.setdefault(r["g"], []).append((r["draw"], r["a"], r["k"]))
    assert sum(map(len, got.values())) == 3000
    for found in got.values():
        found.sort()
        assert [d for d, _, _ in found] == list(range(1, len(found) + 1))
        assert [(a, k) for _, a, k in found] == sorted((a, k) for _, a, k in found)


def test_gated_queries(spark):
    import math

    vec = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    got = one(spark, kernels.gated_queries(F.array(vec(1, 2), vec(3, 4)), vec(0, 50), F.array(vec(2, 4), vec(1, -1))))
    assert [[round(v, 9) for v in row] for row in got] == [[2.0, 4.0], [4.0, 3.0]]
    got = one(spark, kernels.rms_norm(vec(3, 4)))
    assert all(abs(a - b / math.sqrt(12.5)) < 1e-6 for a, b in zip(got, (3, 4), strict=True))


def test_teacher_relevance(spark):
    ints = lambda *x: F.array(*(F.lit(v) for v in x))
    vec = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    layers = F.array(vec(9, 9, 9, 9, 9), vec(0, 1, 2, 3, 0), vec(0, 3, 2, 1, 0))
    spans = F.array(span(0, 1), span(1, 3), span(3, 3))
    got = one(spark, kernels.teacher_relevance(ints(7, 1, 2, 3, 8), ints(1, 2, 3), layers, spans, 2))
    assert [round(v, 9) for v in got] == [round(2 / 6, 9), round(4 / 6, 9), 0.0]
    assert one(spark, kernels.teacher_relevance(ints(7, 1), ints(5), layers, spans, 2)) is None


@pytest.fixture
def apart(spark):
    """No partitions are folded into one, as on large inputs."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_indexes_are_permutations(spark, apart):
    n = 1_000_000
    key = F.xxhash64("id")
    df = spark.range(n).select(key.alias("k"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 1000).cast("string")).alias("g")).repartition(8)
    whole = F.sum(F.col("i").cast("decimal(38,0)"))
    found = sampling.with_row_index(df, "k", name="i").agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i"), F.count("text"))
    assert tuple(found.first()) == (n, n, 0, n - 1, n)
    inside = sampling.with_group_index(df, "g", "k", name="i").groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.min("i").alias("a"), F.max("i").alias("b"), whole.alias("s"))
    assert inside.where("n <> d or a <> 1 or b <> n or s <> n * (n + 1) / 2").count() == 0 and inside.agg(F.sum("n")).first()[0] == n
    split = {r["split"]: r["count"] for r in sampling.train_eval_split(df, "k").groupBy("split").count().collect()}
    assert split == {"train": 980_000, "eval": 20_000}
    blend = {r["g"]: r["count"] for r in sampling.ratio_blend(df, "g", "k", {"hot": 500_000, "3": 7, "999": 10**6}).groupBy("g").count().collect()}
    assert blend == {"hot": 500_000, "3": 7, "999": 334}
    shards = sampling.with_row_index(df, "k").groupBy(sampling.shard_of(F.col("row_idx"), n, 7).alias("s")).count().collect()
    assert sorted(r["count"] for r in shards) == [142_857] * 6 + [142_858]
    assert sampling.sample_with_replacement(df, "k", 50_000).select("draw_idx").distinct().count() == 50_000


def test_index_follows_order_with_nulls_and_ties(spark, apart):
    rows = [(k % 50 if k % 7 else None, str(k % 11), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b string, c long")
    found = sampling.with_row_index(df, "a", "b", "c", n_ranges=9).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert {(r["a"], r["b"], r["c"]): r["row_idx"] for r in found} == {r: k for k, r in enumerate(want)}
    tied = sampling.with_row_index(df, "a", n_ranges=9).collect()
    assert sorted(r["row_idx"] for r in tied) == list(range(3000))


@pytest.mark.parametrize("name", ["heldout_eval", "sample_projection", "shard_merge", "zip_join", "train_eval_split", "shard_ranges_ntile", "batch_ids", "ratio_blend", "blend_50_35_15", "blend_4_4_2", "sample_with_replacement"])
def test_indexed_queries_apart(spark, apart, name, monkeypatch):
    import duckdb
    from test_oracle import TABLES, rows

    from corpusmith.plans.registry import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.1"
    monkeypatch.setattr(sampling, "ROWS_A_RANGE", 500)  # many ranges
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ran = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in ran.description]
    found = QUERIES[name](spark, sf)
    assert rows(found.columns, found.collect()) == rows(names, ran.fetchall())


def test_ragged_transpose_shuffles_no_row_for_a_target(spark):
    from corpusmith.operators import batching

    rows = [(1, 5, ["a", None, "c"]), (1, 2, ["x"]), (1, 3, None), (1, 4, []), (2, 9, []), (None, 1, ["n"]), (3, 1, ["q", "r"]), (3, 1, ["b"])]
    found = batching.ragged_transpose(spark.createDataFrame(rows, "b int, k int, t array<string>"), "b", "k", "t")
    assert found.columns == ["b", "target_idx", "active", "first_target", "last_target"]
    assert {tuple(r) for r in found.collect()} == {(1, 0, 2, "x", "a"), (1, 1, 1, None, None), (1, 2, 1, "c", "c"), (None, 0, 1, "n", "n"), (3, 0, 2, "b", "q"), (3, 1, 1, "r", "r")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # targets are listed after the shuffle


def test_segment_spans_are_numbers(spark):
    from corpusmith.operators import spans

    texts = [None, "", "One line here.\n\nHead:\nwhat follows it is this. " + "And a long sentence. " * 9, "é \U0001f600 b" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {r["k"]: [tuple(x) for x in r["s"]] for r in df.select("k", spans.segment_spans("t").alias("s")).collect()}
    assert found == {k: spans.segment(t) for k, t in enumerate(texts)}
    assert spans.segment_spans.evalType == 250  # Arrow arrays, no dict for each span


def test_tokens_are_not_shuffled(spark):
    """Overlaps are found within a document's row; what is shuffled for targets are pieces of it."""
    from corpusmith.plans.registry import QUERIES

    plans = {q: QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for q in ("span_sum", "overlap_join_spans", "token_target_max")}
    assert {q: p.count("Exchange") for q, p in plans.items()} == {"span_sum": 0, "overlap_join_spans": 0, "token_target_max": 1}, plans


def test_targets_of_overlapping_spans(spark):
    tokens = [(0, 3), (3, 3), (4, 9), (9, 10), (12, 12), (13, 20)]
    marked = [(2, 5, 4), (4, 20, 2), (4, 4, 9), (10, 13, 7), (19, 30, 1)]
    kind = "k long, t array<struct<start: int, end: int>>, s array<struct<start: int, end: int, target: long>>"
    df = spark.createDataFrame([(1, tokens, marked), (2, tokens, []), (3, [(0, 0)], marked)], kind)
    found = sorted(tuple(r) for r in spans.token_targets(df, "k", "t", "s").collect())
    want = lambda t, s: [max((c for a, b, c in s if a < b and x < y and x < b and y > a), default=None) for x, y in t]
    assert found == [(k, i, v) for k, t, s in ((1, tokens, marked), (2, tokens, []), (3, [(0, 0)], marked)) for i, v in enumerate(want(t, s))]
