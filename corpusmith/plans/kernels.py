"""Queries: sequences, islands, schedules, masking, batching and numerical kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.functions import text
from corpusmith.functions.answers import bound
from corpusmith.operators import attention, batching, masking, reports, spans
from corpusmith.operators import kernels as K
from corpusmith.plans.base import query, sql_words, table

E_SQL = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
HALF_SQL = "h AS (SELECT vec_id, v[1:32] AS a, v[33:64] AS b FROM e)"


def sql_softmax(x: str) -> str:
    e = f"list_transform({x}, lambda z: exp(z - list_max({x})))"
    return f"list_transform({e}, lambda y: y / list_sum({e}))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))


# Sequences.
@query(
    "rle_islands",
    "SELECT conv_id, v, min(turn) AS first, max(turn) + 1 AS \"end\" FROM (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, v ORDER BY turn) AS g FROM "
    "(SELECT conv_id, turn, CASE WHEN length(text) % 3 > 0 THEN length(text) % 3 END AS v FROM conversations)) WHERE v IS NOT NULL GROUP BY conv_id, v, g",
)
def rle_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.length("text") % 3).cast("long")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(v > 0, v).alias("v"))
    return spans.islands(rows, "conv_id", "turn", "v")


@query(
    "merge_intervals",
    "SELECT user_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a <= max(b) OVER "
    "(PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM (SELECT user_id, event_id AS a, event_id + CAST(floor(value) AS BIGINT) % 200 + 1 AS b FROM events))) GROUP BY user_id, g",
)
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.floor("value") % 200 + 1).alias("b"))
    return spans.merge_intervals(rows, "user_id", "a", "b")


@query(
    "nucleus_filter",
    f"WITH {E_SQL}, p AS (SELECT vec_id, i, x, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS prob FROM (SELECT vec_id, unnest(v) * 8 AS x, generate_subscripts(v, 1) - 1 AS i FROM e)) "
    "SELECT vec_id, CAST(i AS INT) AS tok, round(prob, 6) AS prob FROM (SELECT *, coalesce(sum(prob) OVER (PARTITION BY vec_id ORDER BY x DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM p) WHERE m <= 0.9",
)
def nucleus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("tok", "x")).withColumn("x", F.col("x") * 8)
    return K.nucleus(rows, "vec_id", "tok", "x", 0.9).select("vec_id", "tok", F.round("prob", 6).alias("prob"))


@query(
    "prefix_sum_span_mean",
    f"WITH {E_SQL} SELECT vec_id, CAST(k * 7 AS INT) AS start, CAST(k * 7 + 5 + k AS INT) AS \"end\", round(list_avg(v[k * 7 + 1:k * 7 + 5 + k]), 6) AS mean FROM e CROSS JOIN range(5) t(k)",
)
def prefix_sum_span_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    points = rows.select("vec_id", F.posexplode("v").alias("pos", "value"))
    k = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    ranges = rows.select("vec_id", k).select("vec_id", (F.col("k") * 7).alias("start"), (F.col("k") * 8 + 5).alias("end"))
    return spans.span_mean(points, ranges, "vec_id").withColumn("mean", F.round("mean", 6))


@query("causal_pairs", "SELECT q.conv_id, q.turn, count(*) AS visible, CAST(sum(length(k.text)) AS BIGINT) AS chars FROM conversations q JOIN conversations k ON q.conv_id = k.conv_id AND k.turn <= q.turn GROUP BY q.conv_id, q.turn")
def causal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(so_far).alias("visible"), F.sum(F.length("text")).over(so_far).alias("chars"))


@query("linear_schedule", "SELECT conv_id, turn, 0.3 + (0.8 - 0.3) * least((turn / greatest(max(turn) OVER (PARTITION BY conv_id), 1)), 1.0) AS prob FROM conversations".replace("0.3 +", "0.3::DOUBLE +").replace("(0.8 - 0.3)", "(0.8::DOUBLE - 0.3::DOUBLE)"))
def linear_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", K.linear_schedule(F.col("turn"), last, 0.3, 0.8).alias("prob"))


@query(
    "weight_schedule",
    "SELECT conv_id, turn, round(CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN n = 2 THEN CASE WHEN turn = 0 THEN 0.3::DOUBLE ELSE 1.0 END WHEN n = 3 THEN CASE WHEN turn = 0 THEN 0.2::DOUBLE WHEN turn = 1 THEN 0.5 ELSE 1.0 END "
    "ELSE 0.2 + 0.8 * turn / (n - 1) END, 9) AS w FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)",
)
def weight_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(K.alignment_weight(F.col("turn"), n), 9).alias("w"))


@query("substring_spans", "SELECT doc_id, array_to_string(list_transform(range(1, len(p)), lambda i: length(array_to_string(p[1:i], 'the'))), ',') AS starts FROM (SELECT doc_id, string_split(text, 'the') AS p FROM documents)")
def substring_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(spans.substring_starts(F.col("text"), F.lit("the")), ",").alias("starts"))


@query(
    "find_subsequence",
    f"SELECT doc_id, CAST(list_filter(range(0, greatest(len(w) - 1, 0)), lambda i: w[i + 1] = 'of' AND w[i + 2] = 'the')[1] AS INT) AS place FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)",
)
def find_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return rows.select("doc_id", spans.find_subsequence(F.col("w"), F.array(F.lit("of"), F.lit("the"))).alias("place"))


DIST_SQL = "CASE WHEN s > 0 THEN list_transform(c, lambda x: x / s) ELSE list_transform(c, lambda x: 1.0 / len(c)) END"


@query(
    "normalize_dist",
    f"WITH {E_SQL} SELECT vec_id, round(({DIST_SQL})[1], 9) AS first, round(({DIST_SQL})[64], 9) AS last FROM (SELECT vec_id, c, list_sum(c) AS s FROM (SELECT vec_id, list_transform(v, lambda x: greatest(x, 0)) AS c FROM e))",
)
def normalize_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", spans.normalize_distribution(F.col("v")).alias("d"))
    return rows.select("vec_id", F.round(F.get("d", 0), 9).alias("first"), F.round(F.get("d", 63), 9).alias("last"))


@query(
    "renormalize_surviving",
    f"WITH {E_SQL} SELECT vec_id, CAST(len(c) AS INT) AS n, round(CASE WHEN list_sum(c) > 0 THEN c[1] / list_sum(c) ELSE 1.0 / len(c) END, 9) AS first FROM (SELECT vec_id, list_transform(list_filter(v, lambda x, i: i % 3 <> 0), lambda x: greatest(x, 0)) AS c FROM e)",
)
def renormalize_surviving(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter("v", lambda x, i: (i + 1) % 3 != 0)
    rows = vectors(spark, sf_dir).select("vec_id", spans.normalize_distribution(kept).alias("d"))
    return rows.select("vec_id", F.size("d").alias("n"), F.round(F.get("d", 0), 9).alias("first"))


# Masking.
def sql_draw(seed: int, row: str, place: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({row} AS VARCHAR) || ':' || CAST({place} AS VARCHAR)), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE"


@query(
    "mask_tokens",
    f"SELECT conv_id, turn, coalesce(array_to_string(list_transform(w, lambda t, i: CASE WHEN regexp_matches(t, '[A-Z0-9]') AND {sql_draw(42, 'conv_id', 'i - 1')} < 0.5 THEN '[MASK]' ELSE t END), ' '), '') AS masked "
    f"FROM (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations)",
)
def mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", masking.mask_tokens(F.col("text"), F.col("conv_id"), 0.5).alias("masked"))


@query("mask_spans", "SELECT doc_id, replace(text, 'the', '[MASK]') AS all_masked, text AS none_masked FROM documents")
def mask_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, row = F.col("text"), F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", masking.mask_words_of(t, F.lit("the"), row, 1.0, 0.0).alias("all_masked"), masking.mask_words_of(t, F.lit("the"), row, 0.0, 0.0).alias("none_masked")
    )


# Batching.
IDS_SQL = f"ids AS (SELECT doc_id, doc_id // 8 AS batch, list_transform({sql_words('text')}, lambda w: CAST(length(w) AS INT))[1:50] AS ids FROM documents)"


def word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(text.words(F.col("text")), F.length)
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), ids.alias("ids"))


@query("pad_truncate", f"WITH {IDS_SQL} SELECT doc_id, batch, array_to_string(ids || list_transform(range(max(len(ids)) OVER (PARTITION BY batch) - len(ids)), lambda x: -1), ',') AS ids FROM ids")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batching.pad_truncate(word_ids(spark, sf_dir), "ids", "batch", 50, -1)
    return rows.select("doc_id", "batch", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("label_mask", f"WITH all_ids AS (SELECT doc_id, list_transform({sql_words('text')}, lambda w: CAST(length(w) AS INT)) AS ids FROM documents) SELECT doc_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= 10 OR x = 3 THEN -100 ELSE x END), ',') AS labels FROM all_ids")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = batching.label_mask(F.col("ids"), F.lit(10), 3)
    return word_ids(spark, sf_dir).select("doc_id", F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"))


@query(
    "ragged_transpose",
    f"SELECT doc_id // 8 AS batch, CAST(i - 1 AS INT) AS target_idx, count(*) AS active, min_by(w, doc_id) AS first_target, max_by(w, doc_id) AS last_target FROM (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {sql_words('text')} AS p FROM documents)) GROUP BY ALL",
)
def ragged_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), text.words(F.col("text")).alias("p"))
    return batching.ragged_transpose(rows, "batch", "doc_id", "p")


# Kernels.
@query("mean_pool", f"WITH {E_SQL} SELECT label, CAST(i - 1 AS INT) AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.mean_pool(vectors(spark, sf_dir), "label", "v").withColumn("mean", F.round("mean", 6))


@query("vector_stats", f"WITH {E_SQL} SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS l2, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS sd FROM e")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, n = F.col("v"), F.size("v")
    rows = vectors(spark, sf_dir).select("vec_id", "v", (K.total(v) / n).alias("mean"))
    sd = bound(lambda s: F.sqrt(K.total(F.transform(s["v"], lambda x: (x - s["mean"]) * (x - s["mean"]))) / F.size(s["v"])), v=v, mean=F.col("mean"))
    return rows.select("vec_id", F.round(K.l2(v), 6).alias("l2"), F.round("mean", 6).alias("mean"), F.round(sd, 6).alias("sd"))


COS_SQL = "list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))"


@query("cosine_similarity", f"WITH {E_SQL}, {HALF_SQL} SELECT vec_id, round({COS_SQL}, 6) AS cosine FROM h")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halves(spark, sf_dir).select("vec_id", F.round(K.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("align_loss", f"WITH {E_SQL}, {HALF_SQL} SELECT label, round(sum(w * (1 - c)) / sum(w), 6) AS loss FROM (SELECT e.label, 1.0 + vec_id % 3 AS w, {COS_SQL} AS c FROM h JOIN e USING (vec_id)) GROUP BY label")
def align_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = 1.0 + F.col("vec_id") % 3
    rows = vectors(spark, sf_dir).select("label", w.alias("w"), K.cosine(F.slice("v", 1, 32), F.slice("v", 33, 32)).alias("c"))
    return rows.groupBy("label").agg(F.round(F.sum(F.col("w") * (1 - F.col("c"))) / F.sum("w"), 6).alias("loss"))


P_SQL = f"p AS (SELECT vec_id, {sql_softmax('a')} AS t, {sql_softmax('b')} AS s FROM h)"


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halves(spark, sf_dir).select("vec_id", K.softmax(F.col("a")).alias("t"), K.softmax(F.col("b")).alias("s"))


@query("masked_softmax", f"WITH {E_SQL}, {HALF_SQL} SELECT vec_id, round(({sql_softmax('a')})[1], 9) AS first, round(list_max({sql_softmax('a')}), 9) AS top FROM h")
def masked_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions(spark, sf_dir).select("vec_id", F.round(F.get("t", 0), 9).alias("first"), F.round(F.array_max("t"), 9).alias("top"))


@query("entropy", f"WITH {E_SQL}, {HALF_SQL}, {P_SQL} SELECT vec_id, round(-list_sum(list_transform(t, lambda x: x * ln(x))), 6) AS entropy FROM p")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions(spark, sf_dir).select("vec_id", F.round(K.entropy(F.col("t")), 6).alias("entropy"))


@query("kl_divergence", f"WITH {E_SQL}, {HALF_SQL}, {P_SQL} SELECT vec_id, round(list_sum(list_transform(list_zip(t, s), lambda z: z[1] * (ln(z[1]) - ln(greatest(z[2], 1e-8))))), 6) AS kl FROM p")
def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions(spark, sf_dir).select("vec_id", F.round(K.kl_divergence(F.col("t"), F.col("s")), 6).alias("kl"))


@query(
    "topk_overlap",
    f"WITH {E_SQL}, {HALF_SQL}, r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS ra, row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, i) AS rb "
    "FROM (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) AS i FROM h)) SELECT vec_id, round(count(*) FILTER (ra <= 3 AND rb <= 3) / 3.0, 6) AS overlap, CAST(max(CASE WHEN ra = 1 AND rb = 1 THEN 1 ELSE 0 END) AS INT) AS top1 FROM r GROUP BY vec_id",
)
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    top1 = (F.get(K.top_places(a, 1), 0) == F.get(K.top_places(b, 1), 0)).cast("int")
    return halves(spark, sf_dir).select("vec_id", F.round(K.topk_overlap(a, b), 6).alias("overlap"), top1.alias("top1"))


ATTENTION_SQL = (
    f"WITH {E_SQL}, s AS (SELECT q.vec_id, k.vec_id AS key_id, list_dot_product(q.v, k.v) / 8 AS z, k.v[1] AS x FROM e q JOIN e k ON q.label = k.label AND k.vec_id <= q.vec_id) "
    "SELECT vec_id, round(sum(exp(z) * x) / sum(exp(z)), 6) AS out FROM s GROUP BY vec_id"
)


@query("attention_demo", ATTENTION_SQL)
def attention_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal attention within a label, of one head."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    found = attention.attention(e, e.withColumns({"value": F.col("vec"), "memory": F.lit(False)}), causal=True)
    return found.select(F.col("id").alias("vec_id"), F.round(F.get(F.get("out", 0), 0), 6).alias("out"))


@query(
    "matmul_join",
    f"WITH {E_SQL} SELECT vec_id, CAST(j AS INT) AS slot, round(sum(x * (((i * 7 + j * 3) % 11) / 11.0)), 6) AS y FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e) CROSS JOIN range(4) t(j) GROUP BY vec_id, j",
)
def matmul_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.range(64 * 4).select((F.col("id") % 64).cast("int").alias("i"), F.floor(F.col("id") / 64).cast("int").alias("slot"))
    weights = weights.withColumn("w", ((F.col("i") * 7 + F.col("slot") * 3) % 11) / 11.0)
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("i", "x")).join(F.broadcast(weights), "i")  # 256 rows
    return rows.groupBy("vec_id", "slot").agg(F.round(F.sum(F.col("x") * F.col("w")), 6).alias("y"))


@query("weighted_loss_sum", f"WITH {E_SQL}, {HALF_SQL} SELECT vec_id, round(1.0 * abs(a[1]) + 0.5 * (1 - {COS_SQL}) + 0.1 * abs(b[1]), 6) AS loss FROM h")
def weighted_loss_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    loss = F.abs(F.get(a, 0)) + 0.5 * (1 - K.cosine(a, b)) + 0.1 * F.abs(F.get(b, 0))
    return halves(spark, sf_dir).select("vec_id", F.round(loss, 6).alias("loss"))


@query("l1_l2_norms", f"WITH {E_SQL} SELECT label, round(avg(list_avg(list_transform(v, lambda x: abs(x)))), 6) AS l1, round(avg(list_avg(list_transform(v, lambda x: x * x))), 6) AS l2 FROM e GROUP BY label")
def l1_l2_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    l1, sq = K.total(F.transform(v, F.abs)) / F.size(v), K.dot(v, v) / F.size(v)
    return vectors(spark, sf_dir).groupBy("label").agg(F.round(F.avg(l1), 6).alias("l1"), F.round(F.avg(sq), 6).alias("l2"))




@query(
    "gated_queries",
    f"WITH {E_SQL}, {HALF_SQL} SELECT vec_id, round(a[1] + b[1] / (1 + exp(-a[1])), 6) AS q_first, round(b[32] + a[32] / (1 + exp(-b[1])), 6) AS q_last FROM h",
)
def gated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    q = K.gated_queries(F.array(a, b), F.array(F.get(a, 0), F.get(b, 0)), F.array(b, a))
    rows = halves(spark, sf_dir).select("vec_id", q.alias("q"))
    return rows.select("vec_id", F.round(F.get(F.get("q", 0), 0), 6).alias("q_first"), F.round(F.get(F.get("q", 1), 31), 6).alias("q_last"))


@query(
    "teacher_relevance",
    f"WITH {E_SQL}, m AS (SELECT vec_id, list_transform(range(10), lambda i: (v[vec_id % 20 + i + 1] + v[64 - vec_id % 20 - i]) / 2) AS m FROM e), "
    "s AS (SELECT vec_id, greatest(list_sum(m[1:3]), 0) AS a, greatest(list_sum(m[4:10]), 0) AS b FROM m) "
    "SELECT vec_id, round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END, 6) AS head, round(CASE WHEN a + b > 0 THEN b / (a + b) ELSE 0.5 END, 6) AS tail FROM s",
)
def teacher_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("vec_id") % 20).cast("int")
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    found = K.teacher_relevance(F.sequence(F.lit(0), F.lit(63)), F.sequence(k, k + 9), F.array(F.reverse("v"), "v", F.reverse("v")), F.array(span(0, 3), span(3, 10)), 2)
    rows = vectors(spark, sf_dir).select("vec_id", found.alias("r"))
    return rows.select("vec_id", F.round(F.get("r", 0), 6).alias("head"), F.round(F.get("r", 1), 6).alias("tail"))


@query("loss_metrics", "SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS loss_ans, CAST(l_tax AS DOUBLE) AS loss_align, CAST(NULL AS DOUBLE) AS loss_rat FROM lineitem")
def loss_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = {"answer_loss": F.col("l_discount"), "mh_align_loss": F.array("l_tax"), "rationale_loss": F.array("l_tax", "l_discount"), "other": F.col("l_quantity")}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in outputs.items()))
    return reports.loss_metrics(rows, "l_orderkey", "l_linenumber")
