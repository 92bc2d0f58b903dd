"""Queries: chat templates, token budgets, target masking and attention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import tokenizers
from corpusmith.operators import attention, chat, collation, targets
from corpusmith.plans.base import lit, query, table
from corpusmith.plans.formatting import docs
from corpusmith.plans.kernels import E_SQL, sql_draw

NUMBERED = "m AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS asked FROM conversations)"
OPEN = "role = 'assistant' AND turn > coalesce(asked, -1)"
THOUGHT = "'<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)"
TURN = f"'<|im_start|>' || role || chr(10) || CASE WHEN {OPEN} THEN {THOUGHT} ELSE '' END || text || '<|im_end|>' || chr(10)"


@query(
    "chat_prompt",
    f"WITH {NUMBERED} SELECT conv_id, string_agg({TURN}, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN '' ELSE {THOUGHT} END AS prompt FROM m GROUP BY conv_id",
)
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return rows.select("conv_id", chat.render_chat(F.col("messages"), thinking=F.col("conv_id") % 2 == 0).alias("prompt"))


@query(
    "chat_training_text",
    "SELECT conv_id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>', '' ORDER BY turn) AS rendered, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id",
)
def chat_training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return rows.select("conv_id", chat.render_chat(F.col("messages"), chat.HEADERS, False).alias("rendered"), F.size("messages").cast("long").alias("turns"))


# Targets: overlapping ones, one that is part of another, one that is blank.
TARGETS = ("the", "in the", "n", "he an", " ")
EARLIER, LAST, BASE = 0.3, 0.9, 0.05
WANTED = [t for t in TARGETS if t.strip()]
DRAWN = sql_draw(42, "r.doc_id", "i")
HITS = " UNION ALL ".join(
    f"SELECT doc_id, s AS a, s + {len(t)} AS b, {k} AS target FROM (SELECT doc_id, j, n, CAST(sum(length(x) + {len(t)}) OVER (PARTITION BY doc_id ORDER BY j) AS BIGINT) - {len(t)} AS s "
    f"FROM (SELECT doc_id, unnest(string_split(text, {lit(t)})) AS x, generate_subscripts(string_split(text, {lit(t)}), 1) AS j, len(string_split(text, {lit(t)})) AS n FROM documents)) WHERE j < n"
    for k, t in enumerate(WANTED)
)
MASKED_SQL = (
    "WITH parts AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) AS j FROM documents), "
    "toks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS i, a, a + length(w) AS b FROM (SELECT doc_id, j, w, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY j) AS BIGINT) - length(w) - 1 AS a FROM parts) WHERE w <> ''), "
    f"hits AS ({HITS}), best AS (SELECT t.doc_id, t.i, max(target) AS target FROM toks t JOIN hits h ON t.doc_id = h.doc_id AND t.a < h.b AND t.b > h.a GROUP BY t.doc_id, t.i), "
    "marked AS (SELECT doc_id, i, a, b, coalesce(target, -1) AS target FROM toks LEFT JOIN best USING (doc_id, i)), "
    "heads AS (SELECT *, lag(b, 1, 0) OVER w AS done, CASE WHEN target >= 0 AND lag(target, 1, -2) OVER w = target THEN 0 ELSE 1 END AS head FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i)), "
    "numbered AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM heads), "
    "runs AS (SELECT doc_id, run, min(i) AS i, min(a) AS a, max(b) AS b, min(done) AS done, min(target) AS target FROM numbered GROUP BY doc_id, run), "
    f"pieces AS (SELECT r.doc_id, i, substr(text, done + 1, a - done) || CASE WHEN {DRAWN} < CASE WHEN target < 0 THEN {BASE} ELSE {EARLIER} + {LAST - EARLIER} * (target / {len(WANTED) - 1}.0) END THEN '[MASK]' ELSE substr(text, a + 1, b - a) END AS piece, b, text FROM runs r JOIN documents d ON r.doc_id = d.doc_id) "
    "SELECT doc_id, string_agg(piece, '' ORDER BY i) || substr(any_value(text), max(b) + 1) AS masked FROM pieces GROUP BY doc_id"
)


@query("mask_targets", MASKED_SQL)
def mask_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(*map(F.lit, TARGETS)).alias("goals"))
    return targets.mask_targets(rows, "text", "goals", "doc_id", EARLIER, LAST, BASE).select("doc_id", "masked")


# Attention of four heads over two heads of keys and values, causal within a label; every eighth vector is one of the memory.
HEADS_SQL = (
    f"WITH {E_SQL}, z AS (SELECT q.vec_id, CAST(h AS INT) AS head, list_dot_product(q.v[h * 16 + 1:h * 16 + 16], k.v[(h // 2) * 16 + 1:(h // 2) * 16 + 16]) / 4 AS z, k.v[33 + (h // 2) * 16] AS x, k.vec_id % 8 = 0 AS memory "
    "FROM e q JOIN e k ON q.label = k.label AND k.vec_id <= q.vec_id CROSS JOIN range(4) t(h)) "
    "SELECT vec_id, head, round(sum(exp(z) * x) / sum(exp(z)), 6) AS out_first, round(coalesce(sum(exp(z)) FILTER (memory), 0) / sum(exp(z)), 6) AS memory_share FROM z GROUP BY vec_id, head"
)


def attended(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    v = F.col("embedding")
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), v.alias("vec"))
    keys = e.select("grp", "id", "pos", F.slice("vec", 1, 32).alias("key"), F.slice("vec", 33, 32).alias("value"), (F.col("id") % 8 == 0).alias("memory")).withColumnRenamed("key", "vec")
    return attention.attention(e, keys, heads=4, kv_heads=2, causal=True, **kw)


@query("attention_heads", HEADS_SQL)
def attention_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attended(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(F.arrays_zip("out", "memory_share")).alias("head", "s"))
    return rows.select("vec_id", "head", F.round(F.get("s.out", 0), 6).alias("out_first"), F.round("s.memory_share", 6).alias("memory_share"))


@query(
    "memory_attention_mass",
    f"SELECT label, head, round(avg(m), 6) AS mean_mass, CAST(count(*) AS BIGINT) AS queries FROM ({HEADS_SQL.replace('round(coalesce(sum(exp(z)) FILTER (memory), 0) / sum(exp(z)), 6) AS memory_share', 'coalesce(sum(exp(z)) FILTER (memory), 0) / sum(exp(z)) AS m')}) JOIN embeddings USING (vec_id) GROUP BY label, head",
)
def memory_attention_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attended(spark, sf_dir).select(F.col("grp").alias("label"), F.posexplode("memory_share").alias("head", "m"))
    return rows.groupBy("label", "head").agg(F.round(F.avg("m"), 6).alias("mean_mass"), F.count("*").alias("queries"))


# Token budgets and batches by a public tokenizer. SQL can't express its merges; tests hold both against the library.
def _tokenizer(name: str) -> tokenizers.Tokenizer:
    import public_tokenizers

    return tokenizers.Tokenizer(public_tokenizers.path(name))


@query("token_budget")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "head", "rest")
    found = tokenizers.within_budget(rows, "head", "rest", _tokenizer("word_bpe_49k.json"), _tokenizer("byte_bpe_50k.json"), 200, 1200)
    return found.select("doc_id", "profiler_tokens", "composer_tokens", "within")


@query("collated_batches")
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "head", "rest")
    found = collation.collated(rows, "doc_id", "head", "rest", _tokenizer("byte_bpe_50k.json"), 8, 2048)
    shown = F.filter("labels", lambda x: x != collation.HIDDEN)
    return found.select("doc_id", "batch", F.size("ids").alias("padded"), F.aggregate("attention", F.lit(0), lambda t, x: t + x).alias("n_tokens"), F.size(shown).alias("n_labels"))
