"""Queries: sources, sinks, row formatters, filters and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import text
from corpusmith.operators import formatters as fmt
from corpusmith.operators import masking, prompts, reports, sampling, spans
from corpusmith.plans.base import LABELS_SQL, OPTIONS, OPTIONS_SQL, lit, query, responses, sql_strip, sql_words, table, with_responses
from corpusmith.sources import tables

# Documents as instruction rows: the first line is the instruction, the rest the input.
DOC_SQL = "SELECT doc_id, source, lang, text, string_split(text, chr(10))[1] AS head, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) END AS rest FROM documents"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.instr("text", "\n")
    rest = F.when(at > 0, F.substring(F.col("text"), at + 1, F.length("text")))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.substring_index("text", "\n", 1).alias("head"), rest.alias("rest"))


NONE = lambda x: f"coalesce({x}, 'None')"
EMPTY = lambda x: f"coalesce({x}, '')"


@query("scan_limit_first_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def scan_limit_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_n(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


def _catalog_sql() -> str:
    cell = lambda v: str(v).lower() if isinstance(v, bool) else lit(v)
    rows = ", ".join("(" + ", ".join(map(cell, d)) + ")" for d in prompts.DATASETS)
    return f"(SELECT * FROM (VALUES {rows}) c(dataset_name, file_name, prompt_family, category, answer_kind, dataset_label, supports_pal))"


CATALOG_SQL = _catalog_sql()


ALIAS_SQL = "CASE y " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in prompts.ALIASES.items()) + " ELSE y END"
RAW_SQL = "CASE doc_id % 4 WHEN 0 THEN 'Data/' || upper(source) || '.jsonl' WHEN 1 THEN 'arc-e' WHEN 2 THEN lang || '/CSQA.JSONL' ELSE 'coin-flip-' || source END"


@query("normalize_name", f"SELECT doc_id, {ALIAS_SQL} AS name FROM (SELECT doc_id, replace(regexp_replace(lower(string_split({RAW_SQL}, '/')[-1]), '\\.jsonl$', ''), '-', '_') AS y FROM documents)")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", prompts.normalize_name(F.expr(RAW_SQL)).alias("name"))


@query(
    "union_two_sources",
    "SELECT source, key, body FROM (SELECT 'documents' AS source, doc_id AS key, text AS body FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)",
)
def union_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("key"), F.col("text").alias("body"))
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("key"), F.col("text").alias("body"))
    return a.unionByName(b, allowMissingColumns=True)


@query("dedupe_last_wins", "SELECT l_orderkey, l_partkey, l_linenumber, q FROM (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("o"))
    return tables.last_wins(rows, "l_orderkey", "o").drop("o")


DRAW = "md5('42:' || CAST(doc_id AS VARCHAR))"


@query("heldout_eval", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY {DRAW}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r >= n - greatest(1, CAST(floor(n * 0.02) AS BIGINT))")
def heldout_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.train_eval_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.where("split = 'eval'").select("doc_id", "source")


@query("bench_collection_counts", "SELECT source AS dataset_name, count(*) AS n FROM documents GROUP BY source")
def bench_collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset_name")).agg(F.count("*").alias("n"))


@query("save_first_n", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 50")
def save_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 50, "conv_id", "turn")


@query("blend_metadata", "SELECT CAST(to_json(list({'source': source, 'n': n} ORDER BY source)) AS VARCHAR) AS counts, CAST(sum(n) AS BIGINT) AS total_samples FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def blend_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("counts"), F.sum("n").alias("total_samples"))


@query("sample_per_source", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {DRAW}, doc_id) AS r FROM documents) WHERE r <= 3")
def sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_source(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 3).select("doc_id", "source")


@query("summary_union_sorted", "SELECT lang, n, CAST(NULL AS BIGINT) AS chars, CAST(NULL AS VARCHAR) AS source FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) UNION ALL SELECT NULL, count(*), CAST(sum(n_chars) AS BIGINT), source FROM documents GROUP BY source")
def summary_union_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return reports.union_sorted([d.groupBy("lang").agg(F.count("*").alias("n")), d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))])


@query("shard_merge", "SELECT CAST(shard AS INT) AS shard, doc_id FROM (SELECT doc_id, ntile(4) OVER (ORDER BY doc_id) - 1 AS shard FROM documents)")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    rows = sampling.with_row_index(d, "doc_id")
    parts = [rows.where((F.col("row_idx") >= a) & (F.col("row_idx") < b)).select(F.lit(k).alias("shard"), "doc_id") for k in range(4) for a, b in [sampling.shard_range(n, 4, k)]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("shard_names", "SELECT doc_id, format('out.shard-{:05d}-of-00012.jsonl', doc_id % 12) AS name FROM documents")
def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sampling.shard_name("out", ".jsonl", 12, F.col("doc_id") % 12).alias("name"))


@query("cache_key_sha256", "SELECT source, substr(sha256('{\"n\": ' || CAST(count(*) AS VARCHAR) || ', \"source\": \"' || source || '\"}'), 1, 24) AS cache_key FROM documents GROUP BY source")
def cache_key_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    meta = F.concat(F.lit('{"n": '), F.col("n"), F.lit(', "source": "'), F.col("source"), F.lit('"}'))
    return rows.select("source", tables.cache_key_column(meta).alias("cache_key"))


@query("normalize_samples", f"SELECT {sql_strip('head')} AS prompt, {sql_strip(EMPTY('rest'))} AS answer, source, doc_id FROM ({DOC_SQL})")
def normalize_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "source", F.col("head").alias("prompt"), text.or_empty(F.col("rest")).alias("answer"))
    return fmt.normalize_samples(rows, F.col("source"), "doc_id")


HEAD, REST = sql_strip(NONE("head")), sql_strip(NONE("rest"))


@query("fmt_instruction_input", f"SELECT doc_id, CASE WHEN {REST} = '' THEN {HEAD} WHEN {HEAD} = '' THEN {REST} ELSE {HEAD} || chr(10) || chr(10) || 'Input:' || chr(10) || {REST} END AS prompt FROM ({DOC_SQL})")
def fmt_instruction_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fmt.instruction_prompt(F.col("head"), F.col("rest")).alias("prompt"))


@query("fmt_query_context", f"SELECT doc_id, CASE WHEN {REST} = '' THEN {HEAD} ELSE {HEAD} || chr(10) || chr(10) || 'Context:' || chr(10) || {REST} END AS prompt FROM ({DOC_SQL})")
def fmt_query_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fmt.query_context_prompt(F.col("head"), F.col("rest")).alias("prompt"))


@query("fmt_question_context", f"SELECT doc_id, {sql_strip(f'''concat('Question:', chr(10), {sql_strip(EMPTY('head'))}, chr(10), chr(10), 'Context:', chr(10), {sql_strip(EMPTY('rest'))})''')} AS prompt FROM ({DOC_SQL})")
def fmt_question_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fmt.question_context_prompt(fmt.either(F.col("head"), F.col("text")), fmt.either(F.col("rest"))).alias("prompt"))


@query("fmt_problem", f"SELECT doc_id, {sql_strip(f'''concat('Problem:', chr(10), {sql_strip(EMPTY('text'))})''')} AS prompt FROM ({DOC_SQL})")
def fmt_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fmt.problem_prompt(F.col("text")).alias("prompt"))


@query(
    "fmt_first_pair",
    f"SELECT conv_id, CASE WHEN b IS NULL THEN '' ELSE a END AS prompt, coalesce(b, '') AS answer FROM (SELECT conv_id, max(CASE WHEN p = 1 THEN {sql_strip(NONE('text'))} END) AS a, "
    f"max(CASE WHEN p = 2 THEN {sql_strip(NONE('text'))} END) AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id)",
)
def fmt_first_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmt.first_pair_of_turns(table(spark, sf_dir, "conversations"))


# Multi-hop rows: one question a customer nation, a paragraph a market segment, a sentence a customer.
def multihop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    sentences = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    para = c.groupBy("c_nationkey", "c_mktsegment").agg(sentences.alias("sentences"))
    entry = F.struct(F.when(F.col("c_mktsegment") < "C", F.lit("")).otherwise(F.col("c_mktsegment")).alias("title"), "sentences")
    context = F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", entry.alias("e")))), lambda x: x["e"])
    return para.groupBy("c_nationkey").agg(context.alias("context"))


MULTIHOP_SQL = (
    "SELECT c_nationkey, string_agg(CASE WHEN c_mktsegment < 'C' THEN '[Untitled]' ELSE '[' || c_mktsegment || ']' END || chr(10) || body, chr(10) ORDER BY c_mktsegment) AS ctx "
    "FROM (SELECT c_nationkey, c_mktsegment, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY ALL) GROUP BY c_nationkey"
)
MULTIHOP_PROMPT = sql_strip("concat('Question:', chr(10), 'Who is in ', CAST(c_nationkey AS VARCHAR), '?', chr(10), chr(10), 'Context:', chr(10), ctx)")


def _question():
    return F.concat(F.lit("Who is in "), F.col("c_nationkey"), F.lit("?"))


@query("build_multihop_prompt", f"SELECT c_nationkey, {MULTIHOP_PROMPT} AS prompt FROM ({MULTIHOP_SQL})")
def build_multihop_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihop(spark, sf_dir).select("c_nationkey", fmt.multihop_prompt(_question(), F.col("context")).alias("prompt"))


@query("fmt_multihop", f"SELECT c_nationkey, {MULTIHOP_PROMPT} AS prompt, 'morehopqa' AS task_type FROM ({MULTIHOP_SQL})")
def fmt_multihop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihop(spark, sf_dir).select("c_nationkey", fmt.multihop_prompt(_question(), F.col("context")).alias("prompt"), F.lit("morehopqa").alias("task_type"))


@query(
    "filter_transform_array",
    f"SELECT conv_id, coalesce(array_to_string(list(a ORDER BY turn) FILTER (role <> 'system' AND a <> ''), '|'), '') AS answers FROM (SELECT conv_id, turn, role, {sql_strip('substr(text, 1, 20)')} AS a FROM conversations) GROUP BY conv_id",
)
def filter_transform_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.struct("turn", F.when(F.col("role") != "system", F.col("role")).alias("paragraph_support_title"), F.substring("text", 1, 20).alias("answer"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return rows.select("conv_id", F.array_join(fmt.support_answers(F.col("steps")), "|").alias("answers"))


@query("first_non_empty", f"SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, '.'), lambda x: {sql_strip('x')}), lambda x: x <> '')[1], '') AS answer FROM documents")
def first_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fmt.short_answer(F.split("text", "\\.")).alias("answer"))


@query("normalize_list", f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: {sql_strip('x')}), lambda x: x <> ''), '|') AS items FROM documents")
def normalize_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.normalize_list(F.split("text", ",")), "|").alias("items"))


@query("sample_projection", f"SELECT 'blend:' || lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 9, '0') AS example_id, doc_id, {sql_strip('head')} AS prompt, source FROM ({DOC_SQL})")
def sample_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.with_row_index(docs(spark, sf_dir).select("doc_id", "head", "source"), "doc_id")
    return rows.select(text.example_id(F.col("row_idx")).alias("example_id"), "doc_id", text.strip(F.col("head")).alias("prompt"), "source")


@query("example_id", "SELECT o_orderkey, 'blend:' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS example_id FROM orders")
def example_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.example_id(F.col("o_orderkey")).alias("example_id"))


@query("arrays_zip_inline", "SELECT conv_id, unnest(ts) AS turn, unnest(rs) AS role FROM (SELECT conv_id, list(turn ORDER BY turn) AS ts, list(role ORDER BY turn) AS rs FROM conversations GROUP BY conv_id)")
def arrays_zip_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    cols = rows.select("conv_id", F.transform("x", lambda r: r["turn"]).alias("turn"), F.transform("x", lambda r: r["role"]).alias("role"))
    return cols.select("conv_id", F.inline(F.arrays_zip("turn", "role")))


FULL = f"{sql_strip('head')} || chr(10)"


@query("training_texts", f"SELECT doc_id, {sql_strip('head')} AS visible, {FULL} AS prompt_text, {FULL} || {sql_strip(EMPTY('rest'))} || '<|im_end|>' AS full_text FROM ({DOC_SQL})")
def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", text.strip(F.col("head")).alias("visible"), text.strip(text.or_empty(F.col("rest"))).alias("a"))
    prompt, full = fmt.composer_texts(F.col("visible"), F.col("a"))
    return rows.select("doc_id", "visible", prompt.alias("prompt_text"), full.alias("full_text"))


@query("composer_texts", "SELECT conv_id, turn, text || chr(10) AS prompt_text, text || chr(10) || role || '<|im_end|>' AS full_text FROM conversations")
def composer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt, full = fmt.composer_texts(F.col("text"), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("prompt_text"), full.alias("full_text"))


@query("visible_prompt_mode", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE '[MASK]' END AS visible FROM conversations")
def visible_prompt_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("full"), F.lit("empty"), F.lit("masked")), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fmt.visible_prompt(mode, F.col("text"), F.lit(masking.MASK)).alias("visible"))



def _choices():
    return F.array(*(F.struct(F.lit(a).alias("label"), F.lit(o).alias("text")) for a, o in zip("ABCDE", OPTIONS, strict=True)))


LISTED_SQL = f"array_to_string(list_transform(list_zip({LABELS_SQL}, {OPTIONS_SQL}), lambda c: ' (' || c[1] || ') ' || c[2]), '')"


@query("build_choice_question", f"SELECT doc_id, {sql_strip('head')} || ' Answer Choices:' || {LISTED_SQL} AS q, {sql_strip('head')} || ' Answer Choices:' || replace(replace('(' || 'A)21(B)22', '(', ' ('), ')', ') ') AS flat FROM ({DOC_SQL})")
def build_choice_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = prompts.flat_choice_question(F.col("head"), F.array(F.lit("A)21"), F.lit("B)22")))
    return docs(spark, sf_dir).select("doc_id", prompts.choice_question(F.col("head"), _choices()).alias("q"), flat.alias("flat"))


def _reread_sql(family: str, act: str, times: int) -> str:
    head, tail = prompts.TEMPLATES[family].split("{question}")
    question = sql_strip("head")
    again = f" || {lit(prompts.REREAD)} || ".join([question] * times)
    return f"{lit(head)} || {again} || {lit(tail + (chr(10) + 'A: ' + prompts.METHODS[act] if prompts.METHODS[act] else chr(10) + 'A:'))}"


@query("build_reread_prompt", f"SELECT doc_id, {_reread_sql('gsm', 'cot', 2)} AS twice, {_reread_sql('strategyqa', 'vanilla', 1)} AS once FROM ({DOC_SQL})")
def build_reread_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = text.strip(F.col("head"))
    return docs(spark, sf_dir).select("doc_id", prompts.reread_prompt(q, "gsm", "cot", 2).alias("twice"), prompts.reread_prompt(q, "strategyqa", "vanilla", 1).alias("once"))


@query("reference_answer", with_responses("SELECT k, CASE g % 3 WHEN 0 THEN CAST(target AS VARCHAR) WHEN 1 THEN chr(CAST(65 + target % 5 AS INT)) ELSE CASE WHEN target % 2 = 0 THEN '01/02/2020' ELSE '03/04/2021' END END AS answer FROM responses"))
def reference_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(F.lit("number"), F.lit("choice"), F.lit("date")), F.col("g") % 3)
    even = (F.col("target") % 2 == 0).cast("double")
    scores = F.map_from_arrays(F.array(F.lit("01/02/2020"), F.lit("03/04/2021")), F.array(even, 1 - even))
    answer = prompts.reference_answer(kind, F.col("target").cast("string"), F.lit(None).cast("string"), F.char(65 + F.col("target") % 5), scores)
    return responses(spark, sf_dir).select("k", answer.alias("answer"))


@query("coalesce_example_id", "SELECT k.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'q' || CAST(k.doc_id AS VARCHAR) END, CAST(l.toxic AS VARCHAR), CAST(k.doc_id AS VARCHAR)) AS example_id FROM documents k LEFT JOIN labels l ON k.doc_id = l.doc_id")
def coalesce_example_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    first = F.when(F.col("quality") == 1, F.concat(F.lit("q"), "doc_id"))
    return rows.select("doc_id", prompts.benchmark_example_id(F.col("doc_id"), first, F.col("toxic")).alias("example_id"))


@query("repeat_prompt", f"SELECT doc_id, {sql_strip('head')} || chr(10) || chr(10) || {sql_strip('head')} AS prompt FROM ({DOC_SQL})")
def repeat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fmt.repeat_prompt(text.strip(F.col("head")), 2).alias("prompt"))


@query("slugify", "SELECT p_partkey, lower(trim(regexp_replace(p_name || '/' || p_type, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit("/"), "p_type")).alias("slug"))


PLAIN = f"array_to_string({sql_words('text')}, ' ')"


@query("preview_text", f"SELECT doc_id, CASE WHEN length({PLAIN}) <= 240 THEN {PLAIN} ELSE substr({PLAIN}, 1, 237) || '...' END AS preview FROM documents")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(
    "format_duration",
    "SELECT o_orderkey, CASE WHEN s < 0 THEN '--:--' WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') "
    "ELSE lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS t FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 50) AS BIGINT) - 500 AS s FROM orders)",
)
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.floor(F.col("o_totalprice") / 50) - 500).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_duration(s).alias("t"))


# Filters.
@query("filter_flag_false", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE (l.quality = 1) = false")
def filter_flag_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where((F.col("quality") == 1) == F.lit(False)).select("doc_id")


@query("filter_context_answer", f"SELECT d.doc_id FROM ({DOC_SQL}) d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality = 1, false) AND {sql_strip(EMPTY('d.rest'))} <> ''")
def filter_context_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where(F.coalesce(F.col("quality") == 1, F.lit(False)) & (text.strip(text.or_empty(F.col("rest"))) != "")).select("doc_id")


N_PROMPT, N_FULL = f"len({sql_words('head')})", f"len({sql_words('text')})"


@query("filter_token_budget", f"SELECT doc_id FROM ({DOC_SQL}) WHERE {sql_strip('text')} <> '' AND {N_PROMPT} <= 200 AND {N_FULL} <= 600")
def filter_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).where(text.strip(F.col("text")) != "")
    return rows.where((F.size(text.words(F.col("head"))) <= 200) & (F.size(text.words(F.col("text"))) <= 600)).select("doc_id")


@query("filter_rationale_ready", f"SELECT doc_id FROM ({DOC_SQL}) WHERE {sql_strip('head')} <> '' AND {sql_strip(EMPTY('rest'))} <> ''")
def filter_rationale_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where((text.strip(F.col("head")) != "") & (text.strip(text.or_empty(F.col("rest"))) != "")).select("doc_id")


@query("semi_sources", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def semi_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src3", "src5")).select("doc_id", "source")


@query("word_length", f"SELECT doc_id, CAST(len({sql_words('''text || ' ' || source''')}) AS INT) AS n_words FROM documents")
def word_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_length(F.col("text"), F.col("source")).alias("n_words"))


LINES_SQL = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


@query("line_split", f"SELECT doc_id, CAST(i AS INT) AS line_no, l AS line FROM (SELECT doc_id, unnest({LINES_SQL}) AS l, generate_subscripts({LINES_SQL}, 1) - 1 AS i FROM documents)")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans.lines_of(F.col("text"))).alias("line_no", "line"))


L = sql_strip("l")


@query("is_heading", f"SELECT doc_id, l AS line, {L} <> '' AND length({L}) <= 40 AND ends_with({L}, ':') AS heading, length({L}) >= 2 AND starts_with({L}, '[') AND ends_with({L}, ']') AS title FROM (SELECT doc_id, unnest({LINES_SQL}) AS l FROM documents)")
def is_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(spans.lines_of(F.col("text"))).alias("line"))
    return rows.select("doc_id", "line", text.is_heading(F.col("line")).alias("heading"), text.is_title(F.col("line")).alias("title"))


