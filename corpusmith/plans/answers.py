"""Queries: text functions, answer parsing, scoring, metrics and the end-to-end evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import answers as A
from corpusmith.functions import metrics, models, text
from corpusmith.operators import reports
from corpusmith.plans.base import (
    LABELS_SQL,
    OPTIONS,
    OPTIONS_SQL,
    lit,
    query,
    responses,
    sql_boxed,
    sql_first_known,
    sql_norm,
    sql_number_relaxed,
    sql_number_strict,
    sql_numbers,
    sql_preferred,
    sql_strip,
    sql_think,
    sql_words,
    table,
    with_responses,
)


def _options() -> Column:
    return F.array(*(F.lit(o) for o in OPTIONS))


def over_responses(name: str, sql: str, **columns):
    """A query of k and columns over the responses. columns: name to a function of t."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = responses(spark, sf_dir)
        return rows.select("k", *(f(F.col("t")).alias(c) for c, f in columns.items()))

    query(name, with_responses(f"SELECT k, {sql} FROM responses"))(run)


def sql_yes_no(x: str) -> str:
    return f"CASE WHEN contains(lower({x}), 'yes') THEN 'yes' WHEN contains(lower({x}), 'no') THEN 'no' END"


def sql_yes_no_relaxed(x: str) -> str:
    braces = f"regexp_extract_all({x}, '\\{{([a-zA-Z]*)\\}}', 1)"
    return f"coalesce({sql_first_known(braces, sql_yes_no('x'))}, regexp_extract_all(lower({x}), '(yes|no)', 1)[-1])"


def sql_date(x: str) -> str:
    parts = f"list_filter(list_transform(string_split({x}, '/'), lambda p: {sql_strip('p')}), lambda p: p <> '')"
    pad = lambda e: f"CASE WHEN length({e}) = 1 THEN '0' || {e} ELSE {e} END"
    year = f"CASE WHEN length({parts}[3]) = 2 THEN '20' || {parts}[3] ELSE {parts}[3] END"
    ok = f"len({parts}) = 3 AND len(list_filter({parts}, lambda p: regexp_full_match(p, '[0-9]+'))) = 3"
    return f"CASE WHEN {ok} THEN concat_ws('/', {pad(parts + '[1]')}, {pad(parts + '[2]')}, {year}) END"


def sql_date_relaxed(x: str) -> str:
    loose = f"regexp_extract_all({x}, {lit(A.DATE)})[-1]"
    return f"coalesce({sql_first_known(sql_boxed(x), sql_date('x'))}, {sql_date(loose)})"


def sql_similarity(a: str, b: str) -> str:
    x, y = sql_words(a), sql_words(b)
    return (
        f"CASE WHEN {a} = {b} THEN 2.0::DOUBLE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE "
        f"ELSE len(list_distinct(list_intersect({x}, {y})))::DOUBLE / greatest(len({x}), len({y})) END"
    )


def sql_best(x: str, options: str = OPTIONS_SQL) -> str:
    scores = f"list_transform({options}, lambda o: {sql_similarity('o', x)})"
    return f"list_position({scores}, list_max({scores}))"


def sql_bare(x: str) -> str:
    return f"regexp_extract_all({x}, '(?:^|[^a-zA-Z])([ABCDE])(?:$|[^a-zA-Z])', 1)[-1]"


def sql_choice(place: str) -> str:
    shown = f"regexp_extract_all({sql_strip(place)}, '\\(([A-E])\\)', 1)[-1]"
    return f"coalesce({shown}, {sql_bare(sql_strip(place))}, {LABELS_SQL}[{sql_best(place)}])"


CHOICE = sql_choice(f"coalesce({sql_boxed('t')}[-1], string_split(t, chr(10))[-1])")
CHOICE_STRICT = f"CASE WHEN len({sql_boxed('t')}) > 0 THEN {sql_choice(sql_boxed('t') + '[-1]')} END"
SCORE = lambda p: f"CAST(coalesce(abs(TRY_CAST({p} AS DOUBLE) - target) < 1e-3, false) AS INT)"

over_responses("normalize_text", f"{sql_norm('t')} AS norm", norm=text.normalize_text)
over_responses("strip_think", f"{sql_think('t')} AS plain", plain=text.strip_think)
over_responses("boxed_all", f"coalesce(array_to_string({sql_boxed('t')}, '|'), '') AS boxes", boxes=lambda t: F.array_join(text.boxed_all(t), "|"))
over_responses(
    "first_last_number",
    f"{sql_numbers('t')}[1] AS first_number, {sql_numbers('t')}[-1] AS last_number",
    first_number=lambda t: text.first(text.all_numbers(t)),
    last_number=lambda t: text.last(text.all_numbers(t)),
)
over_responses("preferred_number", f"{sql_preferred('t')} AS number", number=A.preferred_number)
over_responses("parse_number", f"{sql_number_relaxed('t')} AS parsed", parsed=A.number_relaxed)
over_responses("parse_number_strict", f"{sql_number_strict('t')} AS parsed", parsed=A.number_strict)
over_responses("parse_yes_no", f"{sql_yes_no_relaxed('t')} AS parsed", parsed=A.yes_no_relaxed)
over_responses("parse_yes_no_strict", f"{sql_first_known(sql_boxed('t'), sql_yes_no('x'))} AS parsed", parsed=A.yes_no_strict)
over_responses("parse_date", f"{sql_date_relaxed('t')} AS parsed", parsed=A.date_relaxed)
over_responses("parse_date_strict", f"{sql_first_known(sql_boxed('t'), sql_date('x'))} AS parsed", parsed=A.date_strict)
over_responses("parse_choice", f"{CHOICE} AS parsed", parsed=lambda t: A.choice_relaxed(t, _options(), A.flat_labels()))
over_responses("parse_choice_strict", f"{CHOICE_STRICT} AS parsed", parsed=lambda t: A.choice_strict(t, _options(), A.flat_labels()))
over_responses(
    "parse_choice_flat",
    f"{CHOICE} AS relaxed, {CHOICE_STRICT} AS strict",
    relaxed=lambda t: A.choice_relaxed(t, _options(), A.flat_labels()),
    strict=lambda t: A.choice_strict(t, _options(), A.flat_labels()),
)
over_responses("bare_choice", f"{sql_bare('t')} AS choice", choice=A.bare_choice)
over_responses(
    "parse_text",
    f"{sql_strip('''regexp_extract_all(t, 'boxed\\{(.*?)\\}', 1)[-1]''')} AS relaxed, {sql_boxed('t')}[-1] AS strict",
    relaxed=A.text_relaxed,
    strict=A.text_strict,
)
over_responses("code_block", f"{sql_strip('''coalesce(regexp_extract_all(t, '(?is)```(?:python)?\\s*(.*?)```', 1)[-1], t)''')} AS code", code=text.code_block)
over_responses(
    "strip_math",
    "replace(replace(replace(replace(replace(replace(t, ' ', ''), '\\left', ''), '\\right', ''), '\\!', ''), '$', ''), '\\,', '') AS plain, "
    "CASE WHEN contains(t, 'boxed{') THEN regexp_extract(t, '(?s).*boxed\\{([^{}]*)\\}', 1) END AS last_box",
    plain=text.strip_math,
    last_box=text.last_boxed,
)
over_responses(
    "string_similarity",
    f"round({sql_similarity('t', lit('old red car town'))}, 6) AS score",
    score=lambda t: F.round(A.similarity(t, F.lit("old red car town")), 6),
)
over_responses("best_match", f"CAST({sql_best('t')} AS BIGINT) AS best", best=lambda t: A.best_match(_options(), t).cast("long"))


@query(
    "normalize_numeric",
    "WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE l_linenumber % 4 WHEN 0 THEN '$' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ',' "
    "WHEN 1 THEN '1,' || CAST(CAST(l_quantity AS INT) + 100 AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '/8' "
    "ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.2504 cm' END AS x FROM lineitem) "
    "SELECT x, count(*) AS n, CASE WHEN regexp_matches(y, '^[-+]?[0-9,./]+$') THEN regexp_replace(CASE WHEN regexp_full_match(p, '[-+]?[0-9]+') THEN CAST(TRY_CAST(p AS BIGINT) AS VARCHAR) "
    "WHEN contains(p, '/') THEN CAST(round_even(TRY_CAST(split_part(p, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part(p, '/', 2) AS DOUBLE), 0), 3) AS VARCHAR) "
    "ELSE CAST(round_even(TRY_CAST(p AS DOUBLE), 3) AS VARCHAR) END, '\\.0+$', '') ELSE y END AS plain "
    "FROM (SELECT *, replace(y, ',', '') AS p FROM (SELECT x, regexp_replace(regexp_replace(x, '^\\$', ''), '[,./]$', '') AS y FROM n)) GROUP BY ALL",
)
def normalize_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    m = F.col("l_linenumber") % 4
    x = F.when(m == 0, F.concat(F.lit("$"), q, F.lit(","))).when(m == 1, F.concat(F.lit("1,"), q + 100)).when(m == 2, F.concat(q, F.lit("/8"))).otherwise(F.concat(q, F.lit(".2504 cm")))
    rows = table(spark, sf_dir, "lineitem").groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    return rows.withColumn("plain", text.normalize_numeric(F.col("x")))


SCORES_SQL = f"SELECT k, target, {sql_number_strict('t')} AS strict_parsed, {sql_number_relaxed('t')} AS relaxed_parsed, t, g, flag FROM (SELECT k, g, flag, target, t AS raw, {sql_think('t')} AS t FROM responses)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = responses(spark, sf_dir).withColumn("raw", t).withColumn("t", text.strip_think(t))
    rows = rows.withColumn("strict_parsed", A.number_strict(t)).withColumn("relaxed_parsed", A.number_relaxed(t))
    return (
        rows.withColumn("strict_score", A.score_number(F.col("strict_parsed"), F.col("target").cast("string")))
        .withColumn("relaxed_score", A.score_number(F.col("relaxed_parsed"), F.col("target").cast("string")))
        .withColumn("no_boxed", reports.no_boxed(F.col("raw"), F.lit("cot")))
    )


SCORED_SQL = (
    f"scored AS (SELECT *, {SCORE('strict_parsed')} AS strict_score, {SCORE('relaxed_parsed')} AS relaxed_score FROM "
    f"(SELECT k, g, flag, target, raw, t, {sql_number_strict('t')} AS strict_parsed, {sql_number_relaxed('t')} AS relaxed_parsed, "
    "CAST(raw <> '' AND NOT contains(lower(raw), 'boxed') AS INT) AS no_boxed FROM "
    f"(SELECT k, g, flag, target, t AS raw, {sql_think('t')} AS t FROM responses)))"
)
SUMMARY_SQL = (
    "count(*) AS num_samples, CAST(sum(strict_score) AS BIGINT) AS strict_correct_num, count(*) FILTER (strict_parsed IS NULL) AS strict_null_num, "
    "CAST(sum(relaxed_score) AS BIGINT) AS relaxed_correct_num, count(*) FILTER (relaxed_parsed IS NULL) AS relaxed_null_num, "
    "CAST(sum(relaxed_score) AS BIGINT) AS correct_num, count(*) FILTER (relaxed_parsed IS NULL) AS null_num, CAST(sum(no_boxed) AS BIGINT) AS no_boxed_num"
)
RATES_SQL = (
    "strict_correct_num / num_samples AS strict_accuracy, strict_null_num / num_samples AS strict_null_rate, relaxed_correct_num / num_samples AS relaxed_accuracy, "
    "relaxed_null_num / num_samples AS relaxed_null_rate, correct_num / num_samples AS accuracy, null_num / num_samples AS null_rate, no_boxed_num / num_samples AS no_boxed_rate"
)


def with_scored(body: str) -> str:
    return with_responses("").rstrip() + f", {SCORED_SQL} {body}"


@query("score_prediction", with_scored("SELECT k, strict_score, relaxed_score FROM scored"))
def score_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("k", "strict_score", "relaxed_score")


@query("prediction_record", with_scored("SELECT k, raw, t AS prediction_text, strict_parsed, relaxed_parsed, strict_score, relaxed_score, no_boxed, g % 2 + 1 > 1 AS use_reread FROM scored"))
def prediction_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("use_reread", F.col("g") % 2 + 1 > 1).withColumnRenamed("t", "prediction_text")
    return rows.select("k", "raw", "prediction_text", "strict_parsed", "relaxed_parsed", "strict_score", "relaxed_score", "no_boxed", "use_reread")


@query("end_to_end_eval", with_scored(f"SELECT *, {RATES_SQL} FROM (SELECT flag, {SUMMARY_SQL} FROM scored GROUP BY flag)"))
def end_to_end_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summarize_runs(scored(spark, sf_dir), "flag")


@query("summarize_runs", with_scored(f"SELECT *, {RATES_SQL} FROM (SELECT flag, g, {SUMMARY_SQL} FROM scored GROUP BY flag, g)"))
def summarize_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summarize_runs(scored(spark, sf_dir), "flag", "g")


DATASET_OF = "CASE g % 3 WHEN 0 THEN 'arc_easy' WHEN 1 THEN 'arc_challenge' ELSE 'gsm' END"


@query(
    "arc_total_rollup",
    with_scored(
        f"SELECT 'arc_total' AS dataset_name, *, {RATES_SQL} FROM (SELECT flag AS kind, {SUMMARY_SQL} FROM scored WHERE {DATASET_OF} IN ('arc_easy', 'arc_challenge') GROUP BY flag)"
    ),
)
def arc_total_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("dataset_name", F.expr(DATASET_OF)).withColumnRenamed("flag", "kind")
    return reports.arc_total(reports.summarize_runs(rows, "dataset_name", "kind"), "kind")


@query("rollup_subset", with_scored(f"SELECT {DATASET_OF} AS dataset_name, count(*) AS n FROM scored WHERE {DATASET_OF} IN ('arc_easy', 'arc_challenge') GROUP BY 1"))
def rollup_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("dataset_name", F.expr(DATASET_OF))
    return rows.where(F.col("dataset_name").isin("arc_easy", "arc_challenge")).groupBy("dataset_name").agg(F.count("*").alias("n"))


@query(
    "score_date",
    with_responses(
        f"SELECT k, p, CAST(coalesce(CASE p WHEN '05/01/2022' THEN 1.0 WHEN '12/03/2021' THEN 0.0 END > 0, false) AS INT) AS score FROM (SELECT k, {sql_date_relaxed('t')} AS p FROM responses)"
    ),
)
def score_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.create_map(F.lit("05/01/2022"), F.lit(1.0), F.lit("12/03/2021"), F.lit(0.0))
    return responses(spark, sf_dir).select("k", A.date_relaxed(F.col("t")).alias("p")).withColumn("score", A.score_date(F.col("p"), scores))


YES_NO = sql_yes_no_relaxed("t")


@query(
    "parse_dispatch",
    with_responses(
        f"SELECT k, g, CASE g % 4 WHEN 0 THEN {sql_number_relaxed('t')} WHEN 1 THEN {YES_NO} WHEN 2 THEN {sql_date_relaxed('t')} ELSE {CHOICE} END AS parsed FROM responses"
    ),
)
def parse_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, kind = F.col("t"), F.col("g") % 4
    parsed = F.when(kind == 0, A.number_relaxed(t)).when(kind == 1, A.yes_no_relaxed(t)).when(kind == 2, A.date_relaxed(t)).otherwise(A.choice_relaxed(t, _options(), A.flat_labels()))
    return responses(spark, sf_dir).select("k", "g", parsed.alias("parsed"))


# Metrics: each assistant turn against the turn before it.
PAIRS_SQL = (
    "pairs AS (SELECT a.conv_id, a.turn, b.text AS ref, a.text AS pred FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", "ref", F.col("text").alias("pred"))


EM = f"CAST({sql_norm('ref')} = {sql_norm('pred')} AS DOUBLE)"
R, P = sql_words("lower(ref)"), sql_words("lower(pred)")
F1 = (
    f"CASE WHEN len({R}) = 0 AND len({P}) = 0 THEN 1.0::DOUBLE WHEN len({R}) = 0 OR len({P}) = 0 THEN 0.0::DOUBLE ELSE 2.0 * "
    f"coalesce(list_sum(list_transform(list_distinct({R}), lambda w: least(len(list_filter({R}, lambda x: x = w)), len(list_filter({P}, lambda y: y = w))))), 0)::DOUBLE / (len({R}) + len({P})) END"
)


@query("exact_match", f"WITH {PAIRS_SQL} SELECT conv_id, turn, {EM} AS exact_match FROM pairs")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", metrics.exact_match(F.col("ref"), F.col("pred")).alias("exact_match"))


@query("token_f1", f"WITH {PAIRS_SQL} SELECT conv_id, turn, round({F1}, 9) AS token_f1 FROM pairs")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.token_f1(F.col("ref"), F.col("pred")), 9).alias("token_f1"))


@query("text_metrics", f"WITH {PAIRS_SQL} SELECT conv_id, turn, {EM} AS exact_match, round({F1}, 9) AS token_f1 FROM pairs")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = F.col("ref"), F.col("pred")
    return pairs(spark, sf_dir).select("conv_id", "turn", metrics.exact_match(r, p).alias("exact_match"), F.round(metrics.token_f1(r, p), 9).alias("token_f1"))


@query("rouge_l")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", metrics.rouge_l_f1("ref", "pred").alias("rouge_l_f1"))


@query("metric_bundle")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.metric_bundle(F.col("ref"), F.col("pred"))
    return pairs(spark, sf_dir).select("conv_id", "turn", *(F.round(c, 9).alias(n) for n, c in found.items()))


@query("metric_bundle_means")
def metric_bundle_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.metric_bundle(F.col("ref"), F.col("pred"))
    rows = pairs(spark, sf_dir).select("turn", *(c.alias(n) for n, c in found.items()))
    return reports.metric_means(rows, "turn").withColumns({c: F.round(c, 9) for c in found})


@query(
    "aggregate_metrics",
    f"WITH {PAIRS_SQL} SELECT turn, count(*) AS num_samples, coalesce(avg({EM}), 0.0) AS exact_match, round(coalesce(avg({F1}), 0.0), 9) AS token_f1 FROM pairs GROUP BY turn",
)
def aggregate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = F.col("ref"), F.col("pred")
    rows = pairs(spark, sf_dir).select("turn", metrics.exact_match(r, p).alias("exact_match"), metrics.token_f1(r, p).alias("token_f1"))
    return reports.metric_means(rows, "turn").withColumn("token_f1", F.round("token_f1", 9))


@query(
    "token_overlap_multiset",
    f"WITH {PAIRS_SQL}, r AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest({R}) AS w FROM pairs) GROUP BY ALL), "
    f"p AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest({P}) AS w FROM pairs) GROUP BY ALL) "
    "SELECT conv_id, turn, CAST(sum(least(r.c, p.c)) AS BIGINT) AS overlap FROM r JOIN p USING (conv_id, turn, w) GROUP BY ALL",
)
def token_overlap_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs(spark, sf_dir)
    count = lambda c, n: both.select("conv_id", "turn", F.explode(text.words(F.lower(c))).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count("*").alias(n))
    joined = count("ref", "a").join(count("pred", "b"), ["conv_id", "turn", "w"])
    return joined.groupBy("conv_id", "turn").agg(F.sum(F.least("a", "b")).alias("overlap"))


@query("set_intersect", f"WITH {PAIRS_SQL} SELECT conv_id, turn, CAST(len(list_distinct(list_intersect({R}, {P}))) AS BIGINT) AS shared FROM pairs")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.array_intersect(text.words(F.lower("ref")), text.words(F.lower("pred")))).cast("long")
    return pairs(spark, sf_dir).select("conv_id", "turn", n.alias("shared"))


@query("set_except", f"WITH {PAIRS_SQL} SELECT conv_id, turn, CAST(len(list_filter(list_distinct({R}), lambda w: NOT list_contains({P}, w))) AS BIGINT) AS missing FROM pairs")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.array_except(text.words(F.lower("ref")), text.words(F.lower("pred")))).cast("long")
    return pairs(spark, sf_dir).select("conv_id", "turn", n.alias("missing"))


@query("generate_stub", "SELECT conv_id, turn, 'The answer is \\boxed{' || CAST(length(text) AS VARCHAR) || '}.' AS raw_prediction FROM conversations")
def generate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.generate(table(spark, sf_dir, "conversations"), "text", models.stub_model).select("conv_id", "turn", "raw_prediction")


@query(
    "sampling_params",
    "SELECT conv_id, bool_or(role = 'system') AS thinking, CASE WHEN bool_or(role = 'system') THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS temperature, "
    "CASE WHEN bool_or(role = 'system') THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS top_p, CAST(20 AS INT) AS top_k, 0.0::DOUBLE AS min_p FROM conversations GROUP BY conv_id",
)
def sampling_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("thinking"))
    return rows.select("conv_id", "thinking", models.sampling_params(F.col("thinking")).alias("p")).select("conv_id", "thinking", "p.*")
