"""Registering of queries with their SQL, and test inputs for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.text import BOXED, CUES, NUMBER, SPACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql is DuckDB's."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# DuckDB spellings of the text functions.
def sql_strip(x: str) -> str:
    return f"trim({x}, {lit(SPACE)})"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit('[' + SPACE + ']+')}), lambda w: w <> '')"


def sql_norm(x: str) -> str:
    return f"coalesce(array_to_string({sql_words(f'lower({x})')}, ' '), '')"


def sql_think(x: str) -> str:
    return f"coalesce(array_to_string({sql_words(f'''regexp_replace({x}, '(?is)<think>.*?</think>', ' ', 'g')''')}, ' '), '')"


def sql_boxed(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, {lit(BOXED)}, 1), lambda b: {sql_strip('b')}), lambda b: b <> '')"


def sql_numbers(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(NUMBER)})"


def sql_preferred(x: str) -> str:
    equals = lit(rf"=\s*({NUMBER})")
    return f"replace(coalesce(regexp_extract_all({x}, {equals}, 1)[-1], regexp_extract_all({x}, {lit(CUES)}, 1)[-1], {sql_numbers(x)}[-1]), ',', '')"


def sql_number_relaxed(x: str) -> str:
    sentence = f"string_split(string_split({x}, chr(10))[-1], '. ')[-1]"
    phrase = f"CASE WHEN contains({x}, 'answer is ') THEN {sql_strip(f'''string_split({x}, 'answer is ')[-1]''')} ELSE {sentence} END"
    place = f"coalesce({sql_boxed(x)}[-1], {phrase})"
    return f"coalesce({sql_preferred(place)}, CAST(TRY_CAST({sql_numbers(x)}[-1] AS DOUBLE) AS VARCHAR))"


def sql_first_known(items: str, of: str) -> str:
    """of: an expression of x."""
    return f"list_filter(list_transform(list_reverse({items}), lambda x: {of}), lambda x: x IS NOT NULL)[1]"


def sql_number_strict(x: str) -> str:
    return sql_first_known(sql_boxed(x), sql_preferred("x"))


#: Answers in free text, made from lineitem: a key, a variant, the target and the text.
KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT))"
VARIANTS = (
    "The total is \\boxed{@}.",
    "The answer is @.",
    "First x = 3, then y = @",
    "<think>maybe 7 of\n3</think> So we get @ \n in all",
    "I do not know",
    "",
    "First \\boxed{ } then \\boxed{1,0@} or {Yes}",
    "It costs @,500 in total.\nSo NO (C) on 5/1/2022. Yes",
    "\\boxed{5/@/22} and \\boxed{old red car}",
    "I pick B there\nold red town, perhaps 12/03/2021",
    "Result is 3/4 of @ here. Nothing more",
    "```python\nprint(@)\n``` then \\boxed{no way} (D)",
)
RESPONSES_SQL = (
    f"responses AS (SELECT {KEY} AS k, CAST((l_orderkey + l_linenumber) % {len(VARIANTS)} AS INT) AS g, l_returnflag AS flag, CAST(l_quantity AS INT) AS target, replace(CASE (l_orderkey + l_linenumber) % {len(VARIANTS)} "
    + " ".join(f"WHEN {n} THEN {lit(v)}" for n, v in enumerate(VARIANTS))
    + " END, '@', CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS t FROM lineitem)"
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, g, flag, target and t, as RESPONSES_SQL has them."""
    g = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(VARIANTS)).cast("int")
    text = F.get(F.array(*(F.lit(v) for v in VARIANTS)), g)
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.expr(KEY).alias("k"), g.alias("g"), F.col("l_returnflag").alias("flag"), q.alias("target"), F.replace(text, F.lit("@"), q.cast("string")).alias("t")
    )


OPTIONS = ("red apple", "green pear", "old red car", "new town", "blue plum")
OPTIONS_SQL = "[" + ", ".join(map(lit, OPTIONS)) + "]"
LABELS_SQL = "['A', 'B', 'C', 'D', 'E']"


def with_responses(body: str) -> str:
    return f"WITH {RESPONSES_SQL} {body}"
