"""Loaders of staged question-answering sources, and rows from memory.

A source is a folder below a root with one entry a split: ``<root>/<name>/<split>`` with
``.jsonl`` or ``.parquet`` (a file or a folder of files). Nothing is fetched.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.text import first_non_empty, or_empty, or_none_text, strip
from corpusmith.operators import formatters as fmt
from corpusmith.sources.tables import existing

MESSAGES = "array<struct<content: string, role: string>>"
#: Columns that a source is read with.
SCHEMAS = {
    "open_platypus": "instruction string, input string, output string",
    "long_magpie": "query string, context string, answer string",
    "no_robots": f"messages {MESSAGES}",
    "nq_short": "question string, questions string, context string, contexts string, paragraph string, document_text string, answers array<string>",
    "harp": "problem string, answer string, multiple_choice_only boolean",
}


def from_rows(spark: SparkSession, rows: Iterable[Mapping], schema: str) -> DataFrame:
    """Rows in memory; keys that the schema lacks are left out, those that a row lacks are null."""
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def scan(spark: SparkSession, root: str, name: str, split: str = "train") -> DataFrame:
    """Rows of a staged source. One that has a single split (harp) gives that for any."""
    schema = SCHEMAS[name]
    base = f"{root.rstrip('/')}/{name}/{'train' if name == 'harp' else split}"
    try:
        return spark.read.schema(schema).parquet(existing(spark, f"{base}.parquet"))
    except FileNotFoundError:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(existing(spark, f"{base}.jsonl"))


def _pair(name: str) -> tuple[Column, Column]:
    if name == "open_platypus":
        return fmt.instruction_prompt(F.col("instruction"), F.col("input")), strip(or_none_text(F.col("output")))
    if name == "long_magpie":
        return fmt.query_context_prompt(F.col("query"), F.col("context")), strip(or_none_text(F.col("answer")))
    if name == "no_robots":
        return fmt.first_pair(F.col("messages"))
    if name == "nq_short":
        context = fmt.either(*(F.col(c) for c in ("context", "contexts", "paragraph", "document_text")))
        return fmt.question_context_prompt(fmt.either(F.col("question"), F.col("questions")), context), first_non_empty(F.col("answers"))
    return fmt.problem_prompt(F.col("problem")), strip(or_empty(F.col("answer")))


def load(spark: SparkSession, root: str, name: str, split: str = "train") -> DataFrame:
    """prompt, answer and source of each row; harp without rows that may be multiple choice alone."""
    rows = scan(spark, root, name, split)
    if name == "harp":
        rows = rows.where(F.col("multiple_choice_only").eqNullSafe(False))
    prompt, answer = _pair(name)
    return rows.select(prompt.alias("prompt"), answer.alias("answer"), F.lit(name).alias("source"))
