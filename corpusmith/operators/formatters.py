"""Row formatters: source rows to prompt and answer."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.functions.text import first_non_empty, normalize_list, or_empty, or_none_text, strip

END_OF_TURN = "<|im_end|>"


def normalize_samples(df: DataFrame, source: Column, *extra: str) -> DataFrame:
    return df.select(strip(F.col("prompt")).alias("prompt"), strip(F.col("answer")).alias("answer"), source.alias("source"), *extra)


def instruction_prompt(instruction: Column, given: Column) -> Column:
    a, b = strip(or_none_text(instruction)), strip(or_none_text(given))
    return F.when(b == "", a).when(a == "", b).otherwise(F.concat(a, F.lit("\n\nInput:\n"), b))


def query_context_prompt(query: Column, context: Column) -> Column:
    a, b = strip(or_none_text(query)), strip(or_none_text(context))
    return F.when(b == "", a).otherwise(F.concat(a, F.lit("\n\nContext:\n"), b))


def first_pair(messages: Column) -> tuple[Column, Column]:
    """Contents of the first two messages, whatever their roles; both empty for fewer."""
    enough = F.coalesce(F.size(messages), F.lit(0)) >= 2
    take = lambda k: F.when(enough, strip(or_none_text(F.get(messages, k)["content"]))).otherwise("")
    return take(0), take(1)


def first_pair_of_turns(turns: DataFrame) -> DataFrame:
    """The same over (conv_id, turn, role, text) rows: one partial aggregate, no collected group."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("place", place).where("place <= 2")
    pick = lambda k: F.max(F.when(F.col("place") == k, strip(or_none_text(F.col("text")))))
    both = rows.groupBy("conv_id").agg(pick(1).alias("a"), pick(2).alias("b"))
    return both.select("conv_id", F.when(F.col("b").isNull(), "").otherwise(F.col("a")).alias("prompt"), F.coalesce("b", F.lit("")).alias("answer"))


def multihop_prompt(question: Column, context: Column) -> Column:
    """context: array of (title, sentences)."""
    entries = F.filter(
        F.transform(context, lambda p: F.struct(strip(or_empty(p["title"])).alias("title"), normalize_list(p["sentences"]).alias("sentences"))),
        lambda p: (p["title"] != "") | (F.size(p["sentences"]) > 0),
    )
    paragraph = lambda p: F.concat(
        F.when(p["title"] != "", F.concat(F.lit("["), p["title"], F.lit("]\n"))).otherwise("[Untitled]\n"),
        F.array_join(F.transform(p["sentences"], lambda s: F.concat(s, F.lit("\n"))), ""),
    )
    body = F.array_join(F.transform(entries, paragraph), "\n")
    return strip(F.concat(F.lit("Question:\n"), strip(or_empty(question)), F.lit("\n\nContext:\n"), or_empty(body)))


def support_answers(steps: Column) -> Column:
    """Answers of steps with a support title, in order."""
    kept = F.filter(steps, lambda s: (strip(or_empty(s["paragraph_support_title"])) != "") & (strip(or_empty(s["answer"])) != ""))
    return F.coalesce(F.transform(kept, lambda s: strip(s["answer"])), F.array().cast("array<string>"))


def either(*columns: Column) -> Column:
    """The first that is neither null nor empty; a blank counts as something."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def question_context_prompt(question: Column, context: Column) -> Column:
    return strip(F.concat(F.lit("Question:\n"), strip(or_empty(question)), F.lit("\n\nContext:\n"), strip(or_empty(context))))


def problem_prompt(problem: Column) -> Column:
    return strip(F.concat(F.lit("Problem:\n"), strip(or_empty(problem))))


def short_answer(spans: Column) -> Column:
    return first_non_empty(spans)


def visible_prompt(mode: Column, prompt: Column, masked: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("unknown mode "), mode)).cast("string")
    return F.when(mode == "full", prompt).when(mode == "empty", "").when(mode == "masked", masked).otherwise(bad)


def composer_texts(visible: Column, answer: Column) -> tuple[Column, Column]:
    """Prompt text and full text where no chat template is at hand."""
    prompt = F.concat(visible, F.lit("\n"))
    return prompt, F.concat(prompt, answer, F.lit(END_OF_TURN))


def repeat_prompt(prompt: Column, times: int, separator: str = "\n\n") -> Column:
    return F.array_join(F.array_repeat(prompt, times), separator)


def context_entries(value: object) -> list[tuple[str, list[str]]]:
    """(title, sentences) of a loosely typed context: a list of mappings or of pairs."""
    out = []
    for entry in value if isinstance(value, (list, tuple)) else []:
        if isinstance(entry, dict):
            title = _first_true(entry, "title", "paragraph_support_title", "name")
            body = _first_true(entry, "sentences", "content", "paragraph", "paragraphs", "context", "text")
        elif isinstance(entry, (list, tuple)) and len(entry) > 1:
            title, body = entry[0], entry[1]
        else:
            continue
        name = "" if title is None else str(title).strip()
        lines = [body] if isinstance(body, str) else body if isinstance(body, (list, tuple)) else []
        lines = [str(x).strip() for x in lines if x is not None and str(x).strip()]
        if name or lines:
            out.append((name, lines))
    return out


def _first_true(entry: dict, *names: str):
    return next((entry[n] for n in names if entry.get(n)), None)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("sentences", T.ArrayType(T.StringType()))])))
def context_from_json(texts: pd.Series) -> pd.Series:
    """Loose context as JSON text to (title, sentences); for sources whose entries differ in type."""
    entry = lambda e: {"title": e[0], "sentences": e[1]}
    return pd.Series([[entry(e) for e in context_entries(json.loads(t))] if t else [] for t in texts])
