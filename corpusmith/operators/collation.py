"""Training batches from texts: real tokens, hidden prompts, and rationale spans as token spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.text import or_empty, strip
from corpusmith.functions.tokenizers import Tokenizer, token_ids, token_lengths, token_offsets
from corpusmith.operators import spans
from corpusmith.operators.batching import pad_truncate
from corpusmith.operators.chat import CHATML, ChatTemplate, training_text, user_prompt
from corpusmith.operators.sampling import batch_id, with_row_index

HIDDEN = -100


def tokenized(df: DataFrame, prompt: str, answer: str, tokenizer: Tokenizer, template: ChatTemplate = CHATML) -> DataFrame:
    """df with ids of a request with its reply, and prompt_length: how many tokens the request alone has."""
    p, a = strip(or_empty(F.col(prompt))), strip(or_empty(F.col(answer)))
    rows = df.select("*", user_prompt(p, template).alias("_asked"), training_text(p, a, template).alias("_full"))
    rows = token_lengths(rows, {"prompt_length": ("_asked", tokenizer)}).drop("_asked")
    return token_ids(rows, "_full", tokenizer).drop("_full")


def collated(df: DataFrame, key: str, prompt: str, answer: str, tokenizer: Tokenizer, batch_size: int, limit: int = 6144, pad: int = 0, template: ChatTemplate = CHATML) -> DataFrame:
    """df with batch, ids, attention (1 for a token, 0 for padding) and labels, padded to the longest of each batch.

    Rows are batched by key. A prompt's tokens and padding are hidden from the labels; a text of
    over limit tokens is cut, as its labels are.
    """
    # Rows are numbered before they are encoded: numbering reads its input several times.
    rows = with_row_index(df, key, name="_place").withColumn("batch", batch_id(F.col("_place"), batch_size))
    rows = tokenized(rows, prompt, answer, tokenizer, template)
    rows = rows.withColumn("_n", F.least(F.size("ids"), F.lit(limit)))
    rows = pad_truncate(rows, "ids", "batch", limit, pad)
    real = F.transform("ids", lambda x, i: (i < F.col("_n")).cast("int"))
    # Padding is known by its place: its id may be a token's as well.
    shown = F.transform("ids", lambda x, i: F.when((i < F.col("prompt_length")) | (i >= F.col("_n")), F.lit(HIDDEN)).otherwise(x))
    return rows.select("*", real.alias("attention"), shown.alias("labels")).drop("_place", "_n")


def rationale_tokens(df: DataFrame, key: str, text: str, char_spans: str, relevance: str, tokenizer: Tokenizer, limit: int = 6144) -> DataFrame:
    """key, span, first_tok, end_tok and relevance: a text's character spans as token spans, their relevances summing to 1.

    char_spans: a column of lists of (start, end); relevance: one of numbers, as many. A span that
    overlaps none of the first limit tokens goes, and so does one without a relevance.
    """
    encoded = token_offsets(df.select(key, text, char_spans, relevance), text, tokenizer).drop("ids")
    place = F.posexplode(F.slice("offsets", 1, limit)).alias("tok", "o")
    tokens = encoded.select(key, place).select(key, F.col("tok").cast("long").alias("tok"), F.col("o.start").cast("long").alias("tok_start"), F.col("o.end").cast("long").alias("tok_end"))
    listed = F.posexplode(F.arrays_zip(F.col(char_spans).alias("s"), F.col(relevance).alias("r")))
    pieces = df.select(key, listed.alias("span", "x")).where("x.s is not null")
    pieces = pieces.select(key, F.col("span").cast("long").alias("span"), F.col("x.s.start").cast("long").alias("start"), F.col("x.s.end").cast("long").alias("end"), F.col("x.r").alias("r"))
    found = spans.token_spans(tokens, pieces, key).join(pieces.select(key, "span", "r"), [key, "span"]).where("r is not null")
    shares = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("span", "first_tok", "end_tok", "r"))).alias("s"))
    shares = shares.withColumn("p", spans.normalize_distribution(F.transform("s", lambda x: x["r"])))
    rows = shares.select(key, F.explode(F.arrays_zip("s", "p")).alias("x"))
    return rows.select(key, "x.s.span", "x.s.first_tok", "x.s.end_tok", F.col("x.p").alias("relevance"))
