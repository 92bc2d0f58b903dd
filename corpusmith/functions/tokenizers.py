"""Tokenizers of three public libraries behind one interface, in Arrow batches.

A tokenizer is named by its file: ``.json`` (tokenizers), ``.model`` (sentencepiece) or
``.tiktoken`` (tiktoken, with the split pattern that belongs to it). Files have to be there on
every executor, or at a path that is; one is loaded once a worker process. Texts are
encoded whole, special tokens' strings as ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20  # of texts that are encoded at a time

Encode = Callable[[list[str]], list[list[int]]]


@dataclass(frozen=True)
class Tokenizer:
    """path: a vocabulary file; pattern: tiktoken's split pattern; special: whether a file's own frame of special tokens is added."""

    path: str
    pattern: str | None = None
    special: bool = False


@lru_cache(maxsize=4)
def _library(t: Tokenizer):
    if t.path.endswith(".json"):
        # A task has one core; the library would start a thread for each of the machine, with memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        tok = Library.from_file(t.path)
        tok.no_truncation()
        tok.no_padding()
        tok.encode_special_tokens = True
        return tok
    if t.path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=t.path)
    if t.path.endswith(".tiktoken"):
        import tiktoken

        if not t.pattern:
            raise ValueError("a .tiktoken file needs its split pattern")
        with open(t.path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(t.path, pat_str=t.pattern, mergeable_ranks=ranks, special_tokens={})
    raise ValueError(f"no tokenizer library reads {t.path}")


def encoder(t: Tokenizer) -> Encode:
    """The function that encodes a list of texts."""
    tok = _library(t)
    if t.path.endswith(".json"):
        return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=t.special)]
    if t.path.endswith(".model"):
        return lambda texts: tok.encode(texts, num_threads=1, add_bos=t.special, add_eos=t.special) if texts else []
    return lambda texts: [tok.encode_ordinary(x) for x in texts]


def _lots(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in lots of about BATCH_BYTES; null is empty."""
    lot, held = [], 0
    for x in texts:
        if lot and held + len(x or "") > BATCH_BYTES:
            yield lot
            lot, held = [], 0
        lot.append(x or "")
        held += len(x or "")
    if lot:
        yield lot


def _cut(batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BATCH_BYTES of its text columns, so that what is made of them stays as small whatever Spark's batches hold."""
    sizes = sum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(c))), 0).cast(pa.int64())) for c in texts)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + BATCH_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _appended(df: DataFrame, made: dict[str, T.DataType], texts: list[str], run) -> DataFrame:
    """df with further columns of Arrow batches. run: a batch to arrays; texts: the columns that it reads."""

    def batches(found):
        for whole in found:
            for batch in _cut(whole, texts):
                arrays = [*batch.columns, *run(batch)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *made])

    return df.mapInArrow(batches, T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in made.items())]))


def token_lengths(df: DataFrame, lengths: dict[str, tuple[str, Tokenizer]]) -> DataFrame:
    """df with numbers of tokens: for each new column a text column and a tokenizer, all in one pass. A null text has none."""

    def run(batch):
        for text, tokenizer in lengths.values():
            encode = encoder(tokenizer)
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield pa.array([len(ids) for lot in _lots(texts) for ids in encode(lot)], pa.int64())

    return _appended(df, {c: T.LongType() for c in lengths}, list(dict.fromkeys(c for c, _ in lengths.values())), run)


def _listed(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), values)


def token_ids(df: DataFrame, text: str, tokenizer: Tokenizer, ids: str = "ids") -> DataFrame:
    """df with each text's ids; a null text has none."""

    def run(batch):
        encode = encoder(tokenizer)
        found = [np.asarray(x, np.int32) for lot in _lots(batch.column(batch.schema.get_field_index(text)).to_pylist()) for x in encode(lot)]
        yield _listed([len(x) for x in found], pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    return _appended(df, {ids: T.ArrayType(T.IntegerType())}, [text], run)


def token_offsets(df: DataFrame, text: str, tokenizer: Tokenizer, ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """df with each text's ids and the places (start, end) of its tokens in code points; the file has to be one of tokenizers."""
    if not tokenizer.path.endswith(".json"):
        raise ValueError("only the tokenizers library gives offsets")
    place = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def run(batch):
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        found = []
        for lot in _lots(texts):  # ids and places as numbers, since an encoding holds its tokens' strings as well
            for e in _library(tokenizer).encode_batch(lot, add_special_tokens=tokenizer.special):
                found.append((np.asarray(e.ids, np.int32), np.asarray(e.offsets, np.int32).reshape(-1, 2)))
        sizes = [len(x) for x, _ in found]
        places = np.concatenate([np.zeros((0, 2), np.int32), *(y for _, y in found)])
        yield _listed(sizes, pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x, _ in found)])))
        yield _listed(sizes, pa.StructArray.from_arrays([pa.array(places[:, k].copy()) for k in (0, 1)], ["start", "end"]))

    return _appended(df, {ids: T.ArrayType(T.IntegerType()), offsets: T.ArrayType(place)}, [text], run)


def within_budget(df: DataFrame, prompt: str, answer: str, profiler: Tokenizer, composer: Tokenizer, most_profiler: int = 6144, most_composer: int = 6144, render=None) -> DataFrame:
    """df with profiler_tokens (of the prompt), composer_tokens (of the request and reply as rendered) and within.

    Prompt and answer are stripped; a row with neither is not within. render: Column expression
    of both, a chat template's training text by default.
    """
    from corpusmith.functions.text import or_empty, strip
    from corpusmith.operators.chat import training_text

    p, a = strip(or_empty(F.col(prompt))), strip(or_empty(F.col(answer)))
    rows = df.select("*", p.alias("_prompt"), (render or training_text)(p, a).alias("_full"), ((p == "") & (a == "")).alias("_none"))
    rows = token_lengths(rows, {"profiler_tokens": ("_prompt", profiler), "composer_tokens": ("_full", composer)})
    fits = ~F.col("_none") & (F.col("profiler_tokens") <= most_profiler) & (F.col("composer_tokens") <= most_composer)
    return rows.withColumn("within", fits).drop("_prompt", "_full", "_none")
