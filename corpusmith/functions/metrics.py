"""Text metrics of a reference and a prediction."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.functions.stemming import stem
from corpusmith.functions.text import normalize_text, words


def exact_match(ref: Column, pred: Column) -> Column:
    return (normalize_text(ref) == normalize_text(pred)).cast("double")


@F.arrow_udf(T.IntegerType())
def token_overlap(r: pa.Array, p: pa.Array) -> pa.Array:
    """Size of the multiset intersection of two token arrays, linear in both. One row's tokens are Python strings at a time."""
    return pa.array([(Counter(a.as_py()) & Counter(b.as_py())).total() if a.is_valid and b.is_valid else None for a, b in zip(r, p, strict=True)], pa.int32())


def token_f1(ref: Column, pred: Column) -> Column:
    r, p = words(F.lower(ref)), words(F.lower(pred))
    n = token_overlap(r, p)
    f1 = 2 * n / (F.size(r) + F.size(p))
    none = (F.size(r) == 0) | (F.size(p) == 0)
    return F.when((F.size(r) == 0) & (F.size(p) == 0), F.lit(1.0)).when(none, F.lit(0.0)).otherwise(f1)


def lcs_length(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_tokens(s: str) -> list[str]:
    """Runs of ASCII letters and digits in lower case; those of over three characters by their stem."""
    return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", s.lower())]


@F.arrow_udf(T.DoubleType())
def rouge_l_f1(ref: pa.Array, pred: pa.Array) -> pa.Array:
    """F1 of the longest common subsequence of stemmed words; both blank 1, one blank 0."""
    out = []
    for x, y in zip(ref, pred, strict=True):
        a, b = x.as_py() or "", y.as_py() or ""
        if not a.strip() or not b.strip():
            out.append(1.0 if not a.strip() and not b.strip() else 0.0)
            continue
        x, y = rouge_tokens(a), rouge_tokens(b)
        n = lcs_length(x, y)
        out.append(2 * n / (len(x) + len(y)) if n else 0.0)
    return pa.array(out, pa.float64())


def metric_bundle(ref: Column, pred: Column) -> dict[str, Column]:
    """All metrics of a reference and a prediction by name."""
    return {"exact_match": exact_match(ref, pred), "token_f1": token_f1(ref, pred), "rouge_l_f1": rouge_l_f1(ref, pred)}


def average(c: Column) -> Column:
    """Mean; 0 for no rows."""
    return F.coalesce(F.avg(c), F.lit(0.0))
