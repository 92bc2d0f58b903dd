"""Masking of prompt tokens by stateless draws: a hash of seed, row and token stands for a random number."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.text import words

MASK = "[MASK]"


def draw(seed: int, row: Column, place: Column) -> Column:
    """A number below 1 for each (seed, row, place)."""
    text = F.concat(F.lit(f"{seed}:"), row.cast("string"), F.lit(":"), place.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def is_entity(token: Column) -> Column:
    """Stand-in for a tagger's names, numbers and nouns: a capital or a digit."""
    return token.rlike("[A-Z0-9]")


def mask_tokens(text: Column, row: Column, prob: float | Column, seed: int = 42, candidate=is_entity) -> Column:
    """Candidate tokens masked with the given probability; tokens joined by single spaces.

    prob may be a column, so that it can change from row to row (a schedule); candidate says of
    a token whether it may be masked: a column function, or a pandas UDF that asks a tagger.
    """
    return F.array_join(F.transform(words(text), lambda t, i: F.when(candidate(t) & (draw(seed, row, i) < prob), F.lit(MASK)).otherwise(t)), " ")


def apply_masker(df: DataFrame, masker, text: str, *extra: str, out: str = "masked") -> DataFrame:
    """df with masker's text. masker: a function of the text column, or of it and the extra columns (an item's other fields)."""
    takes = len(inspect.signature(masker).parameters)
    args = [F.col(c) for c in (text, *extra)][: max(1, takes)]
    return df.withColumn(out, masker(*args))


def target_probability(index: Column, n: Column, earlier: float, last: float) -> Column:
    progress = F.least(F.greatest(index / F.greatest(n - 1, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    return F.when(n <= 1, F.lit(last)).otherwise(F.lit(earlier) + progress * (last - earlier))


def mask_words_of(text: Column, target: Column, row: Column, target_prob: float, base_prob: float, seed: int = 42) -> Column:
    """Space-separated tokens: runs of the target masked as one, the others with the base probability."""
    parts = F.split(text, F.concat(F.lit("\\Q"), target, F.lit("\\E")), -1)
    hide = lambda i: draw(seed, row, i) < target_prob
    if target_prob >= 1:
        hide = lambda i: F.lit(True)
    if target_prob <= 0:
        hide = lambda i: F.lit(False)
    plain = lambda s, i: s if base_prob <= 0 else F.array_join(
        F.transform(F.split(s, " ", -1), lambda t, j: F.when((t != "") & (draw(seed, row, i * 100_003 + j + 1) < base_prob), F.lit(MASK)).otherwise(t)), " "
    )
    pieces = F.transform(parts, lambda s, i: F.concat(F.when(i == 0, "").when(hide(i), F.lit(MASK)).otherwise(target), plain(s, i)))
    return F.when(target == "", text).otherwise(F.array_join(pieces, ""))
