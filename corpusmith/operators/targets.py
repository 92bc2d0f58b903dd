"""Masking of target texts in prompts: runs of tokens that a target overlaps are masked as one.

Every occurrence of every target is found (of one target, from the left, none that overlaps the
one before). A token belongs to the last of the targets that overlap it; neighbours of one
target are a run, which one draw masks or leaves. Earlier targets are masked with a lower
probability than later ones, other tokens with a base probability. What stands between tokens
is copied.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.text import SPACE
from corpusmith.operators.masking import MASK, mask_tokens

WORD = re.compile(f"[^{SPACE}]+")
FEW = 3  # targets that are searched one by one


@lru_cache(maxsize=256)
def _automaton(targets: tuple[str, ...]):
    import ahocorasick

    found: dict[str, list[int]] = {}
    for k, t in enumerate(targets):
        found.setdefault(t, []).append(k)
    automaton = ahocorasick.Automaton()
    for t, places in found.items():
        automaton.add_word(t, (len(t), places))
    automaton.make_automaton()
    return automaton


def occurrences(text: str, targets: tuple[str, ...]) -> list[tuple[int, int, int]]:
    """(start, end, target) by start, end and target."""
    out = []
    if len(targets) <= FEW:
        for k, t in enumerate(targets):
            at = text.find(t)
            while at >= 0:
                out.append((at, at + len(t), k))
                at = text.find(t, at + len(t))
    else:
        reach = [0] * len(targets)
        for last, (size, places) in _automaton(targets).iter(text):
            for k in places:
                if last + 1 - size >= reach[k]:
                    reach[k] = last + 1
                    out.append((last + 1 - size, last + 1, k))
    return sorted(out)


def token_targets(tokens: Sequence[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The last target that overlaps each token, -1 for none: one sweep, tokens and spans in order of their starts."""
    out, open_, nxt = [], [], 0
    for a, b in tokens:
        while nxt < len(spans) and spans[nxt][0] < b:
            heapq.heappush(open_, (-spans[nxt][2], spans[nxt][1]))
            nxt += 1
        while open_ and open_[0][1] <= a:
            heapq.heappop(open_)
        out.append(-open_[0][0] if open_ else -1)
    return out


def draw(seed: int, row: object, place: int) -> float:
    """masking.draw for one place."""
    return int(hashlib.md5(f"{seed}:{row}:{place}".encode()).hexdigest()[:8], 16) / (1 << 32)


def probability(target: int, n: int, earlier: float, last: float) -> float:
    return last if n <= 1 else earlier + (last - earlier) * min(max(target / (n - 1), 0.0), 1.0)


def masked(text: str, tokens: Sequence[tuple[int, int]], targets: tuple[str, ...], row: object, earlier: float, last: float, base: float, seed: int) -> str:
    """text with runs of targets and other tokens masked; a draw's place is that of the run's first token."""
    tokens = [t for t in tokens if t[1] > t[0]]
    of = token_targets(tokens, occurrences(text, targets))
    parts, done, at = [], 0, 0
    while at < len(tokens):
        end = at + 1
        while of[at] >= 0 and end < len(tokens) and of[end] == of[at]:
            end += 1
        p = base if of[at] < 0 else probability(of[at], len(targets), earlier, last)
        a, b = tokens[at][0], tokens[end - 1][1]
        parts += [text[done:a], MASK if p > 0 and draw(seed, row, at) < p else text[a:b]]
        done, at = b, end
    return "".join([*parts, text[done:]])


def mask_targets(df: DataFrame, text: str, targets: str, row: str, earlier: float = 0.3, last: float = 0.9, base: float = 0.05, prob: float = 0.5, seed: int = 42, offsets: str | None = None, out: str = "masked") -> DataFrame:
    """df with the text masked. targets: a column of lists; offsets: one of tokens' (start, end), else tokens are words.

    A row without a token or a target that isn't blank is masked token by token (mask_tokens, prob).
    """
    takes = [text, targets, row, *([offsets] if offsets else [])]

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            found = []
            for t, goals, r, *places in zip(*batch, strict=True):
                wanted = tuple(g.strip(SPACE) for g in ([] if goals is None else goals) if g is not None and g.strip(SPACE))
                if not t or not wanted:
                    found.append(None)
                    continue
                tokens = [m.span() for m in WORD.finditer(t)] if not places else [(s["start"], s["end"]) for s in ([] if places[0] is None else places[0])]
                found.append(masked(t, tokens, wanted, r, earlier, last, base, seed) if tokens else None)
            yield pd.Series(found, dtype=object)

    plain = mask_tokens(F.col(text), F.col(row), prob, seed)
    return df.withColumn(out, F.coalesce(run(*(F.col(c).cast("string") if c == row else F.col(c) for c in takes)), plain))
