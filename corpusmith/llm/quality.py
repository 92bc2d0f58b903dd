"""Quality rules: learned decision lists over text statistics.

Statistics of each whole text are taken in one map over the scan. A bounded sample of
labelled rows (``max_train``, the least hashes of doc_id) teaches an ordered list of rules
by sequential covering: each rule is a conjunction of thresholds, grown by information gain
on two thirds of the remaining rows, pruned on the other third (any term may go), and kept
while it is precise enough; rows that it covers leave. The list is emitted as ordered Spark
conditionals, applied to every row: the first rule that holds rejects a text.

Scale: no shuffle but that of the labels' join on (doc_id, statistics), numbers only.

Cases: a null or empty text has no words and fails the base rule; repeated rows are judged
each; no labels, or labels of one kind, teach an empty list that keeps; labels that repeat
a doc_id count as their least value; an empty table gives no rows; further columns are not
carried along.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import common

MAX_TRAIN = 20_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_adjacent", "n_upper", "n_marks")
#: What rules may test; each is a ratio that does not grow with the text.
FEATURES: dict[str, tuple[str, str]] = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "adjacent_share": ("n_adjacent", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}


def text_counts(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # bytes.split: exactly \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup, seen, full = 0, set(), 0
    for line in lines:
        if line.strip(SPACES):
            full += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        count, reach = Counter(windows), 0
        for k, w in enumerate(windows):
            if count[w] > 1:
                repeated += k + 3 - max(reach, k)
                reach = k + 3
    adjacent = sum(map(eq, words, words[1:]))
    ascii_text = text.encode("ascii", "ignore")
    upper = len(ascii_text) - len(ascii_text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = text.count("!") + text.count("?")
    return n, chars, symbols, dup, repeated, full, adjacent, upper, marks


def _counts(batches):
    for batch in batches:
        rows = [text_counts(x) for x in batch.column(1).to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(COUNTS)
        yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(_counts, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


Rule = list[tuple[str, str, float]]


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, max_terms: int = 4, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """Ordered rules that pick bad rows. x: rows by features."""
    fold = np.arange(len(x)) % 3 == 2
    terms, holds = [], []
    for k, name in enumerate(names):
        values = np.unique(x[:, k])
        cuts = np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 64))) if len(values) > 1 else []
        for c in cuts:
            terms += [(name, ">", float(c)), (name, "<=", float(c))]
            holds += [x[:, k] > c, x[:, k] <= c]
    if not terms:
        return []
    m = np.array(holds)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    for _ in range(max_rules):
        grow, prune = left & ~fold, left & fold
        if (bad & grow).sum() < min_cover:
            break
        cover, rule = grow.copy(), []
        while len(rule) < max_terms and (cover & ~bad).any():
            p0, n0 = (cover & bad).sum(), (cover & ~bad).sum()
            p = (m[:, cover & bad]).sum(axis=1)
            q = (m[:, cover & ~bad]).sum(axis=1)
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + q, 1)) - np.log2(p0 / (p0 + n0))), -1)
            best = int(np.argmax(gain))
            if gain[best] <= 0:
                break
            rule.append(best)
            cover &= m[best]

        def worth(r: list[int], rows: np.ndarray) -> float:
            c = rows.copy()
            for t in r:
                c &= m[t]
            p, q = (c & bad).sum(), (c & ~bad).sum()  # noqa: B023
            return (p - q) / (p + q) if p + q else -1.0

        def precise(r: list[int]) -> bool:
            c = left.copy()
            for t in r:
                c &= m[t]
            return (bad & c).sum() >= max(min_cover, min_precision * c.sum())  # noqa: B023

        # Prune: of the rule's beginnings, and of what is left when any terms are dropped one by one, the precise one of the most worth.
        options = [rule[:k] for k in range(1, len(rule) + 1)]
        shorter = rule
        while len(shorter) > 1:
            shorter = max((shorter[:k] + shorter[k + 1 :] for k in range(len(shorter))), key=lambda r: worth(r, prune))  # noqa: B023
            options.append(shorter)
        options = [r for r in options if precise(r)]
        if not options:
            break
        rule = max(options, key=lambda r: (worth(r, prune), -len(r)))  # noqa: B023
        rules.append([terms[t] for t in rule])
        cover = left.copy()
        for t in rule:
            cover &= m[t]
        left &= ~cover
    return rules


def rejects(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), 0 where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for name, op, cut in rule:
            cond &= feature(name) > cut if op == ">" else feature(name) <= cut
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def train(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> list[Rule]:
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.where("n_words > 0").join(marked, "doc_id").select("doc_id", "quality", *(feature(n).alias(n) for n in FEATURES))
    # Of rows that repeat a doc_id the least, whatever task comes first.
    least = known.groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("r")).select("doc_id", "r.*")
    rows = common.least_hashes(least, "doc_id", max_train).toPandas()
    if rows.empty:
        return []
    return learn_rules(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy() == 0, list(FEATURES))


def quality_verdicts(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    stats, _ = common.materialize(statistics(docs), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rejects(train(stats, labels, max_train))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
