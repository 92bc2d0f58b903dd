"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels.

A sentence's probability is a logistic of the weights of its words and their beginnings (hashed, each once); a
document's is 1 - prod(1 - p) over its sentences. Only document labels are known; the
likelihood's gradient shares a document's label out among its sentences. The sentence
probabilities then locate the offending sentences.

Fitting uses at most ``max_train`` labelled documents of each class (the least hashes of
doc_id) outside the held-out fold. Their word counts by class are summed in Spark; the
``max_features`` most telling words alone get a weight, and only their occurrences go to
the driver; texts of over ``max_chars`` teach nothing, so these are bounded too. Scoring is
a map over the scan of all whole texts, no shuffle.

Cases: a null or empty text is one empty sentence and gets the bias's probability; repeated
rows are scored each; labels that repeat a doc_id count as their greatest value; no labels,
or labels of one class, leave the bias alone; an empty table gives no rows; further columns
are not carried along.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import common

BUCKETS = 1 << 18
MAX_TRAIN = 4000
MAX_FEATURES = 512
MAX_CHARS = 100_000  # of a text to learn from
FOLDS = 5
BIAS = -11.0
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (3, 4, 5, 6)
STRIP = ".,;:!?\"'()[]{}*#$%&|<>"
MARKS = str.maketrans(".!?", "   ")  # a word ends where a sentence does
SCORED = "doc_id long, score double, n_offending int, worst_start long, worst_end long, worst_score double"

_BUCKETS: dict[str, tuple[int, ...]] = {}


def buckets(word: str) -> tuple[int, ...]:
    """Hashed features of a word: the word, and its beginnings, which endings don't hide."""
    got = _BUCKETS.get(word)
    if got is None:
        if len(_BUCKETS) > 150_000:
            _BUCKETS.clear()
        w = word.lower().strip(STRIP)
        names = [w, *(w[:k] + "~" for k in PREFIXES if len(w) > k)]
        got = _BUCKETS[word] = tuple(zlib.crc32(x.encode()) % BUCKETS for x in names)
    return got


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences with a word; one empty span if there is none."""
    spans = [m.span() for m in SENTENCE.finditer(text) if not m[0].isspace()]
    return spans or [(0, 0)]


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0


def _document_counts(batches):
    for batch in batches:
        n = np.zeros((2, BUCKETS), np.int64)
        for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n[toxic, list({k for w in set(text.translate(MARKS).split()) for k in buckets(w)})] += 1
        t, b = np.nonzero(n)
        yield pa.record_batch([pa.array(b), pa.array(t), pa.array(n[t, b])], names=["bucket", "toxic", "n"])


def _occurrences(features: dict[int, int]):
    def run(batches):
        for batch in batches:
            docs, tox, sizes, hits = [], [], [], []
            for doc, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = sentences(text)
                rows = []
                for a, b in spans:
                    got = {features[k] for w in text[a:b].split() for k in buckets(w) if k in features}
                    if got:
                        rows.append(sorted(got))
                docs.append(doc)
                tox.append(toxic)
                sizes.append(len(spans))
                hits.append(rows)
            yield pa.record_batch(
                [pa.array(docs, pa.int64()), pa.array(tox, pa.int32()), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int32())))],
                names=["doc_id", "toxic", "n_sentences", "hits"],
            )

    return common.tidied(run, _BUCKETS)


def fit_noisy_or(n_sentences: np.ndarray, hits: list, toxic: np.ndarray, n_features: int, rounds: int = 400, rate: float = 0.1, l2: float = 1e-4):
    """Weights and bias by Adam on the noisy-or likelihood.

    Sentences without a feature all have the bias's probability, so a document needs their number alone.
    """
    doc = np.array([d for d, rows in enumerate(hits) for _ in rows], np.int64)
    flat = [r for rows in hits for r in rows]
    sent = np.array([s for s, r in enumerate(flat) for _ in r], np.int64)
    feat = np.array([f for r in flat for f in r], np.int64)
    plain = n_sentences - np.bincount(doc, minlength=len(n_sentences))
    weight = np.full(len(toxic), 1 / max(1, len(toxic)))
    theta = np.zeros(n_features + 1)
    theta[-1] = BIAS
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.full(len(flat), theta[-1])
        if len(feat):
            z += np.bincount(sent, theta[feat], minlength=len(flat))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-theta[-1]))
        miss = np.bincount(doc, np.logaddexp(0, np.clip(z, -30, 30)), minlength=len(plain)) + plain * np.logaddexp(0, theta[-1])
        score = -np.expm1(-miss)
        # d(-log likelihood)/d(miss): miss = -log(1 - score)
        up = weight * np.where(toxic == 1, -(1 - score) / np.maximum(score, 1e-12), 1.0)
        gz = up[doc] * p
        g = np.zeros_like(theta)
        if len(feat):
            g[:-1] = np.bincount(feat, gz[sent], minlength=n_features)
        g[-1] = gz.sum() + (up * plain).sum() * p0
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, **bounds: int) -> tuple[dict[int, float], float]:
    """Weights by bucket, and the bias. bounds: max_train, max_features and max_chars."""
    paths: list[str] = []
    try:
        return _train(docs, labels, paths, **bounds)
    finally:
        for path in paths:
            common.drop_path(docs.sparkSession, path)


def _train(docs: DataFrame, labels: DataFrame, paths: list[str], max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, max_chars: int = MAX_CHARS) -> tuple[dict[int, float], float]:
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    parts = [common.least_hashes(marked.where(F.col("toxic") == k), "doc_id", max_train) for k in (0, 1)]
    chosen, chosen_path = common.materialize(parts[0].union(parts[1]), "chosen")  # at most 2 * max_train rows
    paths.append(chosen_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    picked, path = common.materialize(rows.where(F.length("text") <= max_chars).select("doc_id", "text", "toxic"), "training")
    paths.append(path)
    size = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return {}, BIAS
    counts = picked.mapInArrow(common.tidied(_document_counts, _BUCKETS), "bucket long, toxic long, n long").groupBy("bucket", "toxic").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((2, BUCKETS))
    n[counts["toxic"], counts["bucket"]] = counts["n"]
    share = (n + 0.5) / np.array([[size[0] + 1], [size[1] + 1]])
    both = n.sum(axis=0)
    mean = (both + 1) / (size[0] + size[1] + 2)
    z = (share[1] - share[0]) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / size[0] + 1 / size[1]))
    best = [int(b) for b in np.argsort(-np.abs(z), kind="stable")[:max_features] if both[b] >= 4 and abs(z[b]) > 4]
    if not best:
        return {}, BIAS
    features = {b: k for k, b in enumerate(best)}
    seen = picked.mapInArrow(_occurrences(features), "doc_id long, toxic int, n_sentences long, hits array<array<int>>")
    found = seen.orderBy("doc_id", "n_sentences").toPandas()
    hits = [[[int(x) for x in r] for r in rows] for rows in found["hits"]]
    w, b = fit_noisy_or(found["n_sentences"].to_numpy(), hits, found["toxic"].to_numpy(), len(best))
    return dict(zip(best, w.tolist(), strict=True)), b


def _scorer(weights: dict[int, float], bias: float):
    """text -> (score, offending sentences, worst start, worst end, worst score)."""
    p0 = np.log1p(np.exp(bias))
    by_word: dict[str, bool] = {}

    def one(text: str) -> tuple:
        if len(by_word) > 300_000:
            by_word.clear()
        told = set()
        plain = text.translate(MARKS)
        for w in set(plain.split()):
            x = by_word.get(w)
            if x is None:
                x = by_word[w] = any(k in weights for k in buckets(w))
            if x:
                told.add(w)
        spans = sentences(text)
        miss, worst, at, bad = 0.0, bias, spans[0], 0
        if not told:
            miss = len(spans) * p0
        else:
            for a, b in spans:
                hit = {k for w in plain[a:b].split() if w in told for k in buckets(w) if k in weights}
                z = bias + sum(weights[k] for k in sorted(hit))
                miss += float(np.logaddexp(0, z)) if hit else p0
                bad += z >= 0
                if z > worst:
                    worst, at = z, (a, b)
        return float(-np.expm1(-miss)), bad, *at, float(1 / (1 + np.exp(-worst)))

    return one


def _score(weights: dict[int, float], bias: float):
    def run(batches):
        one = _scorer(weights, bias)
        for batch in common.slices(batches, 1024):
            out = [(doc, *one(text)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                names=["doc_id", "score", "n_offending", "worst_start", "worst_end", "worst_score"],
            )

    return common.tidied(run, _BUCKETS)


def score(docs: DataFrame, weights: dict[int, float], bias: float) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(_score(weights, bias), SCORED)


def keep_clean(docs: DataFrame, weights: dict[int, float], bias: float, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below the limit, all columns kept."""
    where = docs.columns.index("text")

    def run(batches):
        one = _scorer(weights, bias)
        for batch in common.slices(batches, 1024):
            yield batch.filter(pa.array([one(x or "")[0] < limit for x in batch.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(common.tidied(run, _BUCKETS), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, *train(docs, common.table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_offending",
        "worst_start",
        "worst_end",
        "worst_score",
    )
