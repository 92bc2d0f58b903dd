"""Character and token spans: segmentation, overlap joins, islands, intervals, prefix sums."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.functions.answers import bound

#: The sentence break, and lengths in characters (a short span, the least of it, a line that may be cut, a heading).
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
SHORT, LEAST, LONG_LINE, HEADING = 24, 8, 80, 40


def _trimmed(text: str, a: int, b: int) -> tuple[int, int] | None:
    body = text[a:b]
    left = len(body) - len(body.lstrip())
    return (a + left, a + left + len(body.strip())) if body.strip() else None


def _heads_next(s: str) -> bool:
    return (s.endswith(":") and len(s) <= HEADING) or (len(s) >= 2 and s[0] == "[" and s[-1] == "]")


def segment(text: str | None, min_chars: int = SHORT) -> list[tuple[int, int]]:
    """Spans of a prompt: lines, long ones by sentence; a heading joins what follows; short spans join."""
    text, least = text or "", max(LEAST, int(min_chars))
    spans: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        whole = _trimmed(text, at, at + len(line))
        at += len(line) + 1
        if whole is None:
            continue
        body = text[slice(*whole)]
        if len(body) < LONG_LINE or _heads_next(body) or not re.search("[.!?]", body):
            spans.append(whole)
            continue
        cuts = [0, *(x for m in SENTENCE_END.finditer(body) for x in m.span()), len(body)]
        spans += [s for a, b in zip(cuts[::2], cuts[1::2], strict=True) if (s := _trimmed(text, whole[0] + a, whole[0] + b))]
    joined: list[tuple[int, int]] = []
    queue = iter(spans)
    for a, b in queue:
        if _heads_next(text[a:b].strip()):
            b = next(queue, (a, b))[1]
        joined.append((a, b))
    out: list[tuple[int, int]] = []
    size = lambda s: len(text[slice(*s)].strip())
    for s in joined:
        if out and (size(out[-1]) < least or size(s) < max(LEAST, least // 2)):
            out[-1] = (out[-1][0], s[1])
        else:
            out.append(s)
    if len(out) > 1 and size(out[-1]) < least:
        tail = out.pop()
        out[-1] = (out[-1][0], tail[1])
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def segment_spans(text: pa.Array) -> pa.Array:
    """Spans are kept as numbers, and one text is a Python string at a time."""
    places, ends = array("i"), array("i", [0])
    for t in text:
        for span in segment(t.as_py()):
            places.extend(span)
        ends.append(len(places) // 2)
    found = np.frombuffer(places, np.int32).reshape(-1, 2) if places else np.zeros((0, 2), np.int32)
    spans = pa.StructArray.from_arrays([pa.array(found[:, k].copy()) for k in (0, 1)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), spans)


def lines_of(text: Column) -> Column:
    """Lines that aren't empty."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def prefix_sums(a: Column, step: int = 256) -> Column:
    """The sum up to each entry of an array of ints. Sums are listed in parts of ``step`` entries, since a list that grows by one entry is copied each time."""
    zero, none = F.lit(0), F.array().cast("array<int>")
    grown = lambda xs, start: F.aggregate(xs, F.struct(start.alias("s"), none.alias("out")), lambda t, x: F.struct((t["s"] + x).alias("s"), F.concat(t["out"], F.array(t["s"] + x)).alias("out")))["out"]
    parts = F.transform(F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(step))).otherwise(none), lambda at: F.slice(a, at, step))

    def listed(s: Column) -> Column:
        ends = grown(F.transform(s["parts"], lambda p: F.aggregate(p, zero, lambda t, x: t + x)), zero)
        return bound(lambda e: F.flatten(F.transform(s["parts"], lambda p, k: grown(p, F.when(k == 0, zero).otherwise(F.get(e["ends"], k - 1))))), ends=ends)

    return bound(listed, parts=parts)


def substring_starts(text: Column, part: Column) -> Column:
    """Starts (from 0) of all non-overlapping occurrences, from the left."""
    n = F.length(part)
    pieces = F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p) + n)
    found = bound(lambda s: F.transform(prefix_sums(s["lengths"]), lambda end: end - s["n"]), lengths=lengths, n=n)
    return F.when((n > 0) & (F.length(text) > 0), found).otherwise(F.array().cast("array<int>"))


def token_spans(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Overlap join within a key: tokens (tok, tok_start, tok_end) to spans (span, start, end); first token and end, exclusive.

    One sweep of a key's places in order, linear in tokens and spans; spans may overlap, tokens
    don't and stand in the order of tok. Tokens and spans without a character overlap nothing.
    """
    none = F.lit(None)
    marks = tokens.where("tok_end > tok_start").select(
        key, F.col("tok_start").alias("at"), F.lit(2).alias("kind"), "tok", F.col("tok_end").alias("until"), none.cast("long").alias("span")
    )
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("end").alias("at"), F.lit(1).alias("kind"))))
    bounds = spans.where(F.col("end") > F.col("start")).select(key, F.col("span").cast("long").alias("span"), ends.alias("e"))
    bounds = bounds.select(key, "e.at", "e.kind", none.cast(tokens.schema["tok"].dataType).alias("tok"), none.cast(tokens.schema["tok_end"].dataType).alias("until"), "span")
    order = Window.partitionBy(key).orderBy("at", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.unionByName(bounds).select(
        key, "span", "kind", "at",
        F.last("tok", ignorenulls=True).over(so_far).alias("before"),
        F.last("until", ignorenulls=True).over(so_far).alias("reach"),
        F.expr(f"lead(tok, 1) IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY at, kind)").alias("after"),
    ).where("span IS NOT NULL")
    first = F.when(F.col("reach") > F.col("at"), F.col("before")).otherwise(F.col("after"))
    found = swept.groupBy(key, "span").agg(
        F.max(F.when(F.col("kind") == 0, first)).alias("first_tok"), (F.max(F.when(F.col("kind") == 1, F.col("before"))) + 1).alias("end_tok")
    )
    return found.where("first_tok < end_tok").withColumn("span", F.col("span").cast(spans.schema["span"].dataType))


def part_spans(text: Column, sep: str) -> Column:
    """Offsets of the parts of a text between separators of one character: an array of start and end, exclusive."""
    listed = lambda s: F.transform(prefix_sums(F.transform(s["n"], lambda n: n + 1), 24), lambda e, i: F.struct((e - F.get(s["n"], i) - 1).alias("start"), (e - 1).alias("end")))
    return bound(listed, n=F.transform(F.split(text, sep), F.length))


def count_upto(a: Column, x: Column) -> Column:
    """How many entries of an ascending array are at most x, by bisection."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(a) + 1)).cast("int") + 1, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(a)) & (F.get(a, at + step - 1) <= x), at + step).otherwise(at))


def token_ranges(tokens: Column, spans: Column) -> Column:
    """token_spans within a row: arrays of start and end to an array of each span's place (span), first token and end, exclusive.

    Both are null for a span that overlaps no token. Tokens don't overlap and stand in order; a
    span's tokens are found by bisection, so no row is made for a token and none is shuffled.
    """
    full = F.filter(F.transform(tokens, lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), i.alias("tok"))), lambda t: t["end"] > t["start"])

    def ranges(s: Column) -> Column:
        def placed(x: Column, i: Column) -> Column:
            found = lambda k: (x["end"] > x["start"]) & (k["first"] < k["last"])
            of = lambda k: F.struct(
                i.alias("span"), F.when(found(k), F.get(s["toks"], k["first"])).alias("first_tok"), F.when(found(k), F.get(s["toks"], k["last"] - 1) + 1).alias("end_tok")
            )
            return bound(of, first=count_upto(s["ends"], x["start"]), last=count_upto(s["starts"], x["end"] - 1))

        return F.transform(s["spans"], placed)

    sides = lambda s: bound(ranges, starts=s["full"]["start"], ends=s["full"]["end"], toks=s["full"]["tok"], spans=s["spans"])
    return bound(sides, full=full, spans=spans)


def token_targets(rows: DataFrame, key: str, tokens: str, spans: str) -> DataFrame:
    """key, tok and the greatest target of the spans that overlap the token, null for none. tokens and spans: columns as token_ranges takes them, a span with its target.

    A document's tokens are cut where a span's tokens begin or end and around tokens without a
    character. The cuts are shuffled, not the tokens: each piece has one target, and is listed last.
    """
    def pieces(s: Column) -> Column:
        piece = lambda k, target: F.struct(F.get(s["cuts"], k).alias("first"), F.get(s["cuts"], k + 1).alias("until"), target.alias("target"))
        every = F.transform(F.slice(s["cuts"], 1, F.size(s["cuts"]) - 1), lambda _, k: piece(k, F.lit(None).cast("long")))
        inner = lambda r: F.slice(s["cuts"], count_upto(s["cuts"], r["first_tok"] - 1) + 1, count_upto(s["cuts"], r["end_tok"] - 1) - count_upto(s["cuts"], r["first_tok"] - 1))
        listed = lambda r: F.transform(inner(r), lambda _, k: piece(count_upto(s["cuts"], r["first_tok"] - 1) + k, F.get(s["spans"], r["span"])["target"].cast("long")))
        empty = lambda p: F.get(s["tokens"], p["first"])["end"] <= F.get(s["tokens"], p["first"])["start"]
        return F.concat(every, F.filter(F.flatten(F.transform(s["ranges"], listed)), lambda p: ~empty(p)))

    def cut(s: Column) -> Column:
        bare = F.filter(F.transform(s["tokens"], lambda t, i: F.when(t["end"] <= t["start"], i)), lambda i: i.isNotNull())
        at = F.concat(F.array(F.lit(0), F.size(s["tokens"])), s["ranges"]["first_tok"], s["ranges"]["end_tok"], bare, F.transform(bare, lambda i: i + 1))
        return bound(pieces, cuts=F.sort_array(F.array_distinct(at)), ranges=s["ranges"], tokens=s["tokens"], spans=s["spans"])

    joined = lambda s: bound(cut, ranges=F.filter(token_ranges(s["tokens"], s["spans"]), lambda r: r["first_tok"].isNotNull()), tokens=s["tokens"], spans=s["spans"])
    found = rows.select(key, F.explode(bound(joined, tokens=F.col(tokens), spans=F.col(spans))).alias("p"))
    best = found.groupBy(key, "p.first", "p.until").agg(F.max("p.target").alias("target"))
    return best.select(key, F.explode(F.sequence(F.col("first").cast("long"), F.col("until").cast("long") - 1)).alias("tok"), "target")


def islands(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Runs of equal values that aren't null: first position and end, exclusive."""
    order = Window.partitionBy(key).orderBy(pos)
    rows = df.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(order))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(value).isNotNull())
    return rows.groupBy(key, "_island", value).agg(F.min(pos).alias("first"), (F.max(pos) + 1).alias("end")).drop("_island")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals as one."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def find_subsequence(hay: Column, needle: Column, start: int = 0) -> Column:
    """First place (from 0, at least start) of needle in hay; null if absent or empty."""
    n, m = F.size(hay), F.size(needle)
    places = F.when((m > 0) & (n - m >= start), F.sequence(F.lit(start + 1), F.greatest(n - m + 1, F.lit(start + 1))))
    return F.try_element_at(F.filter(places, lambda i: F.slice(hay, i, F.greatest(m, F.lit(1))) == needle), F.lit(1)) - 1


def normalize_distribution(a: Column) -> Column:
    """Negative entries as 0, divided by the sum; uniform where that is 0."""
    kept = F.transform(a, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    total = lambda s: F.aggregate(s["kept"], F.lit(0.0), lambda t, x: t + x)
    share = lambda s: F.transform(s["kept"], lambda x: F.when(s["total"] > 0, x / s["total"]).otherwise(F.lit(1.0) / F.size(s["kept"])))
    return F.when(a.isNotNull(), bound(lambda s: bound(share, kept=s["kept"], total=total(s)), kept=kept))


def span_mean(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Mean of value over positions [start, end) by prefix sums: two equi-joins, no range join."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = points.select(key, (F.col("pos") + 1).alias("pos"), F.sum("value").over(order).alias("s"))
    low = sums.select(key, F.col("pos").alias("start"), F.col("s").alias("s0"))
    high = sums.select(key, F.col("pos").alias("end"), F.col("s").alias("s1"))
    joined = spans.join(low, [key, "start"], "left").join(high, [key, "end"], "left")
    return joined.withColumn("mean", (F.col("s1") - F.coalesce("s0", F.lit(0.0))) / (F.col("end") - F.col("start"))).drop("s0", "s1")
