"""Parsing and scoring of free-text answers, strict (boxed only) and relaxed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmith.functions.text import CUES, NUMBER, all_numbers, boxed_all, first, last, strip, words

LABELS = ("A", "B", "C", "D", "E")
#: The patterns of answers.
DATE = r"((?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/[0-9]{4})"


def preferred_number(c: Column) -> Column:
    """After the last equals sign, else after the last cue, else the last number."""
    after_equals = last(F.regexp_extract_all(c, F.lit(rf"=\s*({NUMBER})"), F.lit(1)))
    after_cue = last(F.regexp_extract_all(c, F.lit(CUES), F.lit(1)))
    return F.replace(F.coalesce(after_equals, after_cue, last(all_numbers(c))), F.lit(","), F.lit(""))


def number_relaxed(t: Column) -> Column:
    sentence = F.substring_index(F.substring_index(t, "\n", -1), ". ", -1)
    phrase = F.when(t.contains("answer is "), strip(F.substring_index(t, "answer is ", -1))).otherwise(sentence)
    place = F.coalesce(last(boxed_all(t)), phrase)
    return F.coalesce(preferred_number(place), last(all_numbers(t)).try_cast("double").cast("string"))


def number_strict(t: Column) -> Column:
    found = F.transform(F.reverse(boxed_all(t)), preferred_number)
    return first(F.filter(found, lambda x: x.isNotNull()))


def _yes_no(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("yes"), F.lit("yes")).when(low.contains("no"), F.lit("no"))


def _first_known(a: Column, of) -> Column:
    return first(F.filter(F.transform(F.reverse(a), of), lambda x: x.isNotNull()))


def yes_no_relaxed(t: Column) -> Column:
    braces = F.regexp_extract_all(t, F.lit(r"\{([a-zA-Z]*)\}"), F.lit(1))
    loose = last(F.regexp_extract_all(F.lower(t), F.lit("(yes|no)"), F.lit(1)))
    return F.coalesce(_first_known(braces, _yes_no), loose)


def yes_no_strict(t: Column) -> Column:
    return _first_known(boxed_all(t), _yes_no)


def normalize_date(c: Column) -> Column:
    """MM/DD/YYYY text of three runs of digits, else null. No calendar check."""
    parts = F.filter(F.transform(F.split(c, "/"), strip), lambda x: x != "")
    digits = (F.size(parts) == 3) & F.forall(parts, lambda x: x.rlike("^[0-9]+$"))
    pad = lambda x: F.when(F.length(x) == 1, F.concat(F.lit("0"), x)).otherwise(x)
    year = F.get(parts, 2)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(digits, F.concat_ws("/", pad(F.get(parts, 0)), pad(F.get(parts, 1)), full))


def date_relaxed(t: Column) -> Column:
    loose = normalize_date(last(F.regexp_extract_all(t, F.lit(DATE), F.lit(1))))
    return F.coalesce(date_strict(t), loose)


def date_strict(t: Column) -> Column:
    return _first_known(boxed_all(t), normalize_date)


def bound(of, **columns: Column) -> Column:
    """of(s) with the columns as fields of s, each computed once: a lambda's variable isn't repeated as an expression is."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))), of), 0)


def _share(a: Column, x: Column, b: Column, y: Column) -> Column:
    """Similarity of texts a and b with words x and y."""
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    return F.when(a == b, F.lit(2.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(share)


def similarity(a: Column, b: Column) -> Column:
    """2 if equal, else shared distinct tokens over the longer token list."""
    return bound(lambda s: _share(s["a"], s["x"], s["b"], s["y"]), a=a, x=words(a), b=b, y=words(b))


def best_match(options: Column, text: Column) -> Column:
    """Place (from 1) of the first most similar option."""
    split = F.transform(options, lambda o: F.struct(o.alias("o"), words(o).alias("x")))

    def best(s: Column) -> Column:
        scored = F.transform(split, lambda o, i: F.struct(_share(o["o"], o["x"], s["t"], s["y"]).alias("score"), (-1 - i).alias("place")))
        top = F.array_max(F.filter(scored, lambda z: z["score"].isNotNull()))
        return -top["place"]

    return bound(best, t=text, y=words(text)).cast("long")


def bare_choice(c: Column) -> Column:
    return last(F.regexp_extract_all(c, F.lit(r"(?<![a-zA-Z])([ABCDE])(?![a-zA-Z])"), F.lit(1)))


def _choice(place: Column, options: Column, labels: Column) -> Column:
    def pick(s: Column) -> Column:
        shown = last(F.regexp_extract_all(s["bare"], F.lit(r"\(([A-E])\)"), F.lit(1)))
        return F.coalesce(shown, bare_choice(s["bare"]), F.try_element_at(labels, best_match(options, s["place"]).cast("int")))

    return bound(pick, place=place, bare=strip(place))


def choice_relaxed(t: Column, options: Column, labels: Column) -> Column:
    return _choice(F.coalesce(last(boxed_all(t)), F.substring_index(t, "\n", -1)), options, labels)


def choice_strict(t: Column, options: Column, labels: Column) -> Column:
    return bound(lambda s: F.when(s["box"].isNotNull(), _choice(s["box"], options, labels)), box=last(boxed_all(t)))


def flat_labels() -> Column:
    return F.array(*(F.lit(x) for x in LABELS))


def text_relaxed(t: Column) -> Column:
    return strip(last(F.regexp_extract_all(t, F.lit(r"boxed\{(.*?)\}"), F.lit(1))))


def text_strict(t: Column) -> Column:
    return last(boxed_all(t))


def score_number(pred: Column, target: Column) -> Column:
    near = F.abs(pred.try_cast("double") - target.try_cast("double")) < 1e-3
    return F.coalesce(near, F.lit(False)).cast("int")


def score_equal(pred: Column, target: Column) -> Column:
    return F.coalesce(F.lower(strip(pred)) == F.lower(strip(target)), F.lit(False)).cast("int")


def score_date(pred: Column, scores: Column) -> Column:
    return F.coalesce(F.try_element_at(scores, pred) > 0, F.lit(False)).cast("int")
