"""Text functions, Column to Column, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and str.split take for white space.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
#: The patterns of numbers, cue words and boxes in answers.
NUMBER = r"[\-+]?\d*[\.,/]?\d+"
CUES = r"(?i)(?:final answer|answer is|therefore|thus|hence|so|result(?: is)?|we get)\D*(" + NUMBER + ")"
BOXED = r"(?s)boxed\{(.*?)\}"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def words(c: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda x: x != "")


def word_length(prompt: Column, answer: Column) -> Column:
    return F.size(words(F.concat(prompt, F.lit(" "), answer)))


def normalize_text(c: Column) -> Column:
    return F.array_join(words(F.lower(c)), " ")


def strip_think(c: Column) -> Column:
    """Without closed reasoning blocks; white space collapsed. An unclosed tag stays."""
    return F.array_join(words(F.regexp_replace(c, r"(?is)<think>.*?</think>", " ")), " ")


def boxed_all(c: Column) -> Column:
    """Stripped contents of all boxes that hold any, cut at the first closing brace."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(BOXED), F.lit(1)), strip), lambda x: x != "")


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def first(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def all_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))


def or_none_text(c: Column) -> Column:
    """An explicit null reads as the text None."""
    return F.coalesce(c, F.lit("None"))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_list(a: Column) -> Column:
    """Stripped entries that aren't empty; null is an empty list."""
    kept = F.filter(F.transform(a, lambda x: strip(or_empty(x))), lambda x: x != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def first_non_empty(a: Column) -> Column:
    return or_empty(first(normalize_list(a)))


def preview(c: Column, limit: int = 240) -> Column:
    t = F.array_join(words(c), " ")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def slugify(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    h, m, r = (s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int")
    text = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))
    odd = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    return F.when(odd, F.lit("--:--")).otherwise(text)


def code_block(c: Column) -> Column:
    """The last fenced block, else the whole text."""
    return strip(F.coalesce(last(F.regexp_extract_all(c, F.lit(r"(?is)```(?:python)?\s*(.*?)```"), F.lit(1))), c))


def is_heading(c: Column) -> Column:
    t = strip(c)
    return (t != "") & (F.length(t) <= 40) & t.endswith(":")


def is_title(c: Column) -> Column:
    t = strip(c)
    return t.startswith("[") & t.endswith("]") & (F.length(t) >= 2)


def example_id(index: Column, prefix: str = "blend") -> Column:
    return F.format_string(f"{prefix}:%09d", index)


def strip_math(c: Column) -> Column:
    for gone in (" ", "\\left", "\\right", "\\!", "$", "\\,"):
        c = F.replace(c, F.lit(gone), F.lit(""))
    return c


def last_boxed(c: Column) -> Column:
    """Contents of the last box with braces balanced; null where there is none."""
    rest = F.regexp_extract(c, r"(?s).*boxed\{(.*)$", 1)
    state = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        done = s["depth"] == 0
        out = F.when(done | (depth == 0), s["out"]).otherwise(F.concat(s["out"], ch))
        return F.struct(F.when(done, F.lit(0)).otherwise(depth).alias("depth"), out.alias("out"))

    found = F.aggregate(F.split(rest, ""), state, step)["out"]
    return F.when(c.contains("boxed{"), found)


def normalize_numeric(c: Column) -> Column:
    """Plain form of a numeral; other text is only stripped. A zero divisor gives null."""
    t = F.regexp_replace(F.regexp_replace(strip(c), r"^\$", ""), r"[,\./]$", "")
    plain = F.replace(t, F.lit(","), F.lit(""))
    fraction = F.bround(
        F.try_divide(F.split_part(plain, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(plain, F.lit("/"), F.lit(2)).try_cast("double")), 3
    )
    number = F.when(plain.rlike(r"^[-+]?\d+$"), plain.try_cast("long").cast("string")).when(plain.contains("/"), fraction.cast("string")).otherwise(
        F.bround(plain.try_cast("double"), 3).cast("string")
    )
    return F.when(t.rlike(r"^[-+]?[\d,./]+$"), F.regexp_replace(number, r"\.0+$", "")).otherwise(t)
