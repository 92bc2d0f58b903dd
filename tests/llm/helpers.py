"""Documents that are hard to handle."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASH = ("score", "component_id", "gone", "gone_id", "kept_id", "d", "rest", "part", "fp", "lh", "toxic")

LONG = " ".join(f"word{k % 997} thing{k}" for k in range(8000))


def texts():
    base = "the quick brown fox jumps over the lazy dog and then it runs away from the big bad wolf " * 3
    return [
        None,
        "",
        " \n\t ",
        "short",
        base + "alpha",
        base + "alpha",
        base + "beta",
        "line one is here and is quite long\nline two is here and is quite long too\nline one is here and is quite long",
        "line one is here and is quite long\nanother line that stands alone in all of this",
        "write to a.b@example.com or +1 (234) 567-8901, card 4111 1111 1111 1111, host 10.0.0.1",
        "<|endoftext|> in the  middle <|endoftext|>\r\n odd　space é \U0001f600",
        LONG,
    ]


def messy(spark, clash=False):
    rows = [(k, t, "en", "src0", None if t is None else len(t)) for k, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, "no id here", None, None, 10)]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
