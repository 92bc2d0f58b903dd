import math
from itertools import combinations

import pytest
from helpers_core import one
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmith.functions import answers as A
from corpusmith.functions import metrics, models, stemming, text


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("f", "given_text", "want"),
    [
        (A.number_relaxed, "The answer is 12.", "12"),
        (A.number_relaxed, "\\boxed{1,234}", "1234"),
        (A.number_relaxed, "\\boxed{1,234,567}", "567"),
        (A.number_relaxed, "seven 7\nnothing here", "7.0"),
        (A.number_relaxed, "3/4\nnothing", None),
        (A.number_strict, "12", None),
        (A.number_strict, "\\boxed{x} \\boxed{5} \\boxed{y}", "5"),
        (A.yes_no_relaxed, "I do not know", "no"),
        (A.yes_no_relaxed, "{Yes} or no", "yes"),
        (A.yes_no_strict, "{Yes} or no", None),
        (A.date_relaxed, "\\boxed{5/1/22}", "05/01/2022"),
        (A.date_relaxed, "on 5/1/2022", "05/01/2022"),
        (A.date_strict, "on 5/1/2022", None),
        (A.date_strict, "\\boxed{99/99/2020}", "99/99/2020"),
        (A.bare_choice, "A B", "B"),
        (A.text_strict, "boxed{ a } boxed{ }", "a"),
        (text.strip_think, "<think>step by step</think> final answer", "final answer"),
        (text.strip_think, "<think>open", "<think>open"),
        (text.slugify, "Qwen/Qwen3-1.7B", "qwen_qwen3_1_7b"),
        (text.last_boxed, "\\boxed{1} then \\boxed{a{b}c} x", "a{b}c"),
        (text.code_block, "a\n```python\nx = 1\n```", "x = 1"),
        (text.normalize_numeric, "$1,234.", "1234"),
        (text.normalize_numeric, "1/8", "0.125"),
        (text.normalize_numeric, "2.5000", "2.5"),
        (text.normalize_numeric, "5 cm", "5 cm"),
    ],
)
def test_vectors(spark, f, given_text, want):
    assert one(spark, f(lit(given_text))) == want


def test_choices(spark):
    options, labels = F.array(*map(lit, ("red", "green pear"))), F.array(lit("A"), lit("B"))
    ask = lambda f, t: one(spark, f(lit(t), options, labels))
    assert ask(A.choice_relaxed, "I pick (B)") == "B"
    assert ask(A.choice_relaxed, "nothing of that") == "A"  # no letter, no similarity: the first
    assert ask(A.choice_relaxed, "the pear is green") == "B"
    assert ask(A.choice_strict, "I pick (B)") is None
    assert ask(A.choice_strict, "\\boxed{green pear}") == "B"


def test_scores(spark):
    assert one(spark, A.score_number(lit("3.0005"), lit("3"))) == 1
    assert one(spark, A.score_number(lit("1000"), lit("1,000"))) == 0
    assert one(spark, A.score_number(lit(None).cast("string"), lit("3"))) == 0
    assert one(spark, A.score_equal(lit("Yes"), lit("yes"))) == 1
    assert math.isclose(one(spark, A.similarity(lit("a b"), lit("a c d"))), 1 / 3)
    assert one(spark, A.similarity(lit("a b"), lit("a b"))) == 2.0


def test_metrics(spark):
    assert one(spark, metrics.exact_match(lit("Answer"), lit("answer"))) == 1.0
    assert math.isclose(one(spark, metrics.token_f1(lit("a b c"), lit("a c"))), 0.8)
    assert one(spark, metrics.token_f1(lit(" "), lit(""))) == 1.0
    assert one(spark, metrics.token_f1(lit(" "), lit("a"))) == 0.0
    assert metrics.lcs_length(list("abcbdab"), list("bdcaba")) == 4


def test_rouge(spark):
    rows = spark.createDataFrame([("the cats sat", "the cat sat"), ("", " "), ("a", "")], "r string, p string")
    assert [round(x[0], 6) for x in rows.select(metrics.rouge_l_f1("r", "p")).collect()] == [1.0, 1.0, 0.0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_f1_is_symmetric(spark, a, b):
    x, y = lit(" ".join(a)), lit(" ".join(b))
    p, q = spark.range(1).select(metrics.token_f1(x, y).alias("p"), metrics.token_f1(y, x).alias("q")).first()
    assert math.isclose(p, q) and 0 <= p <= 1


def test_durations(spark):
    for s, want in ((3661.0, "1:01:01"), (59.0, "00:59"), (-1.0, "--:--"), (math.inf, "--:--")):
        assert one(spark, text.format_duration(lit(s))) == want


def test_preview(spark):
    assert one(spark, text.preview(lit("a  b\nc"))) == "a b c"
    assert len(one(spark, text.preview(lit("x" * 300)))) == 240


def test_sampling_params(spark):
    assert tuple(one(spark, models.sampling_params(lit(True)))) == (0.6, 0.95, 20, 0.0)
    assert tuple(one(spark, models.sampling_params(lit(False)))) == (0.7, 0.8, 20, 0.0)


def test_code_is_off_unless_enabled():
    code = "def solution():\n    return 6 * 7"
    assert models.run_solution(code) is None
    assert models.run_solution(code, enabled=True) == "42"
    assert models.run_solution("def solution():\n    while True: pass", enabled=True, seconds=1) is None
    assert models.run_solution("def solution():\n    1 / 0", enabled=True) is None


def test_generate(spark):
    rows = spark.createDataFrame([("abc",), (None,)], "p string")
    assert [r["raw_prediction"] for r in models.generate(rows, "p", models.stub_model).collect()] == ["The answer is \\boxed{3}.", "The answer is \\boxed{0}."]


@pytest.mark.parametrize(
    ("word", "want"),
    [w.split(":") for w in (
        "caresses:caress ponies:poni ties:tie dies:die flies:fli cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat "
        "troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi enjoy:enjoy sky:sky skies:sky dying:die died:die "
        "spied:spi relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit radicalli:radic vietnamization:vietnam operator:oper feudalism:feudal "
        "decisiveness:decis hopefulness:hope formaliti:formal sensitiviti:sensit triplicate:triplic formative:form formalize:formal electrical:electr hopeful:hope goodness:good "
        "revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adoption:adopt communism:commun "
        "activate:activ homologous:homolog effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil proceed:proceed news:news "
        "by:by say:say analogi:analog"
    ).split()],
)
def test_stem(word, want):
    assert stemming.stem(word) == want


def test_metric_bundle(spark):
    """Against plain versions on short texts of few words."""
    import random

    r = random.Random(3)
    vocab = ["Running", "runs", "ran", "the", "the,", "cat", "cats", "happily", "", "9"]
    pairs = [(" ".join(r.choices(vocab, k=r.randint(0, 9))), " ".join(r.choices(vocab, k=r.randint(0, 9)))) for _ in range(120)]

    def rouge(a, b):
        if not a.strip() or not b.strip():
            return float(not a.strip() and not b.strip())
        x, y = metrics.rouge_tokens(a), metrics.rouge_tokens(b)
        best = max((n for n in range(min(len(x), len(y)), -1, -1) if {*combinations(x, n)} & {*combinations(y, n)}), default=0)
        return 2 * best / (len(x) + len(y)) if best else 0.0

    def f1(a, b):
        x, y = a.lower().split(), b.lower().split()
        same = sum(min(x.count(w), y.count(w)) for w in set(x))
        return 1.0 if not x and not y else 2 * same / (len(x) + len(y)) if x and y else 0.0

    df = spark.createDataFrame(pairs, "ref string, pred string")
    found = df.select("ref", "pred", *(c.alias(n) for n, c in metrics.metric_bundle(F.col("ref"), F.col("pred")).items())).collect()
    for x in found:
        a, b = x["ref"], x["pred"]
        assert x["exact_match"] == float(a.lower().split() == b.lower().split())
        assert abs(x["token_f1"] - f1(a, b)) < 1e-9 and abs(x["rouge_l_f1"] - rouge(a, b)) < 1e-9
