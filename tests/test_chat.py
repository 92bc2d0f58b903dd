import pytest
from helpers_core import one
from pyspark.sql import functions as F

from corpusmith.operators import chat
from corpusmith.plans.base import table

ROW = "k long, m array<struct<role:string,content:string>>"


def rendered(spark, messages, *args, **kw):
    return spark.createDataFrame([(0, messages)], ROW).select(chat.render_chat(F.col("m"), *args, **kw).alias("x")).first()["x"]


def test_user_prompt(spark):
    asked = "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    assert one(spark, chat.user_prompt(F.lit("hi"), thinking=True)) == asked
    assert one(spark, chat.user_prompt(F.lit("hi"))) == asked + "<think>\n\n</think>\n\n"
    assert one(spark, chat.user_prompt(F.lit("hi"), thinking=F.lit(1) == 2)) == asked + "<think>\n\n</think>\n\n"
    full = "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\na<|im_end|>\n"
    assert one(spark, chat.training_text(F.lit("p"), F.lit("a"))) == full


def test_reasoning_of_earlier_replies_goes(spark):
    said = [("system", "s"), ("user", "q"), ("assistant", "<think>\nx\n</think>\n\nold"), ("user", "again"), ("assistant", "<think>\ny\n</think>\n\nnew")]
    found = rendered(spark, said, generation_prompt=False)
    assert "x" not in found and found.endswith("<|im_start|>assistant\n<think>\ny\n</think>\n\nnew<|im_end|>\n") and "<|im_start|>assistant\nold<|im_end|>" in found


def test_odd_messages(spark):
    assert rendered(spark, None, generation_prompt=False) == "" == rendered(spark, [], generation_prompt=False)
    assert rendered(spark, [(None, None), ("tool", "{x} {{y}}")], chat.HEADERS, False) == (
        "<|begin_of_text|><|start_header_id|><|end_header_id|>\n\n<|eot_id|><|start_header_id|>tool<|end_header_id|>\n\n{x} {{y}}<|eot_id|>"
    )
    own = chat.ChatTemplate(turn="{{{role}}}: {content};", roles={"system": "[{content}]"}, request="bot:")
    assert rendered(spark, [("system", "a"), ("user", "b")], own) == "[a]{user}: b;bot:"
    with pytest.raises(ValueError):
        chat.ChatTemplate(turn="{name}")


def test_render_with_own_template(spark):
    class Fake:
        """Notes how it was asked."""

        def apply_chat_template(self, messages, tokenize, add_generation_prompt, enable_thinking):
            return f"{messages}|{tokenize}|{add_generation_prompt}|{enable_thinking}"

    df = spark.createDataFrame([(1, [("user", "a")]), (2, None)], ROW)
    found = {r["k"]: r["rendered"] for r in chat.render_with(df, "m", Fake, thinking=True).collect()}
    assert found == {1: "[{'role': 'user', 'content': 'a'}]|False|True|True", 2: "[]|False|True|True"}


def test_rendering_needs_no_python_and_one_shuffle(spark):
    rows = chat.conversations(table(spark, "/root/testdata/sf0.001", "conversations"), "conv_id", "turn", "role", "text")
    plan = rows.select(chat.render_chat(F.col("messages")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1
