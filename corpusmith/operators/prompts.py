"""Benchmark catalog and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.text import strip

# The datasets, their aliases, the acts and the prompt texts.
DATASETS = (
    # name, file, prompt family, category, answer kind, label, runs code
    ("gsm", "gsm.jsonl", "gsm", "arithmetic", "number", "GSM8K", True),
    ("svamp", "svamp.jsonl", "gsm", "arithmetic", "number", "SVAMP", True),
    ("asdiv", "asdiv.jsonl", "gsm", "arithmetic", "number", "ASDiv", True),
    ("aqua", "aqua.jsonl", "aqua", "arithmetic", "choice", "AQuA", False),
    ("multiarith", "multiarith.jsonl", "gsm", "arithmetic", "number", "MultiArith", True),
    ("mawpssingleeq", "mawpssingleeq.jsonl", "gsm", "arithmetic", "number", "SingleEQ", True),
    ("mawpsaddsub", "mawpsaddsub.jsonl", "gsm", "arithmetic", "number", "AddSub", True),
    ("commonsenseqa", "CommonsenseQA.jsonl", "commonsenseqa", "commonsense", "choice", "CommonsenseQA", False),
    ("strategyqa", "strategyqa.jsonl", "strategyqa", "commonsense", "yes_no", "StrategyQA", False),
    ("arc_easy", "arc_easy.jsonl", "commonsenseqa", "commonsense", "choice", "ARC-e", False),
    ("arc_challenge", "arc_challenge.jsonl", "commonsenseqa", "commonsense", "choice", "ARC-c", False),
    ("date_understanding", "date_understanding.jsonl", "date_understanding", "symbolic", "date", "Date Understanding", True),
    ("coin_flip", "coin_flip.jsonl", "coin_flip", "symbolic", "yes_no", "Coin Flip", True),
)
DATASET_SCHEMA = "dataset_name string, file_name string, prompt_family string, category string, answer_kind string, dataset_label string, supports_pal boolean"
ALIASES = {
    "csqa": "commonsenseqa",
    "arceasy": "arc_easy",
    "arcchallenge": "arc_challenge",
    "date": "date_understanding",
    "coin": "coin_flip",
    "singleeq": "mawpssingleeq",
    "addsub": "mawpsaddsub",
}
ACTS = ("vanilla", "cot", "ps", "pal")
METHODS = {
    "vanilla": "",
    "cot": "Let's think step by step.",
    "ps": (
        "Let's first understand the problem and devise a plan to solve the problem. "
        "Then, let's carry out the plan, solve the problem step by step, and give the ultimate answer. "
        "Please explicitly generate the mentioned process: [Problem Understanding], [Plan], "
        "[Solving/Calculations], [Answer]. in your response."
    ),
}
TEMPLATES = {
    "gsm": "\nQ: {question}\n\nYour final answer should be a single numerical number, in the form \\boxed{answer}, at the end of your response.\n",
    "aqua": "\nQ: {question}\n\nYour answer should be in the form \\boxed{choice}, e.g. \\boxed{A}, \\boxed{B}, \\boxed{C}, \\boxed{D}. There is only one correct choice.\n",
    "commonsenseqa": "\nQ: {question}\n\nYour answer should be in the form \\boxed{choice}, e.g. \\boxed{A}, \\boxed{B}, \\boxed{C}, \\boxed{D}. There is only one correct choice.\n",
    "strategyqa": "\nQ: {question}\n\nYour answer should be either \\boxed{yes} or \\boxed{no}, in the form \\boxed{answer}.\n",
    "date_understanding": "\nQ: {question}\n\nYour answer should be a date, in the format of \\boxed{MM/DD/YYYY}, e.g. \\boxed{05/01/2022}.\n",
    "coin_flip": "\nQ: {question}\n\nYour answer should be \\boxed{yes} or \\boxed{no}, in the form \\boxed{answer}.\n",
}
REREAD = " \n\nRead the question again: "
REREAD_CODE = " \n\n# Read the question again: "
ARC = ("arc_easy", "arc_challenge")
# End of fixed values.

# The code prompts.
CODE_TEMPLATES = {
    "gsm": """#!/bin/python3

import math
import numpy as np
import statistics
import sympy as sp

#################### Task Instruction ####################
# You will write python program to solve math problems.
# You will only write code blocks.
# Please generate your code block in `def solution()` function, and thus it can be executed by python interpreter. You don't need to call `solution()` function because it will be called by the system.
# The concrete format of `solution()` is as follows:
# def solution():
#   \"\"\"<question>\"\"\"
#   <your code>
#   result = <your result>
#   return result
##########################################################

# To better solve the probelm, 1) you can define variables first and then use them in your code block. 2) You can add comments to the code. 3) You can use the imported python package to solve the problem.

# Q: {question}

# Your defined "solution()" function with comments here.""",
    "coin_flip": """# You will write python program to solve the coin flip problems.
# You will only write code blocks.
# Please generate your code block in `def solution()` function, and thus it can be executed by python interpreter. You don't need to call `solution()` function because it will be called by the system.
# The concrete format of `solution()` is as follows:
# def solution():
#   \"\"\"
#   :return: "yes" or "no"
#   \"\"\"
#   <your code>
#   result = <your result>
#   assert result in ["yes", "no"]
#   return result # "yes" or "no"
#
# To better solve the probelm, 1) you can define variables first and then use them in your code block. 2) You can add comments to the code. 3) If you use the library, you must import it by `import {module}` in the first line of your code block.

#!/bin/python3

# Q: {question}
# Your "solution()" function here. Remember only to return "yes" or "no".""",
    "date_understanding": """#!/bin/python3

import datetime
import dateutil.relativedelta as relativedelta

#################### Task Instruction ####################
# You will write python program to solve the date understanding problems.
# You will only write code blocks.
# Please generate your code block in `def solution()` function, and thus it can be executed by python interpreter. You don't need to call `solution()` function because it will be called by the system.
# The concrete format of `solution()` is as follows:
# def solution():
#   <your code>
#   return result # "MM/DD/YYYY" by strftime('%m/%d/%Y').
##########################################################

# [TIPS]: To better solve the problem, 1) you can define variables first and then use them in your code block. 2) You can add comments to the code. 3) You can use relevant libraries, including `datetime.datetime`, `dateutil.relativedelta.relativedelta`, among others. 4) NOTICE! The 'today' in the [QUESTION] does not mean the date of the execution of the code, so you don't need and can NOT use the `datetime.datetime.now()` or `datetime.date.today()` to get the today date.

# [QUESTION]: "{question}"
# [RESPONSE FORMAT] You need to infer the date from context, and return the result in the format of `MM/DD/YYYY`.
# Your defined "solution()" function here. Remember you DON'T need and CAN NOT use the `datetime.datetime.now()` or `datetime.date.today()`.""",
}
# End of fixed values.


def catalog(spark: SparkSession) -> DataFrame:
    """The datasets as a table: fixed, 13 rows."""
    return spark.createDataFrame(DATASETS, DATASET_SCHEMA)


def normalize_name(c: Column) -> Column:
    base = F.lower(F.element_at(F.split(c, "/"), -1))
    name = F.replace(F.regexp_replace(base, r"\.jsonl$", ""), F.lit("-"), F.lit("_"))
    aliases = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(aliases, name), name)


def known_name(c: Column) -> Column:
    """The normalised name; an error where no dataset has it."""
    name = normalize_name(c)
    return F.when(name.isin([d[0] for d in DATASETS]), name).otherwise(F.raise_error(F.concat(F.lit("unknown dataset "), c)).cast("string"))


def supports_act(act: Column, supports_pal: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("unknown act "), act)).cast("boolean")
    return F.when(~act.isin(*ACTS), bad).otherwise((act != "pal") | supports_pal)


def choice_question(stem: Column, choices: Column) -> Column:
    listed = F.array_join(F.transform(choices, lambda c: F.concat(F.lit(" ("), c["label"], F.lit(") "), c["text"])), "")
    return F.concat(strip(stem), F.lit(" Answer Choices:"), listed)


def flat_choice_question(question: Column, options: Column) -> Column:
    """options: texts such as A)21."""
    listed = F.concat(F.lit("("), F.array_join(options, "("))
    listed = F.replace(F.replace(listed, F.lit("("), F.lit(" (")), F.lit(")"), F.lit(") "))
    return F.concat(strip(question), F.lit(" Answer Choices:"), listed)


def reread_prompt(question: Column, family: str, act: str, read_times: int) -> Column:
    if read_times < 1:
        raise ValueError("read_times is at least 1")
    if act not in ACTS:
        raise ValueError(f"unknown act {act}")
    code = act == "pal"
    if code and family not in CODE_TEMPLATES:
        raise ValueError(f"{family} has no code prompt")
    repeated = F.array_join(F.array_repeat(question, read_times), REREAD_CODE if code else REREAD)
    head, tail = (CODE_TEMPLATES if code else TEMPLATES)[family].split("{question}")
    if code:
        return F.concat(F.lit(head), repeated, F.lit(tail))
    method = METHODS[act]
    return F.concat(F.lit(head), repeated, F.lit(tail + ("\nA: " + method if method else "\nA:")))


def reference_answer(kind: Column, target: Column, correct: Column, answer_key: Column, scores: Column) -> Column:
    ones = F.map_keys(F.map_filter(scores, lambda _, v: v == 1.0))
    date = F.coalesce(F.try_element_at(ones, F.lit(1)), F.try_element_at(F.map_keys(scores), F.lit(1)))
    choice = F.coalesce(correct, answer_key)
    return F.when(kind.isin("number", "yes_no"), target).when(kind == "choice", choice).when(kind == "date", date)


def benchmark_example_id(index: Column, *ids: Column) -> Column:
    return F.coalesce(*(c.cast("string") for c in ids), index.cast("string"))
