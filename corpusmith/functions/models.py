"""Model interface: text generation in Arrow batches, with a deterministic stub; guarded code execution."""

from __future__ import annotations

import subprocess
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Generate = Callable[[list[str]], list[str]]

#: Sampling parameters with reasoning on and off.
SAMPLING = {True: (0.6, 0.95, 20, 0.0), False: (0.7, 0.8, 20, 0.0)}


def generate(df: DataFrame, prompt: str, load: Callable[[], Generate], out: str = "raw_prediction") -> DataFrame:
    """df with a column of generated text. load runs once a task and returns the model's function."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield b.assign(**{out: model(b[prompt].fillna("").tolist())})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def stub_model() -> Generate:
    """Answers with the length of the prompt, boxed."""
    return lambda prompts: [f"The answer is \\boxed{{{len(p)}}}." for p in prompts]


def sampling_params(enable_thinking):
    """Struct of temperature, top_p, top_k, min_p."""
    pick = lambda k: F.when(enable_thinking, F.lit(SAMPLING[True][k])).otherwise(F.lit(SAMPLING[False][k]))
    return F.struct(pick(0).alias("temperature"), pick(1).alias("top_p"), pick(2).alias("top_k"), pick(3).alias("min_p"))


def run_solution(code: str | None, enabled: bool = False, seconds: int = 3, memory_mb: int = 512) -> str | None:
    """Result of solution() of generated code, in a limited process of its own; off unless enabled. Any failure is null."""
    if not enabled or not code:
        return None
    limits = f"import resource as r; r.setrlimit(r.RLIMIT_AS, ({memory_mb << 20},) * 2); r.setrlimit(r.RLIMIT_CPU, ({seconds},) * 2); r.setrlimit(r.RLIMIT_NOFILE, (16, 16))\n"
    try:
        done = subprocess.run([sys.executable, "-I", "-c", f"{limits}{code}\nprint(solution())"], capture_output=True, text=True, timeout=seconds, env={})
    except (subprocess.TimeoutExpired, OSError, ValueError):
        return None
    return done.stdout.strip().splitlines()[-1] if done.returncode == 0 and done.stdout.strip() else None
