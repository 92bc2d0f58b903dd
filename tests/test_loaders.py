"""Staged sources, artifacts, loss metrics and maskers."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmith.operators import masking, reports
from corpusmith.sources import artifacts, loaders

ROWS = {
    "open_platypus": [({"instruction": "do", "input": " x ", "output": " y "}, ("do\n\nInput:\nx", "y")), ({"instruction": None, "input": "", "output": "z"}, ("None", "z"))],
    "long_magpie": [({"query": "q", "context": "c", "answer": "a"}, ("q\n\nContext:\nc", "a"))],
    "no_robots": [({"messages": [{"role": "user", "content": " hi "}, {"role": "assistant", "content": "ho"}]}, ("hi", "ho")), ({"messages": []}, ("", ""))],
    "nq_short": [({"question": "", "questions": "who", "paragraph": "p", "answers": ["", " he "]}, ("Question:\nwho\n\nContext:\np", "he"))],
    "harp": [({"problem": "1+1", "answer": " 2", "multiple_choice_only": False}, ("Problem:\n1+1", "2")), ({"problem": "x", "answer": "y", "multiple_choice_only": True}, None)],
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_load(spark, tmp_path, name):
    (tmp_path / name).mkdir()
    (tmp_path / name / "train.jsonl").write_text("".join(json.dumps(r) + "\n" for r, _ in ROWS[name]))
    split = "test" if name == "harp" else "train"
    got = [(r["prompt"], r["answer"], r["source"]) for r in loaders.load(spark, f"file://{tmp_path}", name, split).collect()]
    assert sorted(got) == sorted((*want, name) for _, want in ROWS[name] if want)
    with pytest.raises(FileNotFoundError):
        loaders.scan(spark, f"file://{tmp_path}/none", name)


def test_from_rows(spark):
    df = loaders.from_rows(spark, [{"a": 1, "x": 2}, {"b": "t"}], "a int, b string")
    assert [tuple(r) for r in df.collect()] == [(1, None), (None, "t")]


def test_stage_and_checkpoints(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(k, f"s{k % 2}") for k in range(20)], "id int, source string")
    artifacts.persist_stage(df, f"{base}/stage", "source", "id")
    assert artifacts.read_json(spark, f"{base}/stage/blend_metadata.json") == {"counts": {"s0": 10, "s1": 10}, "total_samples": 20}
    assert spark.read.json(f"{base}/stage/sampled_rows.jsonl").groupBy("source").count().collect()[0]["count"] == 3
    for n in ("checkpoint-5", "checkpoint-40", "checkpoint-last", "other"):
        (tmp_path / "run" / n).mkdir(parents=True)
        (tmp_path / "run" / n / "trainer_state.json").write_text(json.dumps({"best_model_checkpoint": "old", "n": n}))
    assert artifacts.export_checkpoint(spark, f"{base}/run", f"{base}/final").endswith("/checkpoint-40")
    assert artifacts.read_json(spark, f"{base}/final/trainer_state.json") == {"best_model_checkpoint": f"{base}/final", "n": "checkpoint-40"}
    assert artifacts.export_checkpoint(spark, f"{base}/run", f"{base}/final", best="checkpoint-5").endswith("/checkpoint-5")
    with pytest.raises(RuntimeError):
        artifacts.export_checkpoint(spark, f"{base}/nowhere", f"{base}/final")


def test_loss_metrics(spark):
    df = spark.createDataFrame([(1, 0.5, [2.0], [1.0, 2.0], "text", 9)], "step int, answer_loss double, mh_align_loss array<double>, rationale_loss array<double>, gate_l1_loss string, other int")
    got = reports.loss_metrics(df, "step").first().asDict()
    assert got == {"step": 1, "loss_ans": 0.5, "loss_align": 2.0, "loss_rat": None, "gate_l1_loss": None}


def test_maskers(spark):
    df = spark.createDataFrame([(1, "a Bob 9", 1.0, "x"), (2, "a Bob 9", 0.0, "y")], "id int, text string, p double, item string")
    rows = df.withColumn("m", masking.mask_tokens(F.col("text"), F.col("id"), F.col("p"))).orderBy("id").collect()
    assert [r["m"] for r in rows] == ["a [MASK] [MASK]", "a Bob 9"]
    one = masking.apply_masker(df, lambda t: F.upper(t), "text", "item").first()
    two = masking.apply_masker(df, lambda t, item: F.concat(t, item), "text", "item").orderBy("id").first()
    assert one["masked"] == "A BOB 9" and two["masked"] == "a Bob 9x"
