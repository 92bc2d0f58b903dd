import pytest
from pyspark.sql import functions as F

from corpusmith.functions import tokenizers as tk
from corpusmith.operators import collation
from corpusmith.plans.base import table

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
BYTES = tk.Tokenizer(P.path("byte_bpe_50k.json"))


def pairs(spark):
    t = F.col("text")
    rows = table(spark, SF, "documents").where("doc_id < 40").select("doc_id", F.substring_index(t, "\n", 1).alias("p"), F.substring(t, 60, 400).alias("a"))
    return rows.union(spark.createDataFrame([(1000, None, None), (1001, "é \U0001f600", "x")], "doc_id long, p string, a string"))


def test_collated(spark):
    limit, pad = 90, 50256
    found = collation.collated(pairs(spark), "doc_id", "p", "a", BYTES, 8, limit, pad).collect()
    encode, batches = tk.encoder(BYTES), {}
    for k, r in enumerate(sorted(found, key=lambda r: r["doc_id"])):
        p, a = (r["p"] or "").strip(), (r["a"] or "").strip()
        asked = f"<|im_start|>user\n{p}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
        (head,), (full,) = encode([asked]), encode([f"{asked}{a}<|im_end|>\n"])
        n = min(limit, len(full))
        assert r["batch"] == k // 8 and r["ids"][:n] == full[:n] and set(r["ids"][n:]) <= {pad}
        assert r["labels"] == [-100 if i < len(head) or i >= n else full[i] for i in range(len(r["ids"]))]
        assert r["attention"] == [int(i < n) for i in range(len(r["ids"]))]
        batches.setdefault(r["batch"], []).append((n, len(r["ids"])))
    assert all({size for _, size in b} == {max(n for n, _ in b)} for b in batches.values()) and len(found) == 42


def test_rationale_tokens(spark):
    span = "array<struct<start:int,end:int>>"
    rows = [(1, "unbelievable heat in town", [(2, 9), (13, 17), (17, 18), (400, 500)], [1.0, 3.0, 0.0, 9.0]), (2, "x y", [(0, 1), (2, 3)], [-1.0]), (3, None, [(0, 1)], [1.0]), (4, "no spans", None, None)]
    df = spark.createDataFrame(rows, f"k long, t string, s {span}, r array<double>")
    found = collation.rationale_tokens(df, "k", "t", "s", "r", BYTES).collect()
    offsets = {r["k"]: [(o["start"], o["end"]) for o in r["offsets"]] for r in tk.token_offsets(df, "t", BYTES).collect()}
    want = {}
    for k, t, spans, scores in rows:
        hits = []
        for i, (a, b) in enumerate(spans or []):
            over = [j for j, (x, y) in enumerate(offsets[k]) if x < b and y > a and y > x]
            if over and i < len(scores):
                hits.append((i, over[0], over[-1] + 1, max(scores[i], 0.0)))
        total = sum(h[3] for h in hits)
        want |= {(k, i): (a, b, s / total if total else 1 / len(hits)) for i, a, b, s in hits}
    assert {(r["k"], r["span"]): (r["first_tok"], r["end_tok"], pytest.approx(r["relevance"])) for r in found} == want
    assert collation.rationale_tokens(df, "k", "t", "s", "r", BYTES, limit=0).count() == 0
