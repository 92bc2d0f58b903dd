import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmith.functions import tokenizers as tk
from corpusmith.operators import attention, masking, targets


def plain(query, key, value, pos_q, pos_k, memory, heads, kv_heads, causal):
    out, share = [], []
    for h in range(heads):
        w, g = query.shape[1] // heads, h // (heads // kv_heads)
        z = query[:, h * w : h * w + w] @ key[:, g * w : g * w + w].T / np.sqrt(w)
        if causal:
            z = np.where(pos_k[None] > pos_q[:, None], -np.inf, z)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p, wv = e / e.sum(axis=1, keepdims=True), value.shape[1] // kv_heads
        out.append(p @ value[:, g * wv : g * wv + wv])
        share.append(p[:, memory].sum(axis=1))
    return np.stack(out, 1), np.stack(share, 1)


@pytest.mark.parametrize(("heads", "kv_heads", "causal", "tile"), [(1, 1, False, 1024), (4, 2, True, 7), (6, 3, False, 1)])
def test_attention(spark, monkeypatch, heads, kv_heads, causal, tile):
    monkeypatch.setattr(attention, "FAN", 3)
    monkeypatch.setattr(attention, "QUERIES", 5)
    r = np.random.default_rng(heads)
    n, m, w = 12, 40, 5
    q, k, v = 9 * r.normal(size=(n, heads * w)), 9 * r.normal(size=(m, kv_heads * w)), r.normal(size=(m, kv_heads * 3))
    pos_q, pos_k, memory = np.arange(n) * 3 + 1, np.arange(m), r.random(m) < 0.3
    queries = spark.createDataFrame([("g", i, int(pos_q[i]), q[i].tolist()) for i in range(n)] + [("nobody", 99, 0, [0.0] * heads * w)], "grp string, id int, pos long, vec array<double>")
    keys = spark.createDataFrame([("g", i, int(pos_k[i]), k[i].tolist(), v[i].tolist(), bool(memory[i])) for i in range(m)], "grp string, id int, pos long, vec array<double>, value array<double>, memory boolean")
    found = {x["id"]: x for x in attention.attention(queries, keys, heads, kv_heads, causal, tile).collect()}
    out, share = plain(q, k, v, pos_q, pos_k, memory, heads, kv_heads, causal)
    assert sorted(found) == list(range(n))
    for i in range(n):
        assert np.allclose(np.array(found[i]["out"]), out[i]) and np.allclose(found[i]["memory_share"], share[i])
    with pytest.raises(ValueError):
        attention.attention(queries, keys, 3, 2)
    assert attention.attention(queries, keys.limit(0)).count() == 0


def test_queries_before_all_keys_have_no_row(spark):
    queries = spark.createDataFrame([(1, 1, 0, [1.0]), (1, 2, 5, [1.0])], "grp int, id int, pos long, vec array<double>")
    keys = spark.createDataFrame([(1, 7, 3, [1.0], [2.0], None)], "grp int, id int, pos long, vec array<double>, value array<double>, memory boolean")
    assert [(r["id"], r["out"], r["memory_share"]) for r in attention.attention(queries, keys, causal=True).collect()] == [(2, [[2.0]], [0.0])]


def test_keys_go_to_few_blocks(spark, monkeypatch):
    """A group of some thousand rows is one block and one tile, whose logits are held in parts."""
    monkeypatch.setattr(attention, "KEYS_AT_ONCE", 300)
    monkeypatch.setattr(attention, "QUERIES_AT_ONCE", 100)
    r = np.random.default_rng(2)
    n, w = 1500, 4
    q, v = r.normal(size=(n, w)).astype(np.float32), r.normal(size=(n, w)).astype(np.float32)
    rows = spark.createDataFrame([(1, i, i, q[i].tolist(), v[i].tolist(), i % 3 == 0) for i in range(n)], "grp int, id int, pos long, vec array<float>, value array<float>, memory boolean")
    found = attention.attention(rows.select("grp", "id", "pos", "vec"), rows, 2, 2, True)
    got = {x["id"]: x for x in found.collect()}
    out, share = plain(q.astype(float), q.astype(float), v.astype(float), np.arange(n), np.arange(n), np.arange(n) % 3 == 0, 2, 2, True)
    assert sorted(got) == list(range(n))
    assert all(np.allclose(np.array(got[i]["out"]), out[i]) and np.allclose(got[i]["memory_share"], share[i]) for i in range(n))
    assert attention.QUERIES >= 4096 and attention.TILE >= 4096  # a key is shuffled once a block of queries, a query once a tile


def test_no_rows_of_pairs(spark):
    """What is shuffled are queries, keys and states."""
    e = spark.range(2000).select((F.col("id") % 1).alias("grp"), "id", F.col("id").alias("pos"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    found = attention.attention(e, e.withColumns({"value": F.col("vec"), "memory": F.lit(True)}))
    assert [round(r[0], 9) for r in found.select(F.get("memory_share", 0)).collect()] == [1.0] * 2000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_occurrences_both_ways(monkeypatch):
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choices("aab é", k=r.randrange(40)))
        wanted = tuple("".join(r.choices("aabé ", k=r.randrange(1, 4))) for _ in range(r.randrange(1, 7)))
        monkeypatch.setattr(targets, "FEW", 99)
        one = targets.occurrences(text, wanted)
        monkeypatch.setattr(targets, "FEW", 0)
        assert targets.occurrences(text, wanted) == one
        tokens = [m.span() for m in targets.WORD.finditer(text)]
        assert targets.token_targets(tokens, one) == [max((k for a, b, k in one if s < b and e > a), default=-1) for s, e in tokens]


def test_masked():
    tokens = [m.span() for m in targets.WORD.finditer("Paris is  in France, not Paris")]
    text = "Paris is  in France, not Paris"
    assert targets.masked(text, tokens, ("Paris", "France"), 0, 1.0, 1.0, 0.0, 42) == "[MASK] is  in [MASK] not [MASK]"
    assert targets.masked(text, tokens, ("Paris is  in",), 0, 0.0, 1.0, 0.0, 42) == "[MASK] France, not Paris"
    assert targets.masked(text, tokens, ("Paris", "France"), 0, 0.0, 0.0, 1.0, 42) == "Paris [MASK]  [MASK] France, [MASK] Paris"
    assert targets.masked(text, tokens, ("nowhere",), 0, 1.0, 1.0, 0.0, 42) == text
    assert [targets.probability(k, 3, 0.2, 0.8) for k in range(3)] == [0.2, 0.5, 0.8] and targets.probability(0, 1, 0.2, 0.8) == 0.8


def test_mask_targets(spark):
    rows = [(1, "A b c", ["b"]), (2, "A b c", None), (3, "A b c", ["", " ", None]), (4, None, ["b"]), (5, "", ["b"]), (6, "A b c", [" b c "]), (7, " \n", ["b"])]
    df = spark.createDataFrame(rows, "k long, t string, goals array<string>")
    found = {r["k"]: r["masked"] for r in targets.mask_targets(df, "t", "goals", "k", 1.0, 1.0, 0.0, prob=1.0).collect()}
    assert found == {1: "A [MASK] c", 2: "[MASK] b c", 3: "[MASK] b c", 4: None, 5: "", 6: "A [MASK]", 7: ""}
    one = df.where("k = 1").select(masking.draw(42, F.col("k"), F.lit(7)).alias("x")).first()["x"]
    assert one == targets.draw(42, 1, 7)


def test_mask_targets_by_offsets_of_a_tokenizer(spark):
    vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "unbelievable heat", ["liev"])], "k long, t string, goals array<string>")
    rows = tk.token_offsets(df, "t", tk.Tokenizer(vocabulary))
    got = targets.mask_targets(rows, "t", "goals", "k", 1.0, 1.0, 0.0, offsets="offsets").first()
    spans = [(s["start"], s["end"]) for s in got["offsets"]]
    hit = [s for s in spans if s[0] < 7 and s[1] > 3]
    assert got["masked"] == "unbelievable heat"[: hit[0][0]] + "[MASK]" + "unbelievable heat"[hit[-1][1] :]
