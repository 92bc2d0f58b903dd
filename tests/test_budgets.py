import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from corpusmith.functions import tokenizers as tk
from corpusmith.plans.base import table
from corpusmith.sources.verdicts import StaleCache, VerdictCache

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
BYTES, WORDS = tk.Tokenizer(P.path("byte_bpe_50k.json")), tk.Tokenizer(P.path("word_bpe_49k.json"))


def documents(spark):
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|> x"), (-4, " \n"), (-5, "é" * 3000)], "doc_id long, text string")
    return table(spark, SF, "documents").select("doc_id", "text").union(more)


def test_lengths_are_the_libraries(spark):
    kinds = {"a": ("text", BYTES), "b": ("text", WORDS), "c": ("text", tk.Tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)), "d": ("text", tk.Tokenizer(P.path("piece_bpe_32k.model")))}
    rows = tk.token_lengths(documents(spark), kinds).collect()
    encode = {k: tk.encoder(t) for k, (_, t) in kinds.items()}
    for r in rows:
        assert all(r[k] == len(encode[k]([r["text"] or ""])[0]) for k in kinds)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert all(r["a"] == len(plain.encode(r["text"], add_special_tokens=False).ids) == r["c"] for r in rows if r["doc_id"] >= 0)


def test_batches_are_cut(monkeypatch):
    """Whatever Spark's batches hold, about BATCH_BYTES of text are encoded and held at a time."""
    import pyarrow as pa

    monkeypatch.setattr(tk, "BATCH_BYTES", 100)
    texts = ["x" * n for n in (40, 70, 0, 300, 1, 99, 1)] + [None]
    batch = pa.record_batch({"k": list(range(8)), "t": texts})
    parts = list(tk._cut(batch, ["t"]))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(8)) and len(parts) == 5
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 100 for p in parts)
    assert list(tk._cut(batch.slice(0, 0), ["t"])) == []


def test_offsets(spark):
    for r in tk.token_offsets(documents(spark), "text", BYTES).collect():
        text = r["text"] or ""
        assert len(r["ids"]) == len(r["offsets"]) and (not text or {"", text} >= {"".join(text[s["start"] : s["end"]] for s in r["offsets"])} or not text.isascii())
    with pytest.raises(ValueError):
        tk.token_offsets(documents(spark), "text", tk.Tokenizer("x.model"))
    with pytest.raises(ValueError):
        tk.encoder(tk.Tokenizer("x.bin"))


def samples(spark):
    rows = [(1, "a b c", "d"), (2, " ", ""), (3, None, None), (4, "word " * 50, "x"), (5, "a", "word " * 50), (6, "", "only an answer"), (7, "a b c", "d")]
    return spark.createDataFrame(rows, "k long, prompt string, answer string")


def test_within_budget(spark):
    found = {r["k"]: r for r in tk.within_budget(samples(spark), "prompt", "answer", WORDS, BYTES, 20, 60).collect()}
    assert {k: r["within"] for k, r in found.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True}
    full = "<|im_start|>user\na b c<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nd<|im_end|>\n"
    assert found[1]["composer_tokens"] == len(tk.encoder(BYTES)([full])[0]) and found[1]["profiler_tokens"] == 3


DESCRIPTION = {"columns": ["prompt", "answer"], "most": [20, 60]}


def judged(spark, root, df, seen=None):
    cache = VerdictCache(spark, root, DESCRIPTION, "within boolean, composer_tokens bigint")

    def decide(rows):
        if seen is not None:
            seen.append(rows.count())
        return tk.within_budget(rows, "prompt", "answer", WORDS, BYTES, 20, 60)

    return cache, {r["k"]: r["verdict"]["within"] for r in cache.judged(df, ["prompt", "answer"], decide).collect()}


def test_only_new_rows_are_decided(spark, tmp_path):
    seen, root = [], str(tmp_path)
    want = {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True}
    assert judged(spark, root, samples(spark).where("k < 4"), seen)[1] == {k: want[k] for k in (1, 2, 3)}
    cache, found = judged(spark, root, samples(spark), seen)
    assert found == want and seen == [3, 3]  # rows 1 and 7 hold the same
    assert judged(spark, root, samples(spark), seen)[1] == want and seen[-1] == 0
    assert len(cache.generations()) == 2 and cache.verdicts().count() == 6
    assert judged(spark, root, samples(spark).limit(0))[1] == {}


def test_a_stale_description_is_refused(spark, tmp_path):
    cache, _ = judged(spark, str(tmp_path), samples(spark))
    other = VerdictCache(spark, str(tmp_path), DESCRIPTION | {"most": [1, 1]}, cache.schema)
    assert other.path != cache.path and other.generations() == []
    for text in (json.dumps(DESCRIPTION | {"most": [1, 1]}), "{"):
        crc = f"{cache.path}/.description.json.crc"
        if os.path.exists(crc):
            os.remove(crc)
        with open(f"{cache.path}/description.json", "w") as f:
            f.write(text)
        with pytest.raises(StaleCache):
            judged(spark, str(tmp_path), samples(spark))


def test_two_writers_leave_one_result(spark, tmp_path):
    """Both have read an empty cache before either commits."""
    cache = VerdictCache(spark, str(tmp_path), DESCRIPTION, "within boolean")
    cache.check()
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("row_hash"), F.struct((F.col("id") % 2 == 0).alias("within")).alias("verdict"))
    both, real = threading.Barrier(2), VerdictCache._renamed

    def together(self, aside, path):
        if path.endswith("generation-000000"):
            both.wait(60)
        return real(self, aside, path)

    VerdictCache._renamed = together
    try:
        added, work = [], [threading.Thread(target=lambda r=r: added.append(cache.add(rows(*r)))) for r in ((0, 100), (50, 150))]
        for w in work:
            w.start()
        for w in work:
            w.join(120)
    finally:
        VerdictCache._renamed = real
    assert sum(added) == 150 and len(cache.generations()) == 2
    found = cache.verdicts()
    assert found.count() == 150 == found.select("row_hash").distinct().count()
    assert not [n for n in os.listdir(cache.path) if n.startswith(".aside")]
