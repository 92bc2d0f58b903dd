import json
import struct

import pytest
from helpers_core import one
from pyspark.sql import functions as F

from corpusmith.sources import weights


def put(path, tensors, **more):
    at, entries = 0, dict(more)
    for name, (dtype, shape, size) in tensors.items():
        entries[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + size]}
        at += size
    raw = json.dumps(entries).encode()
    path.write_bytes(struct.pack("<Q", len(raw)) + raw + b"\0" * at)


def test_headers(spark, tmp_path):
    for k in range(3):
        put(tmp_path / f"model-{k}.safetensors", {f"module.model.layers.{k}.q.weight": ("F32", [8, 4], 128), f"module.model.layers.{k}.b": ("BF16", [], 2)}, __metadata__={"format": "pt"})
    (tmp_path / "notes.txt").write_text("x")
    found = weights.weight_headers(spark, str(tmp_path))
    rows = {r["name"]: (r["dtype"], r["shape"], r["bytes"]) for r in found.collect()}
    assert len(rows) == 6 and rows["module.model.layers.2.q.weight"] == ("F32", [8, 4], 128) and rows["module.model.layers.0.b"] == ("BF16", [], 2)
    assert found.rdd.getNumPartitions() == 3
    named = found.withColumn("name", weights.without_prefix(F.col("name"), "module.", "model."))
    assert weights.layers(named, r"^layers\.(\d+)\.") == 3 and weights.shape_of(named, r"\.q\.weight$", 0) == 8 and weights.shape_of(named, "nothing", 0) is None
    assert weights.layers(named, r"^blocks\.(\d+)") == 0
    with pytest.raises(ValueError):
        weights.shape_of(named, "layers", 0)
    assert one(spark, weights.without_prefix(F.lit("module.module.x"), "module.")) == "x"


def test_bad_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        weights.weight_headers(spark, str(tmp_path))
    for raw in (b"", b"abc", struct.pack("<Q", 1 << 40) + b"{}", struct.pack("<Q", 50) + b"{}"):
        (tmp_path / "a.safetensors").write_bytes(raw)
        with pytest.raises(ValueError):
            weights.header(str(tmp_path / "a.safetensors"))
