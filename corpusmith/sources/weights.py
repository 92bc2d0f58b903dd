"""Weight files by their headers: a data source that reads names, types and shapes, never the numbers.

The format is the public one of eight bytes with the header's length, a JSON header and the data.
One partition a file, so a folder of many is read by many tasks; of each file the header alone.
"""

from __future__ import annotations

import json
import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, name string, dtype string, shape array<bigint>, bytes bigint"
MOST = 100 << 20  # bytes of a header


def header(path: str) -> list[tuple]:
    """(name, dtype, shape, bytes) of each tensor."""
    with open(path, "rb") as f:
        first = f.read(8)
        size = struct.unpack("<Q", first)[0] if len(first) == 8 else MOST + 1
        if size > MOST:
            raise ValueError(f"{path} has no header")
        raw = f.read(size)
    if len(raw) < size:
        raise ValueError(f"{path} is cut off in its header")
    entries = json.loads(raw)
    return [(k, v["dtype"], v["shape"], v["data_offsets"][1] - v["data_offsets"][0]) for k, v in entries.items() if k != "__metadata__"]


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        for name, dtype, shape, size in header(partition.path):
            yield partition.path, name, dtype, shape, size


class WeightHeaders(DataSource):
    """Option paths: a JSON list of files that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "weight_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(json.loads(self.options["paths"]))


def weight_headers(spark: SparkSession, folder: str, suffix: str = ".safetensors") -> DataFrame:
    """file, name, dtype, shape and bytes of each tensor of the weight files below a shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    paths = sorted(re.sub("^file:", "", s.getPath().toString()) for s in found if s.getPath().getName().endswith(suffix))
    if not paths:
        raise FileNotFoundError(f"no {suffix} file in {folder}")
    spark.dataSource.register(WeightHeaders)
    return spark.read.format("weight_headers").option("paths", json.dumps(paths)).load()


def without_prefix(name: Column, *prefixes: str) -> Column:
    """A tensor's name without the wrappers that training puts before it, however many."""
    return F.regexp_replace(name, "^(?:" + "|".join(re.escape(p) for p in prefixes) + ")+", "") if prefixes else name


def shape_of(headers: DataFrame, pattern: str, axis: int) -> int | None:
    """The size of an axis of the tensors whose names match; None where there are none, an error where they differ."""
    sizes = headers.where(F.col("name").rlike(pattern)).select(F.get("shape", axis).alias("n")).distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError(f"tensors of {pattern} differ in axis {axis}")
    return sizes[0]["n"] if sizes else None


def layers(headers: DataFrame, pattern: str) -> int:
    """How many layers there are: one more than the greatest number that the pattern's group finds."""
    number = F.regexp_extract("name", pattern, 1).try_cast("int")
    last = headers.where(F.col("name").rlike(pattern)).agg(F.max(number)).first()[0]
    return 0 if last is None else last + 1
