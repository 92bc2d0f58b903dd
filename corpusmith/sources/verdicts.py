"""Cached verdicts on rows, named by what they depend on and found by what a row holds.

A cache is a folder, named by the hash of its description (which columns, tokenizers,
budgets). It holds the description and numbered generations of verdicts, a row for each hash of
a row's content. Rows whose hash is known are joined to their verdict; only the others are
decided. A new generation is written aside and then renamed once to the next number. If
another writer has that number already, its verdicts are read, and only what they lack is put
forward again, so that any number of writers end with one verdict a hash. A writer that dies
leaves a folder aside that no reader looks at.

Nothing waits and no rank is first: who comes late finds the verdicts or makes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.sources.commits import rename_once
from corpusmith.sources.tables import cache_key

DESCRIPTION = "description.json"


class StaleCache(ValueError):
    """A folder whose description isn't the one that its name stands for."""


def row_hash(*columns: str) -> Column:
    """A hash of what a row holds in these columns; nulls and empty strings differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


class VerdictCache:
    """Verdicts under ``root``, for one description. schema: of what a verdict is (DDL)."""

    def __init__(self, spark: SparkSession, root: str, description: dict, schema: str) -> None:
        self.spark, self.description, self.schema = spark, description, schema
        self.path = f"{root.rstrip('/')}/{cache_key(description)}"
        self._fs = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._place(path))

    def _renamed(self, aside: str, path: str) -> bool:
        return rename_once(self.spark, aside, path)

    def check(self) -> None:
        """Put the description where there is none; refuse another."""
        path = f"{self.path}/{DESCRIPTION}"
        if not self._exists(path):
            aside = f"{self.path}/.aside-{uuid.uuid4().hex}"
            out = self._fs.create(self._place(aside), False)
            out.write(bytearray(json.dumps(self.description, sort_keys=True).encode()))
            out.close()
            self._renamed(aside, path)
        stream = self._fs.open(self._place(path))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            found = None
        finally:
            stream.close()
        if found != json.loads(json.dumps(self.description)):
            raise StaleCache(path)

    def generations(self) -> list[str]:
        """Folders of verdicts, in order."""
        if not self._exists(self.path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._place(self.path)) if s.isDirectory()]
        return [f"{self.path}/{n}" for n in sorted(names) if n.startswith("generation-")]

    def verdicts(self) -> DataFrame:
        """row_hash and verdict of all generations."""
        schema = f"row_hash string, verdict struct<{self.schema}>"
        found = self.generations()
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def add(self, decided: DataFrame) -> int:
        """Commit decided (row_hash, verdict), each hash once, less what others have committed; the number of verdicts added."""
        while True:
            number = len(self.generations())
            aside = f"{self.path}/.aside-{uuid.uuid4().hex}"
            decided.join(self.verdicts().select("row_hash"), "row_hash", "left_anti").write.parquet(aside)
            written = self.spark.read.schema(f"row_hash string, verdict struct<{self.schema}>").parquet(aside)
            n = written.count()
            if n == 0:
                self._fs.delete(self._place(aside), True)
                return 0
            if self._renamed(aside, f"{self.path}/generation-{number:06d}"):
                return n

    def judged(self, df: DataFrame, columns: Sequence[str], decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """df with a column ``verdict``. decide: rows with the given columns to the same with the verdict's fields; asked for unknown rows only.

        Rows that hold the same are decided once.
        """
        self.check()
        hashed = df.withColumn("row_hash", row_hash(*columns))
        known = self.verdicts().select("row_hash")
        new = hashed.select("row_hash", *columns).join(known, "row_hash", "left_anti").dropDuplicates(["row_hash"])
        fields = [f.split()[0] for f in self.schema.split(",")]
        self.add(decide(new).select("row_hash", F.struct(*fields).cast(f"struct<{self.schema}>").alias("verdict")))
        return hashed.join(self.verdicts(), "row_hash").drop("row_hash")
