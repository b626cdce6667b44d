"""Derived facts kept as tables: read if the inputs are unchanged and the tables whole, otherwise made again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(df: DataFrame) -> str:
    """Order-free digest of a relation: row count and the sum of row hashes; one row reaches the driver."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    n, s = df.agg(F.count("*"), F.sum(h)).first()
    return f"{n}:{s}"


class Predicates:
    """``facts`` by name, each a function that makes a relation from nothing but the inputs."""

    def __init__(self, spark: SparkSession, path: str, inputs: dict[str, DataFrame], facts: dict[str, Callable[[], DataFrame]]):
        self.spark, self.path, self.inputs, self.facts = spark, path.rstrip("/"), inputs, facts
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.made = 0

    def _manifest(self) -> dict | None:
        if not self.fs.exists(self.Path(f"{self.path}/manifest/_SUCCESS")):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifest").first()[0])

    def load(self) -> dict[str, DataFrame]:
        """The facts; made and stored if the fingerprint of the inputs or the seal of a table differs."""
        want = {k: digest(v) for k, v in sorted(self.inputs.items())}
        have = self._manifest()
        if have and have["inputs"] == want and set(have["tables"]) == set(self.facts):
            got = {k: self.spark.read.parquet(t["at"]) for k, t in have["tables"].items()}
            if all(digest(df) == have["tables"][k]["seal"] for k, df in got.items()):
                return got
        run = uuid.uuid4().hex[:8]
        tables = {}
        for k, f in self.facts.items():
            at = f"{self.path}/{run}/{k}"
            f().write.parquet(at)
            tables[k] = {"at": at, "seal": digest(self.spark.read.parquet(at))}
        self.made += 1
        text = json.dumps({"inputs": want, "tables": tables}, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")
        return {k: self.spark.read.parquet(t["at"]) for k, t in tables.items()}


def guard_store(walked: int, stored: int) -> None:
    """Refuse an export from a store that is empty or holds less than half of what the walk finds."""
    if walked == 0:
        raise ValueError("the walk finds no file")
    if stored == 0:
        raise ValueError("the store is empty")
    if stored * 2 < walked:
        raise ValueError(f"the store holds {stored} of {walked} files")
