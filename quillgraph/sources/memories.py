"""A key to document store: one row per memory, atomic replacement of the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that some file systems reserve, and that of the folder's own notes.
RESERVED = "README|CON|PRN|AUX|NUL|(COM|LPT)[1-9]"


def valid_name(name: Column) -> Column:
    """Letters, digits, ``.``, ``_`` and ``-``, at most 128, no dot at the end, not reserved."""
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~name.endswith(".") & ~F.upper(name).rlike(f"^({RESERVED})$")


def summary(body: Column, cap: int = 120) -> Column:
    """The first comment of the form ``<!-- … -->``, else the first line with text, at most ``cap`` characters."""
    comment = F.trim(F.regexp_extract(body, r"(?s)<!--(.*?)-->", 1))
    line = F.trim(F.regexp_extract(body, r"(?m)^[#\s]*(\S.*)$", 1))
    return F.substring(F.coalesce(F.nullif(comment, F.lit("")), line), 1, cap)


class MemoryStore:
    """Memories under ``path``; every change writes a new snapshot and then moves the pointer to it."""

    SCHEMA = "name string, body string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jpath = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs, self.Path = jpath.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _current(self) -> str | None:
        if not self.fs.exists(self.Path(self.path)):
            return None
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self.Path(self.path)) if s.getPath().getName().startswith("v"))
        done = [n for n in names if self.fs.exists(self.Path(f"{self.path}/{n}/_SUCCESS"))]
        return f"{self.path}/{done[-1]}" if done else None

    def table(self) -> DataFrame:
        at = self._current()
        return self.spark.read.schema(self.SCHEMA).parquet(at) if at else self.spark.createDataFrame([], self.SCHEMA)

    def list(self) -> DataFrame:
        """(name, summary) by name."""
        return self.table().select("name", summary(F.col("body")).alias("summary")).orderBy("name")

    def get(self, name: str) -> str | None:
        row = self.table().where(F.col("name") == name).first()
        return row["body"] if row else None

    def _replace(self, df: DataFrame) -> None:
        at = self._current()
        version = int(at.rsplit("/v", 1)[1].split("-")[0]) + 1 if at else 0
        df.coalesce(1).write.parquet(f"{self.path}/v{version:08d}-{uuid.uuid4().hex[:8]}")

    def set(self, name: str, body: str) -> None:
        ok = self.spark.range(1).select(valid_name(F.lit(name)).alias("v")).first()["v"]
        if not ok:
            raise ValueError(f"not a name of a memory: {name!r}")
        new = self.spark.createDataFrame([(name, body)], self.SCHEMA)
        self._replace(self.table().where(F.col("name") != name).unionByName(new))

    def delete(self, name: str) -> bool:
        if self.get(name) is None:
            return False
        self._replace(self.table().where(F.col("name") != name))
        return True
