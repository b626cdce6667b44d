"""Vector collections and shards: stamped tables in buckets, refused on another stamp, of which a write touches the changed buckets only."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: rows of a shard.
SHARD_ROWS = 250
#: Seconds that a writer waits for another one, and after which a lock counts as left behind by a writer that died.
LOCK_WAIT, LOCK_STALE = 30.0, 3600.0


class Busy(RuntimeError):
    """Another writer holds the collection."""


class Collection:
    """Parquet tables under ``path`` with a stamp (model, provider, dim, shape), cut into ``buckets`` by a hash of the ids.

    A version is one small manifest: stamp, schema and where each bucket lies. A write makes the buckets that change anew, takes the
    others over from the last version, and puts its manifest down last, by a rename; readers take the newest manifest, so a failed
    write leaves the old state. Two versions are kept; buckets that neither names are deleted. One writer at a time holds a lock.
    """

    def __init__(self, spark: SparkSession, path: str, stamp: dict[str, str], id_col: str = "id", buckets: int = 64):
        self.spark, self.path, self.stamp, self.buckets = spark, path.rstrip("/"), dict(stamp), buckets
        self.ids = [id_col] if isinstance(id_col, str) else list(id_col)
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions

    def _list(self, folder: str) -> list[str]:
        at = self.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _manifests(self) -> list[dict]:
        """The newest two manifests, oldest first."""
        names = [n for n in self._list("versions") if n.endswith(".json")]
        return [json.loads(self._read_text(f"versions/{n}")) for n in names[-2:]]

    def _read_text(self, name: str) -> str:
        stream = self.fs.open(self.Path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """Put a text down whole: written beside, then renamed."""
        beside = self.Path(f"{self.path}/{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(beside, self.Path(f"{self.path}/{name}")):
            self.fs.delete(beside, False)
            raise Busy(f"{name} is there already")

    # -- lock

    @contextmanager
    def lock(self, wait: float = LOCK_WAIT) -> Iterator[None]:
        """Hold the collection for writing; ``Busy`` after ``wait`` seconds. A lock older than ``LOCK_STALE`` is taken over."""
        at = self.Path(f"{self.path}/lock")
        until = time.monotonic() + wait
        while not self._took(at):
            try:
                age = time.time() - self.fs.getFileStatus(at).getModificationTime() / 1000
                if age > LOCK_STALE:
                    self.fs.delete(at, False)
                    continue
            except Exception:  # the other writer has just let go
                continue
            if time.monotonic() >= until:
                raise Busy(f"another writer holds {self.path}")
            time.sleep(0.1)
        try:
            yield
        finally:
            self.fs.delete(at, False)

    def _took(self, at) -> bool:
        try:
            return bool(self.fs.createNewFile(at))
        except Exception:  # some file systems raise when another writer was faster; what lasts ends as Busy
            return False

    @property
    def building(self) -> bool:
        """Whether a writer is at work; what is read meanwhile is the state before."""
        return self.fs.exists(self.Path(f"{self.path}/lock"))

    # -- reading

    def _checked(self, manifest: dict) -> dict:
        have = manifest["stamp"]
        if have == self.stamp:
            return manifest
        if set(self.stamp) - set(have) == {"provider"} and all(self.stamp[k] == v for k, v in have.items()):
            return manifest  # made before providers were noted, with the same model
        raise ValueError(f"the index was built with embed model {have}, not {self.stamp}")

    def _rows(self, manifest: dict) -> DataFrame:
        schema, paths = StructType.fromJson(manifest["schema"]), sorted(set(manifest["buckets"].values()))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def read(self) -> DataFrame | None:
        """The newest rows; None if there are none. Raises if they carry another stamp."""
        found = self._manifests()
        return self._rows(self._checked(found[-1])) if found else None

    def read_stale(self) -> tuple[DataFrame | None, bool]:
        """The rows, and whether a build that isn't done may change them."""
        return self.read(), self.building

    def count(self) -> int:
        rows = self.read()
        return 0 if rows is None else rows.count()

    # -- writing

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.ids), F.lit(self.buckets)).cast("int")

    def _publish(self, manifest: dict) -> None:
        names = [n for n in self._list("versions") if n.endswith(".json")]
        number = int(names[-1][:8]) + 1 if names else 0
        self._write_text(f"versions/{number:08d}.json", json.dumps(manifest, sort_keys=True))
        for n in names[:-1]:
            self.fs.delete(self.Path(f"{self.path}/versions/{n}"), False)
        kept = {p for m in self._manifests() for p in m["buckets"].values()}
        folders = {p.split("/")[0] + "/" + p.split("/")[1] for p in kept}
        for w in self._list("data"):
            if f"data/{w}" not in folders:
                self.fs.delete(self.Path(f"{self.path}/data/{w}"), True)
                continue
            for b in self._list(f"data/{w}"):
                if b.startswith("b=") and f"data/{w}/{b}" not in kept:
                    self.fs.delete(self.Path(f"{self.path}/data/{w}/{b}"), True)

    def _write(self, rows: DataFrame, touched: set[int] | None, last: dict | None, stamp: dict[str, str]) -> dict:
        """The manifest of a write of ``rows``: all buckets, or those ``touched`` beside those of ``last``."""
        at = f"data/{uuid.uuid4().hex}"
        rows.withColumn("b", self._bucket()).repartition("b").write.partitionBy("b").parquet(f"{self.path}/{at}")
        made = {n[2:]: f"{at}/{n}" for n in self._list(at) if n.startswith("b=")}
        old = {} if touched is None or last is None else {b: p for b, p in last["buckets"].items() if int(b) not in touched}
        return {"stamp": stamp, "schema": json.loads(rows.schema.json()), "buckets": {**old, **made}}

    def replace(self, rows: DataFrame) -> None:
        with self.lock():
            self._publish(self._write(rows, None, None, self.stamp))

    def upsert(self, rows: DataFrame, id_col: str | None = None, live: DataFrame | None = None) -> int:
        """Replace rows of equal id; with ``live`` (ids) given, rows of other ids leave. Returns how many buckets were made anew.

        Only buckets in which a row comes, goes or changes are read and written.
        """
        ids = [id_col] if id_col else self.ids
        with self.lock():
            found = self._manifests()
            if not found:
                new = rows if live is None else rows.join(live.select(*ids).distinct(), ids, "left_semi")
                self._publish(self._write(new, None, None, self.stamp))
                return self.buckets
            last = self._checked(found[-1])
            have = self._rows(last)
            moved = rows.select(self._bucket().alias("b")).distinct()
            if live is not None:
                moved = moved.unionByName(have.select(*ids).join(live.select(*ids).distinct(), ids, "left_anti").select(self._bucket().alias("b")).distinct())
            touched = {r["b"] for r in moved.distinct().collect()}
            if not touched:
                return 0
            inside = {"buckets": {b: p for b, p in last["buckets"].items() if int(b) in touched}, "schema": last["schema"]}
            part = self._rows(inside).join(rows.select(*ids), ids, "left_anti").unionByName(rows, allowMissingColumns=True)
            if live is not None:
                part = part.join(live.select(*ids).distinct(), ids, "left_semi")
            self._publish(self._write(part, touched, last, self.stamp))
            return len(touched)

    def remove(self, gone: DataFrame) -> int:
        """Rows of these ids leave; returns how many buckets were made anew."""
        with self.lock():
            found = self._manifests()
            if not found:
                return 0
            last = self._checked(found[-1])
            touched = {r["b"] for r in gone.select(self._bucket().alias("b")).distinct().collect()} & {int(b) for b in last["buckets"]}
            if touched:
                inside = {"buckets": {b: p for b, p in last["buckets"].items() if int(b) in touched}, "schema": last["schema"]}
                self._publish(self._write(self._rows(inside).join(gone.select(*self.ids).distinct(), self.ids, "left_anti"), touched, last, self.stamp))
            return len(touched)

    def restamp(self, stamp: dict[str, str]) -> None:
        """Put the rows under another stamp: their count is held against the old one before the new manifest counts."""
        with self.lock():
            found = self._manifests()
            if not found:
                raise ValueError("nothing to stamp")
            last = found[-1]
            new = self._write(self._rows(last), None, None, dict(stamp))
            if self._rows(new).count() != self._rows(last).count():
                raise ValueError("the copy doesn't hold what the collection does")
            self._publish(new)
            self.stamp = dict(stamp)

    def adopt(self, orphan: str) -> bool:
        """Take over the rows of a collection beside it (a copy whose writer died), if it carries this stamp and holds more rows; it is dropped either way."""
        other = Collection(self.spark, orphan, self.stamp, self.ids, self.buckets)
        rows = other.read()
        better = rows is not None and rows.count() > self.count()
        if better:
            self.replace(rows)
        other.drop()
        return better

    def drop(self) -> None:
        self.fs.delete(self.Path(self.path), True)


def export_shards(rows: DataFrame, path: str, id_col: str = "id", per_file: int = SHARD_ROWS, stamp: dict[str, str] | None = None) -> None:
    """Rows in id order as gzipped JSON lines, at most ``per_file`` to a file, the manifest last; put in place of an older export by a rename,
    which is put back if that fails. Raises if a number is NaN or infinite."""
    refuse_nonfinite(rows)
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    sorted_rows = rows.repartitionByRange(id_col).sortWithinPartitions(id_col)
    sorted_rows.write.option("compression", "gzip").option("maxRecordsPerFile", per_file).json(f"{beside}/shards")
    n = spark.read.schema(rows.schema).json(f"{beside}/shards").count()
    manifest = json.dumps({"count": n, "schema": json.loads(rows.schema.json()), "per_file": per_file, "stamp": stamp or {}}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{beside}/manifest")
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{beside}.old"
    had = fs.exists(P(path)) and fs.rename(P(path), P(old))
    if not fs.rename(P(beside), P(path)):
        if had:
            fs.rename(P(old), P(path))
        raise OSError(f"{path} can't be replaced")
    fs.delete(P(old), True)


def import_shards(spark: SparkSession, path: str, live: DataFrame | None = None, id_col: str = "id", stamp: dict[str, str] | None = None) -> DataFrame:
    """The exported rows; with ``live`` given, only those whose id is still there. Raises without a manifest, on another count or another stamp."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if stamp is not None and manifest.get("stamp", {}) != stamp:
        raise ValueError(f"the shards were made with {manifest.get('stamp')}, not {stamp}")
    rows = spark.read.schema(StructType.fromJson(manifest["schema"])).json(f"{path}/shards")
    if rows.count() != manifest["count"]:
        raise ValueError("the shards don't hold what the manifest says")
    return rows.join(live.select(id_col).distinct(), id_col, "left_semi") if live is not None else rows


def nonfinite(rows: DataFrame) -> DataFrame:
    """(column, n): how many values of each float column are NaN or infinite; exports must have none."""
    cols = [c for c, t in rows.dtypes if t in ("double", "float")]
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    sums = rows.agg(*[F.count_if(bad(c)).alias(c) for c in cols]) if cols else rows.limit(0).agg(F.count("*").alias("none"))
    return sums.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in sums.columns]), F.array(*[F.col(c) for c in sums.columns]))).alias("column", "n"))


def refuse_nonfinite(rows: DataFrame) -> None:
    """Raise with the columns that hold a NaN or an infinity, as JSON has no word for them."""
    bad = [f"{r['column']} ({r['n']})" for r in nonfinite(rows).where("n > 0").collect()]
    if bad:
        raise ValueError("NaN or infinite values in " + ", ".join(bad))
