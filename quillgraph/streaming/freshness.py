"""The freshness loop: files that arrive are merged into a snapshot; readers keep the old one until the new is whole."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.changes import rescan
from quillgraph.session import release, stage
from quillgraph.sources.collections import Collection

#: Seconds that a verdict is good for, without a retry after a failure, of quiet before a rescan, and the longest wait for quiet.
TTL, COOLDOWN, QUIET, LONGEST = 3.0, 60.0, 2.0, 30.0


class StatGate:
    """Whether a tree has changed since it was last brought up to date; asked again at most every ``ttl`` seconds."""

    def __init__(self, look: Callable[[], object], ttl: float = TTL, clock: Callable[[], float] = time.monotonic):
        self.look, self.ttl, self.clock = look, ttl, clock
        self.clean, self.verdict, self.asked_at = None, False, None

    def dirty(self) -> bool:
        now = self.clock()
        if self.asked_at is None or now - self.asked_at >= self.ttl:
            self.verdict, self.asked_at = self.look() != self.clean, now
        return self.verdict

    def mark(self, seen: object | None = None) -> None:
        """What is there now (or was ``seen`` when the sync began) is the clean state."""
        self.clean, self.verdict, self.asked_at = self.look() if seen is None else seen, False, None


def wait_quiet(look: Callable[[], object], quiet: float = QUIET, longest: float = LONGEST, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, step: float = 0.25) -> bool:
    """Wait until ``look`` gives the same for ``quiet`` seconds, at most ``longest``; whether it became quiet."""
    begun = still = clock()
    last = look()
    while clock() - still < quiet:
        if clock() - begun >= longest:
            return False
        sleep(step)
        now = look()
        if now != last:
            last, still = now, clock()
    return True


def progress_line(phase: str, done: int, total: int | None, seconds: float) -> str:
    """``phase done/total (share), about so many seconds left``."""
    if not total:
        return f"{phase} {done}"
    left = f", about {seconds / done * (total - done):.0f} s left" if 0 < done < total else ""
    return f"{phase} {done}/{total} ({100 * done // total} %){left}"


class FreshnessLoop:
    """Merges batches of (repo, path, sha, mtime_ns, size, removed) into a collection.

    ``stats`` holds the actions of each merged batch; after a failure batches are refused for
    ``cooldown`` seconds and the last good snapshot stays. A batch is met with the rows of its own paths, and only the
    buckets of the collection that change are written. ``settle`` is asked before a batch (``wait_quiet`` over a listing, say),
    ``report`` is told how far a merge is.
    """

    KEYS = ["repo", "path"]

    def __init__(self, store: Collection, cooldown: float = COOLDOWN, settle: Callable[[], bool] | None = None, report: Callable[[str], None] | None = None):
        self.store, self.cooldown, self.failed_at = store, cooldown, None
        self.store.ids = self.KEYS
        self.settle, self.report = settle, report or (lambda line: None)
        self.stats: list[dict[str, int]] = []

    def merge(self, batch: DataFrame, number: int) -> None:
        if self.failed_at is not None and time.monotonic() - self.failed_at < self.cooldown:
            raise RuntimeError("cooling down after a failure")
        if self.settle is not None:
            self.settle()
        try:
            latest = Window.partitionBy(*self.KEYS).orderBy(F.desc("mtime_ns"), F.desc("sha"))
            new = stage(batch.withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r"), "batch")
            have = self.store.read()
            old = new.limit(0).drop("removed") if have is None else have.join(new.select(*self.KEYS), self.KEYS, "left_semi")
            actions = stage(rescan(old, new.where("not removed").drop("removed"), self.KEYS), "actions")
            counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
            self.report(progress_line("merge", 0, sum(counts.values()), 0.0))
            if counts.get("deleted"):
                self.store.remove(actions.where("action = 'deleted'").select(*self.KEYS))
            come = new.where("not removed").drop("removed").join(actions.where("action in ('added', 'updated', 'touched')").select(*self.KEYS), self.KEYS, "left_semi")
            if set(counts) - {"deleted", "unchanged"}:
                self.store.upsert(come)
            self.report(progress_line("merge", sum(counts.values()), sum(counts.values()), 0.0))
            release(new, actions)
            self.stats.append(counts)
            self.failed_at = None
        except Exception:
            self.failed_at = time.monotonic()
            raise

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        """A running query; ``every`` is the interval of the gate, without it what is there is merged and the query ends."""
        w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.merge)
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def sync_functions(store: Collection, functions: DataFrame, embed: Callable[[DataFrame, str, Column], DataFrame]) -> dict[str, int]:
    """Bring a collection (id, sha, line, embedding) up to the documents (id, doc, line) of functions; returns how many were kept, moved, embedded and removed.

    Equal documents keep their vector, at another line too; changed and new ones are embedded, and so are those whose
    vector is missing from an earlier run that failed. Functions that are gone leave.
    """
    now = stage(functions.select("id", F.sha2("doc", 256).alias("sha"), F.col("line").cast("int").alias("line"), "doc"), "sync-docs")
    have = store.read()
    if have is None:
        have = now.select("id", "sha", "line", F.lit(None).cast("array<float>").alias("embedding")).limit(0)
    old = have.select("id", F.col("sha").alias("osha"), F.col("line").alias("oline"), F.col("embedding").alias("vec"))
    same = F.coalesce((F.col("sha") == F.col("osha")) & F.col("vec").isNotNull(), F.lit(False))
    action = F.when(F.col("id").isNull(), "removed").when(same & F.col("line").eqNullSafe(F.col("oline")), "kept").when(same, "moved").otherwise("embedded")
    plan = stage(now.join(old.withColumnRenamed("id", "oid"), F.col("id") == F.col("oid"), "full").withColumn("action", action), "sync-plan")
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    if counts.get("removed"):
        store.remove(plan.where("action = 'removed'").select(F.col("oid").alias("id")))
    fresh = plan.where("action = 'embedded'").select("id", "sha", "line", "doc")
    vectors = embed(fresh.select("id", "doc"), "id", F.col("doc")).select("id", "embedding")
    rows = fresh.join(vectors, "id", "left").select("id", "sha", "line", "embedding").unionByName(plan.where("action = 'moved'").select("id", "sha", "line", F.col("vec").alias("embedding")))
    if counts.get("embedded") or counts.get("moved"):
        store.upsert(rows)
    release(now, plan)
    return counts


def stat_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of a tree from the file listing alone; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
