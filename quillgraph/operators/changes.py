"""Incremental refresh, snapshots, budgets and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import stage


def as_of(files: DataFrame, at: str) -> DataFrame:
    """The files that were there at a time, the latest row of each (repo, path)."""
    t = F.lit(at).cast("timestamp")
    live = files.where((F.col("indexed_at") <= t) & (F.col("removed_at").isNull() | (F.col("removed_at") > t)))
    return live.groupBy("repo", "path").agg(F.max_by(F.struct("file_id", "sha", "mtime_ns", "size"), F.struct("indexed_at", "file_id")).alias("f")).select("repo", "path", "f.*")


def rescan(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action) of two snapshots: stat equal is unchanged, content equal is touched, otherwise added, updated or deleted."""
    o = old.select(*keys, F.col("sha").alias("o_sha"), F.col("mtime_ns").alias("o_m"), F.col("size").alias("o_s"), F.lit(1).alias("o"))
    n = new.select(*keys, "sha", "mtime_ns", "size", F.lit(1).alias("n"))
    action = (
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted")
        .when(F.col("o_m").eqNullSafe(F.col("mtime_ns")) & F.col("o_s").eqNullSafe(F.col("size")), "unchanged")
        .when(F.col("o_sha").eqNullSafe(F.col("sha")), "touched").otherwise("updated")
    )
    return o.join(n, keys, "full").select(*keys, action.alias("action"))


def apply_rescan(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store after a rescan: rows of gone keys leave, new and changed rows replace."""
    return store.join(new.select(*keys), keys, "left_semi").join(new, [*keys, "sha"], "left_semi").unionByName(
        new.join(store.select(*keys, "sha"), [*keys, "sha"], "left_anti"), allowMissingColumns=True
    )


def fingerprint(rows: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """(group, n, digest): an order-free digest of the rows of each group; nulls and empty texts are told apart.

    The digest is the sum of the first 48 bits of the SHA-256 digests of the rows; sums combine on the map side, so a group of
    any size is never gathered.
    """
    parts = [F.concat(F.when(F.col(c).isNull(), F.lit("0")).otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols]
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


def outdated(stored: DataFrame, now: DataFrame, group: str) -> DataFrame:
    """(group): groups whose stored fingerprint (group, n, digest) isn't that of what is there now, or that are on one side only."""
    both = stored.select(group, F.struct("n", "digest").alias("a")).join(now.select(group, F.struct("n", "digest").alias("b")), group, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(group)


def greedy_keep(rows: DataFrame, group: str, order: list[Column], item: str, cost: str, budget: float) -> DataFrame:
    """(group, kept): items of each group in priority order that still fit, those too large being skipped.

    Sequential within a group; for groups of bounded size (the lines of an order), of which items that can't ever fit are
    left out first. For one large set use ``keep_within``.
    """
    lst = rows.where(F.col(cost) <= budget).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("item"), F.col(cost).alias("cost")))).alias("xs"))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, x: F.when(s.used + x.cost <= budget, F.struct((s.used + x.cost).alias("used"), F.array_append(s.kept, x.item.cast("bigint")).alias("kept"))).otherwise(s)
    return lst.select(group, F.aggregate("xs", start, step).alias("r")).select(group, "r.kept")


def running_sum(rows: DataFrame, order: list[Column], cost: str) -> DataFrame:
    """``rows`` with ``pos`` (from 1) and ``used``, the sum of costs up to each, in one global order and without one task for all rows."""
    placed = stage(rows.sort(*order).withColumn("part", F.spark_partition_id()).withColumn("mono", F.monotonically_increasing_id()), "running")
    base, at, spent = [], 0, 0.0
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n"), F.sum(cost).alias("c")).collect(), key=lambda r: r["part"]):
        base.append((r["part"], at, float(spent)))
        at, spent = at + r["n"], spent + float(r["c"])
    offsets = rows.sparkSession.createDataFrame(base, "part int, before long, spent double")
    w = Window.partitionBy("part").orderBy("mono").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(offsets), "part").withColumn("pos", F.col("before") + F.col("mono").bitwiseAND((1 << 33) - 1) + 1)
    return out.withColumn("used", F.col("spent") + F.sum(cost).over(w)).drop("part", "mono", "before", "spent")


def keep_within(rows: DataFrame, order: list[Column], cost: str, budget: float) -> DataFrame:
    """The rows that a walk in order keeps if each is taken that still fits and others are skipped; costs are not negative.

    A round takes all rows before the first that doesn't fit and goes on behind it with those that can still fit, so the number of
    rounds is that of skipped rows which were small enough when their turn came near. Partitions are summed, never rows.
    """
    left, kept, now = float(budget), None, rows
    while True:
        summed = stage(running_sum(now.where(F.col(cost) <= left), order, cost), "budget")
        first = summed.where(F.col("used") > left).agg(F.min("pos").alias("p")).first()["p"]
        take = summed if first is None else summed.where(F.col("pos") < first)
        kept = take if kept is None else kept.unionByName(take)
        left -= float(take.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0])
        if first is None:
            return kept.drop("pos", "used")
        now = summed.where(F.col("pos") > first).drop("pos", "used")


def pair_budget(rows: DataFrame, pair: list[str], weight: str, cost: str, budget: float) -> DataFrame:
    """(pair, w, c) of the pairs whose rows all fit: heaviest pairs first, then by name; a pair that doesn't fit is skipped whole."""
    pairs = rows.groupBy(*pair).agg(F.sum(weight).alias("w"), F.sum(cost).alias("c"))
    return keep_within(pairs, [F.desc("w"), *[F.asc(p) for p in pair]], "c", budget)


def prefix_keep(rows: DataFrame, group: str, order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows of each group in order until the first that would pass the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)
