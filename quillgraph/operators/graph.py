"""Typed edges: wires, degrees, walks, rank, components, strata.

Walks are loops over frontiers. A loop cuts its lineage by staging each small frontier as a table in
the shared folder; the driver reads one number per round.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import node_file
from quillgraph.session import release, stage

#: Damping and number of iterations of the rank.
DAMPING, ITERATIONS = 0.85, 30


def file_wires(edges: DataFrame) -> DataFrame:
    """(src_file, dst_file, w): distinct symbol edges per ordered pair of different files."""
    pairs = edges.select("src_key", "dst_key").distinct()
    return pairs.groupBy(node_file(F.col("src_key")).alias("src_file"), node_file(F.col("dst_key")).alias("dst_file")).agg(F.count("*").alias("w")).where("src_file <> dst_file")


def symbol_degrees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, degree): distinct edges in and out; unknown names fold out, isolated symbols have 0."""
    pairs = edges.select("src_key", "dst_key").distinct()
    ends = pairs.select(F.col("src_key").alias("key")).unionAll(pairs.select(F.col("dst_key").alias("key")))
    return symbols.select("key").join(ends.groupBy("key").agg(F.count("*").alias("n")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("degree"))


def typed_adjacency(edges: DataFrame) -> DataFrame:
    """(file, nb, direction, type, n) of both directions."""
    e = edges.select(node_file(F.col("src_key")).alias("a"), node_file(F.col("dst_key")).alias("b"), "src_key", "dst_key", "type").distinct().where("a <> b")
    n = e.groupBy("a", "b", "type").agg(F.count("*").alias("n"))
    out = n.select(F.col("a").alias("file"), F.col("b").alias("nb"), F.lit("out").alias("direction"), "type", "n")
    return out.unionAll(n.select("b", "a", F.lit("in"), "type", "n"))


def in_degrees(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, indeg): typed edges into each file from others."""
    e = edges.select(node_file(F.col("src_key")).alias("a"), node_file(F.col("dst_key")).alias("path"), "src_key", "dst_key", "type").distinct().where("a <> path")
    return files.join(e.groupBy("path").agg(F.count("*").alias("n")), "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("indeg"))


def rank_by_sorting(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Global row number without one task for all rows: a range sort, counts per partition, offsets."""
    placed = rows.sort(*order).withColumn("part", F.spark_partition_id()).withColumn("mono", F.monotonically_increasing_id())
    placed = stage(placed, "ranked")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    base = rows.sparkSession.createDataFrame(offsets, "part int, base long")
    # monotonically_increasing_id holds the partition in its upper bits and a running number in the lower 33.
    return placed.join(F.broadcast(base), "part").withColumn(name, F.col("base") + F.col("mono").bitwiseAND((1 << 33) - 1) + 1).withColumn("total", F.lit(total)).drop("part", "mono", "base")


def walk(edges: DataFrame, seeds: DataFrame, depth: int | None, reverse: bool = False) -> DataFrame:
    """(key, hop) of everything within ``depth`` edges of the seeds (hop 0), each at its least hop.

    The edges are made once; a hop joins them with what the last one found.
    """
    src, dst = ("dst_key", "src_key") if reverse else ("src_key", "dst_key")
    step = edges.select(F.col(src).alias("key"), F.col(dst).alias("to")).distinct()
    if depth is None or depth > 1:
        step = stage(step, "walk-edges")
    frontier = stage(seeds.select("key").distinct().withColumn("hop", F.lit(0)), "walk")
    seen = frontier
    hop = 0
    while (depth is None or hop < depth) and not frontier.isEmpty():
        hop += 1
        new = step.join(frontier.select("key"), "key").select(F.col("to").alias("key")).distinct().join(seen.select("key"), "key", "left_anti")
        frontier = stage(new.withColumn("hop", F.lit(hop)), "walk")
        seen = seen.unionAll(frontier)
    release(step)
    return seen


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 4, direction: str = "callers") -> DataFrame:
    """(hop, key) of the closure of the seeds, seeds left out; depth is clamped to 1..8."""
    if direction not in ("callers", "callees"):
        raise ValueError("direction is callers or callees")
    return walk(edges, seeds, min(8, max(1, depth)), reverse=direction == "callers").where("hop > 0")


def pagerank(wires: DataFrame, files: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(path, rank) after exactly ``iterations`` steps from the uniform start; dangling mass is spread evenly.

    What a step adds to every node alike (the base and the dangling mass) is a number, so with M the damped
    shares the ranks are sums of the powers M^j 1, each by a number. The powers are one chain of joins and sums
    over shares that keep their partitioning, and the driver finds the numbers from one sum for each power.
    """
    nodes = files.select("path").unionAll(wires.select("src_file")).unionAll(wires.select("dst_file")).distinct()
    out = wires.groupBy("src_file").agg(F.sum("w").alias("outw"))
    share = wires.join(out, "src_file").select(F.col("src_file").alias("path"), "dst_file", (damping * F.col("w") / F.col("outw")).alias("share"))
    share = stage(share, "shares").repartition("path").persist(StorageLevel.MEMORY_AND_DISK)
    nodes = stage(nodes.join(out.select(F.col("src_file").alias("path"), F.lit(False).alias("dangling")), "path", "left").select("path", F.coalesce("dangling", F.lit(True)).alias("dangling")), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("path", F.lit(0.0).alias("rank"))
    powers = [nodes.select("path", F.lit(1.0).alias("v"))]
    for j in range(1, iterations + 1):
        new = share.join(powers[-1].hint("shuffle_hash"), "path").groupBy(F.col("dst_file").alias("path")).agg(F.sum(F.col("share") * F.col("v")).alias("v"))
        powers.append(stage(new, "power") if j % 10 == 0 else new.persist(StorageLevel.MEMORY_AND_DISK))
    every = powers[0].withColumn("j", F.lit(0))
    for j, p in enumerate(powers[1:], 1):
        every = every.unionByName(p.withColumn("j", F.lit(j)))
    # One power's worth of tasks, each with its part of all powers.
    every = stage(every.coalesce(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "powers")
    loose = [0.0] * (iterations + 1)
    for r in every.join(nodes.where("dangling"), "path", "left_semi").groupBy("j").agg(F.sum("v").alias("s")).collect():
        loose[r["j"]] = r["s"]
    given: list[float] = []  # what step i adds to every node
    for i in range(iterations):
        mass = loose[i] / n + sum(given[i - 1 - j] * loose[j] for j in range(i))
        given.append((1 - damping) / n + damping * mass / n)
    weight = [given[iterations - 1 - j] for j in range(iterations)] + [1.0 / n]
    weighted = every.select("path", (F.col("v") * F.element_at(F.array(*map(F.lit, weight)), F.col("j") + 1)).alias("r"))
    ranks = stage(weighted.groupBy("path").agg(F.sum("r").alias("rank")), "ranks")
    for p in (share, *powers):
        p.unpersist()
    release(every, *powers)
    return ranks


def _core(e: DataFrame) -> DataFrame:
    """Edges (s, t) left when those whose source has no edge in or whose target has none out are peeled off again and again."""
    size = e.count()
    while size:
        e = stage(e.join(e.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(e.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t"), "scc-core")
        n = e.count()
        if n == size:
            break
        size = n
    return e


def components(edges: DataFrame) -> DataFrame:
    """(key, scc): strongly connected components, each named by its least key.

    Nodes without an edge in or out are components of their own and are peeled off first. Then forward
    labels give each node the least key that reaches it; of the nodes with one label those that reach
    the label's node back are a component. The rest goes on.
    """
    e = stage(edges.select(F.col("src_key").alias("s"), F.col("dst_key").alias("t")).distinct().where("s <> t"), "scc-edges")
    left = stage(e.select(F.col("s").alias("key")).unionAll(e.select("t")).distinct(), "scc-nodes")
    done = None
    while not left.isEmpty():
        e = _core(e)
        inner = stage(e.select(F.col("s").alias("key")).unionAll(e.select("t")).distinct(), "scc-inner")
        alone = left.join(inner, "key", "left_anti").select("key", F.col("key").alias("scc"))
        done = alone if done is None else done.unionAll(alone)
        left = inner
        if left.isEmpty():
            break
        label, held = left.select("key", F.col("key").alias("label")), None
        while True:
            got = e.join(label.select(F.col("key").alias("s"), "label"), "s").groupBy(F.col("t").alias("key")).agg(F.min("label").alias("via"))
            new = stage(label.join(got, "key", "left").select("key", F.least("label", "via").alias("label"), (F.col("via") < F.col("label")).alias("moved")), "scc-label")
            release(held)
            label, held = new.select("key", "label"), new
            if new.where("moved").isEmpty():
                break
        same = e.join(label.select(F.col("key").alias("s"), F.col("label").alias("ls")), "s").join(label.select(F.col("key").alias("t"), F.col("label").alias("lt")), "t").where("ls = lt")
        back = walk(same.select(F.col("s").alias("src_key"), F.col("t").alias("dst_key")), label.where("key = label"), None, reverse=True)
        found = stage(label.join(back.select("key"), "key", "left_semi").select("key", F.col("label").alias("scc")), "scc-found")
        done = found if done is None else done.unionAll(found)
        left = stage(left.join(found, "key", "left_anti"), "scc-nodes")
        e = stage(e.join(left.select(F.col("key").alias("s")), "s", "left_semi").join(left.select(F.col("key").alias("t")), "t", "left_semi"), "scc-edges")
    return done if done is not None else left.select("key", F.col("key").alias("scc"))


def strata(edges: DataFrame) -> DataFrame:
    """(key, scc, depth): longest path over the condensation from components without incoming edges."""
    comp = stage(components(edges), "strata-scc")
    c = edges.join(comp.select(F.col("key").alias("src_key"), F.col("scc").alias("s")), "src_key").join(comp.select(F.col("key").alias("dst_key"), F.col("scc").alias("t")), "dst_key").where("s <> t").select("s", "t").distinct()
    c = stage(c, "strata-edges")
    held = stage(comp.select("scc").distinct().withColumn("depth", F.lit(0)), "strata")
    depth = held
    while True:
        got = c.join(depth.select(F.col("scc").alias("s"), "depth"), "s").groupBy(F.col("t").alias("scc")).agg((F.max("depth") + 1).alias("via"))
        new = stage(depth.join(got, "scc", "left").select("scc", F.greatest("depth", F.coalesce("via", F.lit(0))).alias("depth"), (F.coalesce("via", F.lit(0)) > F.col("depth")).alias("moved")), "strata")
        release(held)
        depth, held = new.select("scc", "depth"), new
        if new.where("moved").isEmpty():
            return comp.join(depth, "scc").select("key", "scc", "depth")


def repo_map(ranks: DataFrame, symbols: DataFrame, degrees: DataFrame, budget: int, names: int = 8) -> DataFrame:
    """(path, line, used): files by rank with their best-wired symbols, up to the token budget.

    Costs are never negative, so stopping at the first overflow is a running sum within the budget;
    only the first ``budget`` files can be shown, as each costs a token at least.
    """
    w = Window.partitionBy("path").orderBy(F.desc("degree"), "name")
    picked = symbols.join(degrees, "key").withColumn("r", F.row_number().over(w)).where(F.col("r") <= names)
    sigs = picked.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("sig"))
    top = ranks.withColumn("rank", F.round("rank", 12)).orderBy(F.desc("rank"), "path").limit(budget)
    text = F.concat(F.col("path"), F.lit(": "), F.coalesce("sig", F.lit("")))
    rows = top.join(sigs, "path", "left").select("path", "rank", text.alias("line"), F.floor((F.length(text) + 4) / 4).cast("long").alias("cost"), F.lit(1).alias("one"))
    run = Window.partitionBy("one").orderBy(F.desc("rank"), "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum("cost").over(run)).where(F.col("used") <= budget).select("path", "line", "used")
