"""Welded units, average-linkage splits of groups, context of a file."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import stage

#: Most members of a welded unit, similarity of a split, size from which a part is split.
WELD_CAP, SPLIT_SIM, BLOB = 12, 0.65, 60


def script_links(files: DataFrame) -> DataFrame:
    """(repo, scene, ord, script): the scripts of a scene in file order, or its attached script if it lists none."""
    bare = F.filter(F.transform(F.coalesce("scripts", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, "^res://", "")), lambda x: x != "")
    one = F.nullif(F.regexp_replace(F.trim(F.coalesce("attached_script", F.lit(""))), "^res://", ""), F.lit(""))
    each = F.when(F.size(bare) > 0, bare).when(one.isNotNull(), F.array(one))
    return files.select("repo", F.col("path").alias("scene"), F.posexplode(each).alias("ord", "script"))


def weld(links: DataFrame, cap: int = WELD_CAP, rounds: int | None = None) -> DataFrame:
    """(node, unit): connected nodes (a, b) as units named by their least node, cut into runs of at most ``cap``.

    Least labels spread along links until nothing moves, or for ``rounds`` if given; larger units are cut in order of their nodes.
    """
    both = stage(links.select("a", "b").unionAll(links.select("b", "a")).distinct(), "weld")
    label = both.select(F.col("a").alias("node")).distinct().withColumn("unit", F.col("node"))
    for _ in count() if rounds is None else range(rounds):
        near = both.join(label.select(F.col("node").alias("b"), "unit"), "b").groupBy(F.col("a").alias("node")).agg(F.min("unit").alias("via"))
        new = stage(label.join(near, "node", "left").select("node", F.least("unit", "via").alias("unit"), (F.col("via") < F.col("unit")).alias("moved")), "weld")
        label = new.select("node", "unit")
        if new.where("moved").isEmpty():
            break
    nth = F.row_number().over(Window.partitionBy("unit").orderBy("node")) - 1
    return label.withColumn("cut", F.floor(nth / cap)).withColumn("unit", F.min("node").over(Window.partitionBy("unit", "cut"))).select("node", "unit")


def average_linkage(vectors: np.ndarray, least_sim: float) -> np.ndarray:
    """Group number of each row: the two groups of largest mean cosine merge while that is at least ``least_sim``."""
    n = len(vectors)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -np.inf)
    size, own = np.ones(n), np.arange(n)
    while n > 1:
        a, b = divmod(int(np.argmax(sim)), n)
        if sim[a, b] < least_sim:
            break
        a, b = min(a, b), max(a, b)
        merged = (size[a] * sim[a] + size[b] * sim[b]) / (size[a] + size[b])
        sim[a], sim[:, a] = merged, merged
        sim[b], sim[:, b] = -np.inf, -np.inf
        sim[a, a] = -np.inf
        size[a] += size[b]
        own[own == b] = a
    return np.unique(own, return_inverse=True)[1]


def linkage_merges(vectors: np.ndarray, least_sim: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, sims): every merge (a, b), a < b, of average linkage down to ``least_sim``, in an order in which b may be put to a, from the
    sums of the groups' unit vectors, in memory that grows with the rows.

    The mean cosine of two groups is the product of their sums over their sizes. Chains of nearest
    groups end in pairs that are each other's nearest; with average linkage a merge never brings two groups
    nearer than the nearer of them was, so such pairs may merge in any order, and a group whose nearest
    is under ``least_sim`` is done. So the merges of one run hold the groups of every higher similarity; ``sims`` never rise from a
    merge to those above it. Only among equal cosines may the order of merges matter.
    """
    sums = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    usable = np.isfinite(sums).all(axis=1)
    sums, name = sums[usable], np.nonzero(usable)[0]
    size, low, gone = np.ones(len(name)), np.full(len(name), np.inf), np.zeros(len(name))
    pairs, sims, chain = [], [], []
    first, alive = 0, len(name)
    while True:
        if 2 * alive < len(name):
            stay = gone == 0
            to = np.cumsum(stay) - 1
            sums, name, size, low, gone = sums[stay], name[stay], size[stay], low[stay], gone[stay]
            chain, first = [int(to[c]) for c in chain], 0
        if not chain:
            while first < len(name) and gone[first]:
                first += 1
            if first == len(name):
                break
            chain.append(first)
        a = chain[-1]
        sim = sums @ sums[a] / (size * size[a])
        sim += gone
        sim[a] = -np.inf
        b = int(np.argmax(sim))
        if not sim[b] >= least_sim or sim[b] == -np.inf:
            gone[a] = -np.inf
            alive -= 1
            chain.pop()
        elif len(chain) > 1 and sim[chain[-2]] >= sim[b] - 1e-12:
            b = chain[-2]
            chain = chain[:-2]
            low[min(a, b)] = min(sim[b], low[a], low[b])
            a, b = min(a, b), max(a, b)
            pairs.append((name[a], name[b]))
            sims.append(low[a])
            sums[a] += sums[b]
            size[a] += size[b]
            gone[b] = -np.inf
            alive -= 1
        else:
            chain.append(b)
    return np.array(pairs, np.int64).reshape(-1, 2), np.array(sims, np.float64)


def merged_groups(n: int, pairs: np.ndarray, sims: np.ndarray, least_sim: float) -> np.ndarray:
    """Group number of each of ``n`` rows by the merges of at least ``least_sim``."""
    own = np.arange(n)
    kept = pairs[sims >= least_sim]
    own[kept[:, 1]] = kept[:, 0]
    while (own != own[own]).any():
        own = own[own]
    return np.unique(own, return_inverse=True)[1]


def chained_linkage(vectors: np.ndarray, least_sim: float) -> np.ndarray:
    """The groups of ``average_linkage`` in memory that grows with the rows."""
    return merged_groups(len(vectors), *linkage_merges(vectors, least_sim), least_sim)


def split_groups(rows: DataFrame, least_sim: float = SPLIT_SIM, most: int = 1500) -> DataFrame:
    """(grp, id, part) of rows (grp, id, embedding): each group split by average linkage.

    Groups of more than ``most`` members, whose table of cosines would be large, are linked from sums;
    the parts are the same. A group is linked whole, in one task: its vectors must fit there, and the time
    grows with the square of its members.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        link = average_linkage if len(pdf) <= most else chained_linkage
        part = link(np.array(pdf["embedding"].tolist(), np.float64), least_sim)
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "part": [f"0.{p}" for p in part]})

    return rows.select("grp", "id", "embedding").groupBy("grp").applyInPandas(split, f"grp {dict(rows.dtypes)['grp']}, id long, part string")


def file_context(path: str, adjacency: DataFrame, membership: DataFrame, indeg: DataFrame, direct: int = 15, ring: int = 10) -> DataFrame:
    """(section, name, n, total) of one file: its cluster, incoming edges, first direct neighbours with true totals, and the first files
    behind those, each with the best-wired direct neighbour that leads to it."""
    mine = stage(adjacency.where(F.col("file") == path).groupBy("nb", "direction").agg(F.sum("n").alias("n")), "context")
    total = mine.agg(F.count("*").alias("t")).first()["t"]
    near = mine.orderBy(F.desc("n"), "nb", "direction").limit(direct).select(F.concat(F.lit("neighbour "), "direction").alias("section"), F.col("nb").alias("name"), "n", F.lit(total).cast("long").alias("total"))
    own = membership.where(F.col("path") == path).select("cluster")
    size = membership.join(F.broadcast(own), "cluster").groupBy("cluster").agg(F.count("*").alias("n")).select(F.lit("cluster").alias("section"), F.col("cluster").alias("name"), "n", F.col("n").alias("total"))
    hub = indeg.where(F.col("path") == path).select(F.lit("incoming").alias("section"), F.col("path").alias("name"), F.col("indeg").alias("n"), F.col("indeg").alias("total"))
    by_nb = mine.groupBy("nb").agg(F.sum("n").alias("w"))
    behind = adjacency.select("file", F.col("nb").alias("to")).distinct().join(by_nb.withColumnRenamed("nb", "file"), "file").where(F.col("to") != path).join(by_nb.select(F.col("nb").alias("to")), "to", "left_anti")
    far = stage(behind.groupBy("to").agg(F.min(F.struct((-F.col("w")).alias("w"), "file")).alias("v"), F.count("*").alias("n")), "ring")
    all_far = far.count()
    around = far.orderBy(F.desc("n"), "to").limit(ring).select(F.concat(F.lit("ring via "), F.col("v.file")).alias("section"), F.col("to").alias("name"), "n", F.lit(all_far).cast("long").alias("total"))
    return near.unionByName(size).unionByName(hub).unionByName(around)
