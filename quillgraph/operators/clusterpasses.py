"""Passes over a clustering: majorities, routing, merging, caps, coarse groups; each takes and gives (path, unit, comm).

A unit (a scene with its scripts, say) moves as a whole. Votes are sums, winners are maxima with a stated order, so a
pass is a few joins whatever the size of a cluster; only summaries of clusters are looped over.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import dir_parts, pack_key, seed_chain, stem
from quillgraph.operators.grouping import linkage_merges, merged_groups
from quillgraph.session import release, stage

#: Evidence under which a unit is loose, sizes of clusters, and similarities of merges and of coarse groups.
LOOSE_DEGREE, LOOSE_SIM = 2, 0.55
MOST_PARTS, MERGED_CAP, SOFT_CAP, HARD_CAP, CHUNK, SMALL, TINY = 38, 58, 66, 70, 55, 3, 4
SMALL_SIM, COARSE_SIM, COARSE_LEAST, COARSE_MOST = 0.55, 0.45, 3, 8

Path = Callable[[Column], Column]


def is_scene(path: Column) -> Column:
    return path.endswith(".tscn")


def majority(votes: DataFrame, item: str, choice: str = "comm") -> DataFrame:
    """(item, choice, n, total, second, n2): the choice of most votes (item, choice, n), ties to the lower choice, and the runner-up."""
    sums = votes.groupBy(item, choice).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(item).orderBy(F.desc("n"), choice)
    ranked = sums.withColumn("r", F.row_number().over(w))
    pick = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    return ranked.groupBy(item).agg(pick(1, choice).alias(choice), pick(1, "n").alias("n"), F.sum("n").alias("total"), pick(2, choice).alias("second"), F.coalesce(pick(2, "n"), F.lit(0)).alias("n2"))


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("comm").agg(F.count("*").alias("size"))


def apply_moves(members: DataFrame, moves: DataFrame) -> DataFrame:
    """Members with the units of ``moves`` (unit, to) in their new cluster."""
    return members.join(moves.select("unit", "to"), "unit", "left").select("path", "unit", F.coalesce("to", "comm").alias("comm"))


def _lone_scripts(members: DataFrame) -> DataFrame:
    """(path, unit, comm) of units that are one file and no scene."""
    one = members.groupBy("unit").agg(F.min("path").alias("path"), F.min("comm").alias("comm"), F.count("*").alias("n"))
    return one.where((F.col("n") == 1) & ~is_scene(F.col("path"))).select("path", "unit", "comm")


def loose_moves(members: DataFrame, degree: DataFrame, similar: DataFrame, where: Path) -> DataFrame:
    """(unit, to) of units with hardly a link (unit, degree) and nothing similar (unit, sim): the cluster that holds most units of their folder.

    ``where`` gives the path in its repository of a member's path; the folder of a unit is that of its first file.
    """
    unit = members.groupBy("unit").agg(F.min("path").alias("path"), F.min("comm").alias("comm"))
    seed = F.array_join(seed_chain(where(F.col("path"))), "/")
    u = unit.withColumn("seed", F.nullif(seed, F.lit(""))).where("seed is not null")
    home = majority(u.select("seed", "comm", F.lit(1).alias("n")), "seed").select("seed", F.col("comm").alias("to"))
    weak = u.join(degree, "unit", "left").join(similar, "unit", "left").where((F.coalesce("degree", F.lit(0)) < LOOSE_DEGREE) & (F.coalesce("sim", F.lit(0.0)) < LOOSE_SIM))
    return weak.join(home, "seed").where("to <> comm").select("unit", "to")


def folder_moves(members: DataFrame, where: Path) -> DataFrame:
    """(unit, to) of single scripts whose folder chain, or the one above, is at home elsewhere: three or more there, and fewer than three or three less here."""
    s = _lone_scripts(members).withColumn("chain", seed_chain(where(F.col("path")))).where(F.size("chain") > 0)
    per = s.groupBy("chain", "comm").agg(F.count("*").alias("n"))
    home = majority(per, "chain").select("chain", F.col("comm").alias("to"), F.col("n").alias("there"))
    keys = s.select("unit", "comm", F.posexplode(F.array(F.col("chain"), F.slice("chain", 1, F.size("chain") - 1))).alias("o", "chain")).where(F.size("chain") > 0)
    got = keys.join(home, "chain").join(per.withColumnRenamed("n", "here"), ["chain", "comm"], "left").withColumn("here", F.coalesce("here", F.lit(0)))
    ok = got.where((F.col("to") != F.col("comm")) & (F.col("there") >= 3) & ((F.col("here") < 3) | (F.col("there") >= F.col("here") + 3)))
    return ok.groupBy("unit").agg(F.min_by("to", "o").alias("to"))


def pack_counts(members: DataFrame) -> DataFrame:
    """(unit, comm, pack) of the scenes that belong to a pack."""
    return members.where(is_scene(F.col("path"))).select("unit", "comm", pack_key(stem(F.col("path"))).alias("pack")).where("pack is not null")


def pack_homes(packs: DataFrame) -> DataFrame:
    """(pack, home): the cluster with most scenes of a pack, three at least."""
    return majority(packs.select("pack", "comm", F.lit(1).alias("n")), "pack").where("n >= 3").select("pack", F.col("comm").alias("home"))


def pack_moves(members: DataFrame) -> DataFrame:
    """(unit, to) of units whose packs all have one other home, with more scenes there than here for each of them."""
    packs = stage(pack_counts(members), "packs")
    per = packs.groupBy("pack", "comm").agg(F.count("*").alias("n"))
    u = packs.distinct().join(pack_homes(packs), "pack", "left")
    u = u.join(per.withColumnRenamed("n", "here"), ["pack", "comm"]).join(per.select("pack", F.col("comm").alias("home"), F.col("n").alias("there")), ["pack", "home"], "left")
    agg = u.groupBy("unit", "comm").agg(F.min("home").alias("to"), F.countDistinct("home").alias("homes"), F.bool_and(F.coalesce(F.col("there") > F.col("here"), F.lit(False))).alias("all_more"), F.count(F.when(F.col("home").isNull(), 1)).alias("none"))
    return agg.where("homes = 1 and none = 0 and all_more and to <> comm").select("unit", "to")


def neighbour_votes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(path, nb): neighbours of each member by links (src_file, dst_file), both ways, one for each direction."""
    both = links.select(F.col("src_file").alias("path"), F.col("dst_file").alias("nb"), F.lit(0).alias("way")).unionAll(links.select("dst_file", "src_file", F.lit(1))).distinct()
    return both.join(members.select("path"), "path", "left_semi").select("path", "nb")


def infra_moves(members: DataFrame, links: DataFrame) -> DataFrame:
    """(unit, to) of single scripts by the homes of the pack scenes they touch: two votes at least, half of them for the winner; a tie of two goes to the larger cluster."""
    packs = pack_counts(members)
    home = members.where(is_scene(F.col("path"))).select(F.col("path").alias("nb"), pack_key(stem(F.col("path"))).alias("pack")).join(pack_homes(packs), "pack").select("nb", F.col("home").alias("comm"))
    s = _lone_scripts(members)
    votes = neighbour_votes(members, links).join(s.select("path", "unit"), "path").join(home, "nb").select("unit", "comm", F.lit(1).alias("n"))
    m, z = majority(votes, "unit"), sizes(members)
    m = m.join(z.select("comm", F.col("size").alias("s1")), "comm").join(z.select(F.col("comm").alias("second"), F.col("size").alias("s2")), "second", "left")
    to = F.when((F.col("n") == F.col("n2")) & (F.col("s2") > F.col("s1")), F.col("second")).otherwise(F.col("comm"))
    won = m.where((F.col("total") >= 2) & (F.col("n") * 2 >= F.col("total"))).select("unit", to.alias("to"))
    return won.join(s.select("unit", "comm"), "unit").where("to <> comm").select("unit", "to")


def usage_moves(members: DataFrame, links: DataFrame, where: Path) -> DataFrame:
    """(unit, to) of single scripts outside folders whose neighbours in other clusters all lie in one of 66 files at most, two of them at least."""
    s = _lone_scripts(members).where(F.size(dir_parts(where(F.col("path")))) == 0)
    votes = neighbour_votes(members, links).join(s, "path").join(members.select(F.col("path").alias("nb"), F.col("comm").alias("c2")), "nb").where("c2 <> comm").select("unit", F.col("c2").alias("comm"), F.lit(1).alias("n"))
    m = majority(votes, "unit").where("total >= 2 and n = total").join(sizes(members), "comm").where(F.col("size") <= SOFT_CAP)
    return m.select("unit", F.col("comm").alias("to"))


def merge_down(members: DataFrame, links: DataFrame, most: int = MOST_PARTS, cap: int = MERGED_CAP) -> DataFrame:
    """Members with clusters merged while there are more than ``most``: in a round, pairs that are each other's heaviest link
    (by wires, then the smaller sum, then the lower ids) and no more than ``cap`` files together, the heaviest first. A merged cluster has the lower id."""
    state, held = members.select("path", "unit", "comm"), None
    while True:
        size = stage(sizes(state), "merge-sizes")
        spare = size.count() - most
        if spare <= 0:
            return state
        ends = links.join(state.select(F.col("path").alias("src_file"), F.col("comm").alias("a")), "src_file").join(state.select(F.col("path").alias("dst_file"), F.col("comm").alias("b")), "dst_file").where("a <> b")
        pair = ends.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("w"))
        pair = pair.join(size.select(F.col("comm").alias("x"), F.col("size").alias("sx")), "x").join(size.select(F.col("comm").alias("y"), F.col("size").alias("sy")), "y").withColumn("s", F.col("sx") + F.col("sy")).where(F.col("s") <= cap)
        both = pair.select(F.col("x").alias("c"), "x", "y", "w", "s").unionAll(pair.select("y", "x", "y", "w", "s"))
        order = [F.desc("w"), F.asc("s"), F.asc("x"), F.asc("y")]
        best = both.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(*order))).where("r = 1")
        mutual = best.groupBy("x", "y", "w", "s").agg(F.count("*").alias("k")).where("k = 2").orderBy(*order).limit(spare)
        merged = stage(mutual.select(F.col("y").alias("comm"), F.col("x").alias("to")), "merge-pairs")
        if merged.isEmpty():
            return state
        new = stage(state.join(merged, "comm", "left").select("path", "unit", F.coalesce("to", "comm").alias("comm")), "merged")
        release(held, size, merged)
        state = held = new


def merge_small(members: DataFrame, vectors: DataFrame, least: int = SMALL, sim: float = SMALL_SIM, misc: int = -1) -> DataFrame:
    """Members with clusters of fewer than ``least`` files put to the one with the nearest mean vector (path, embedding) at ``sim`` or more, otherwise to ``misc``.

    The means of small clusters are joined with those of the others component by component.
    """
    size = stage(sizes(members), "small-sizes")
    cells = vectors.join(members.select("path", "comm"), "path").select("comm", F.posexplode("embedding").alias("pos", "x")).groupBy("comm", "pos").agg(F.avg("x").alias("m"))
    norm = cells.groupBy("comm").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    unit = stage(cells.join(norm, "comm").select("comm", "pos", F.try_divide("m", "n").alias("x")).join(size, "comm"), "small-means")
    few, large = unit.where(F.col("size") < least), unit.where(F.col("size") >= least)
    cos = few.select(F.col("comm").alias("a"), "pos", F.col("x").alias("p")).join(large.select(F.col("comm").alias("b"), "pos", F.col("x").alias("q")), "pos").groupBy("a", "b").agg(F.round(F.sum(F.col("p") * F.col("q")), 6).alias("c"))
    near = cos.groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("nb"))).alias("m")).where(F.col("m.c") >= sim).select(F.col("a").alias("comm"), (-F.col("m.nb")).alias("to"))
    small = size.where(F.col("size") < least).select("comm").join(near, "comm", "left").select("comm", F.coalesce("to", F.lit(misc)).alias("to"))
    return members.join(small, "comm", "left").select("path", "unit", F.coalesce("to", "comm").alias("comm"))


def enforce_cap(members: DataFrame, cap: int = HARD_CAP, chunk: int = CHUNK) -> DataFrame:
    """Members with clusters of more than ``cap`` files cut, in the order of their units, into runs of about ``chunk`` files; units stay whole.

    ``comm`` becomes a string: the cluster, and for the runs of a cut one its number behind a dot.
    """
    unit = members.groupBy("comm", "unit").agg(F.count("*").alias("k"))
    w = Window.partitionBy("comm").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = unit.join(sizes(members), "comm").withColumn("upto", F.sum("k").over(w))
    part = F.when(F.col("size") > cap, F.concat_ws(".", F.col("comm").cast("string"), F.floor((F.col("upto") - F.col("k")) / chunk).cast("string"))).otherwise(F.col("comm").cast("string"))
    return members.join(placed.select("comm", "unit", part.alias("to")), ["comm", "unit"]).select("path", "unit", F.col("to").alias("comm"))


def fold_tiny(members: DataFrame, where: Path, tiny: int = TINY, cap: int = SOFT_CAP) -> DataFrame:
    """Members with clusters of ``tiny`` files or fewer folded into the larger one (up to ``cap`` files) that shares most files of their first folders."""
    first = F.try_element_at(dir_parts(where(F.col("path"))), F.lit(1))
    m = members.withColumn("top", first).where("top is not null")
    size = stage(sizes(members), "tiny-sizes")
    per = m.groupBy("comm", "top").agg(F.count("*").alias("n")).join(size, "comm")
    few, large = per.where(F.col("size") <= tiny), per.where((F.col("size") > tiny) & (F.col("size") <= cap))
    shared = few.select(F.col("comm").alias("a"), "top").join(large.select("comm", "top", "n"), "top").select("a", "comm", "n")
    to = majority(shared, "a").select(F.col("a").alias("comm"), F.col("comm").alias("to"))
    return members.join(to, "comm", "left").select("path", "unit", F.coalesce("to", "comm").alias("comm"))


def coarse_groups(centroids: DataFrame, least_sim: float = COARSE_SIM, least: int = COARSE_LEAST, most: int = COARSE_MOST) -> DataFrame:
    """(comm, grp) of cluster means (comm, embedding): average linkage cut at ``least_sim``, the cut moved in steps of 0.05 until there are ``least`` to ``most`` groups or it can't be.

    One row a cluster goes to one task; sums of groups are held, not the table of similarities. The clusters are linked once, down to -1, and every cut is read from those merges.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("comm")
        x = np.array(pdf["embedding"].tolist(), np.float64)
        merges = linkage_merges(x, -1.0)
        cut, own = least_sim, merged_groups(len(x), *merges, least_sim)
        for _ in range(40):
            n = len(set(own.tolist()))
            step = 0.05 if n < min(least, len(x)) else -0.05 if n > most else 0.0
            if not step or not -1 < cut + step < 1:
                break
            cut += step
            new = merged_groups(len(x), *merges, cut)
            if step > 0 and len(set(new.tolist())) > most or step < 0 and len(set(new.tolist())) < least:
                break
            own = new
        return pd.DataFrame({"comm": pdf["comm"], "grp": own})

    return centroids.select("comm", "embedding", F.lit(1).alias("one")).groupBy("one").applyInPandas(group, f"comm {dict(centroids.dtypes)['comm']}, grp long")


def ranked_members(members: DataFrame, indeg: DataFrame, parts: int = 30, shown: int = 12) -> DataFrame:
    """(comm, size, place, path, indeg, rank): the ``parts`` largest clusters, each with its ``shown`` files of most incoming edges, ties by path backwards."""
    top = sizes(members).orderBy(F.desc("size"), "comm").limit(parts)
    place = Window.orderBy(F.desc("size"), "comm")
    top = top.withColumn("place", F.row_number().over(place))  # at most ``parts`` rows
    m = members.join(F.broadcast(top), "comm").join(indeg, "path", "left").withColumn("indeg", F.coalesce("indeg", F.lit(0)))
    w = Window.partitionBy("comm").orderBy(F.desc("indeg"), F.desc("path"))
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= shown).select("comm", "size", "place", "path", "indeg", "rank")
