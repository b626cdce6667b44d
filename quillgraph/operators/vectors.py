"""Exact nearest neighbours in blocks, mutual pairs, centroids, medoids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import cosine, dot, recall_tokens


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64).reshape(len(rows), -1 if rows else 0)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def knn(queries: DataFrame, rows: DataFrame, k: int, floor: float = -1.0, block: int = 8192) -> DataFrame:
    """(q, id, sim, rank): the ``k`` most similar rows of each query, exact; ties by id, a row isn't its own neighbour.

    Both are (id bigint, embedding array<float>). A block of at most ``block`` queries is broadcast (a few
    MB), all rows stream past it, and each batch keeps its k best per query; more queries take more
    passes. Rows without a usable vector (null, empty, a null in it, or of another length) take no part.
    """
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    queries, rows = (x.select(F.col("id").cast("long").alias("id"), "embedding").where(usable) for x in (queries, rows))
    asked: list[tuple[int, list]] = []
    out = None

    def scan(asked: list[tuple[int, list]]) -> DataFrame:
        dim = len(asked[0][1]) if asked else 0
        asked = [a for a in asked if len(a[1]) == dim]
        held = rows.sparkSession.sparkContext.broadcast((np.array([a[0] for a in asked], np.int64), _unit([a[1] for a in asked]).astype(np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            for b in batches:
                pairs = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(v) == dim]
                if not pairs or not len(qid):
                    continue
                ids, m = np.array([p[0] for p in pairs], np.int64), _unit([p[1] for p in pairs])
                sim = q @ m.T
                sim[qid[:, None] == ids[None, :]] = -2
                # All that tie with the k-th best stay; the final rank decides between them.
                kth = np.partition(sim, max(0, sim.shape[1] - k), axis=1)[:, max(0, sim.shape[1] - k)]
                r, c = np.nonzero((sim >= np.maximum(kth - 1e-9, floor)[:, None]) & (sim > -1.5))
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[c]), pa.array(sim[r, c])], ["q", "id", "sim"])

        return rows.mapInArrow(run, "q long, id long, sim double")

    for r in queries.toLocalIterator():
        asked.append((r["id"], list(r["embedding"])))
        if len(asked) == block:
            out, asked = scan(asked) if out is None else out.unionAll(scan(asked)), []
    last = scan(asked)
    found = last if out is None else out.unionAll(last)
    found = found.groupBy("q", "id").agg(F.max("sim").alias("sim")).withColumn("sim", F.round("sim", 6))
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("sim") >= floor))


def mutual(near: DataFrame) -> DataFrame:
    """(a, b, sim), a < b, of pairs that are in each other's lists."""
    ab = near.select(F.col("q").alias("a"), F.col("id").alias("b"), "sim").where("a < b")
    ba = near.select(F.col("id").alias("a"), F.col("q").alias("b")).where("a < b")
    return ab.join(ba, ["a", "b"])


def centroids(rows: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, pos, v): L2-normalised mean of each group, one row per dimension; sums are combined on the map side."""
    cells = rows.select(group, F.posexplode(vec).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = cells.groupBy(group).agg(F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m"))), F.lit(1e-9)).alias("n"))
    return cells.join(norm, group).select(group, "pos", (F.col("m") / F.col("n")).alias("v"))


def centroid_cosines(cells: DataFrame, group: str) -> DataFrame:
    """(a, b, cos), a < b, through an equi-join on the dimension."""
    left, right = cells.select(F.col(group).alias("a"), "pos", F.col("v").alias("x")), cells.select(F.col(group).alias("b"), "pos", F.col("v").alias("y"))
    return left.join(right, "pos").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cos"))


def medoids(rows: DataFrame, group: str, id_col: str, vec: str) -> DataFrame:
    """(group, medoid, cos): the member nearest to the centroid by rounded cosine, ties by id."""
    c = centroids(rows, group, vec).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x.v).alias("c"))
    scored = rows.join(c, group).select(group, id_col, F.round(cosine(F.col(vec), F.col("c")), 6).alias("cos"))
    return scored.groupBy(group).agg(F.max_by(id_col, F.struct("cos", -F.col(id_col))).alias("medoid"), F.max("cos").alias("cos"))


def fake_embedding(text: Column, dim: int = 64) -> Column:
    """A vector that depends on the text alone: hashes of (text, position) scaled to -1..1."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.xxhash64(text, i) / F.lit(float(2**63))).cast("float"))


def token_place(token: str, dim: int) -> tuple[int, float]:
    """Component and sign of a token: the first two hexadecimal digits of its MD5 digest, and whether the third is below eight."""
    h = hashlib.md5(token.encode()).hexdigest()
    return int(h[:2], 16) % dim, 1.0 if int(h[2], 16) < 8 else -1.0


def hashed_vectors(rows: DataFrame, key: str, text: Column, dim: int = 64) -> DataFrame:
    """(key, embedding): signed counts of the tokens of a text over ``dim`` (256 at most) hashed components.

    A model that needs no training: texts that share words are near. The key must be a string. Texts without a token give zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for b in batches:
            tokens = b.column(1)
            coded = tokens.flatten().dictionary_encode()
            if len(known) > 500_000:
                known.clear()
            place = np.zeros((len(coded.dictionary), 2))
            for k, t in enumerate(coded.dictionary.to_pylist()):
                if t not in known:
                    known[t] = token_place(t, dim)
                place[k] = known[t]
            code = coded.indices.to_numpy(zero_copy_only=False)
            who = np.repeat(np.arange(b.num_rows), tokens.value_lengths().to_numpy(zero_copy_only=False))
            out = np.bincount(who * dim + place[code, 0].astype(np.int64), place[code, 1], b.num_rows * dim).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, dim, dtype=np.int32)), pa.array(out))], [key, "embedding"])

    return rows.select(F.col(key).cast("string").alias(key), recall_tokens(text).alias("tokens")).mapInArrow(run, f"{key} string, embedding array<float>")


__all__ = ["hashed_vectors", "token_place", "knn", "mutual", "centroids", "centroid_cosines", "medoids", "fake_embedding", "dot"]
