"""Problem 2: the most similar vectors of every vector, by shifted space-filling curves.

Every vector is laid on several Hilbert curves, each through another random rotation, projection to
a few dimensions and shift. A curve is cut into buckets at quantiles of a bounded sample of the
vectors; rows at the start of a bucket also go to the one before it, so that windows run over the
cuts. Spark brings the rows of a bucket together in curve order; each is streamed in blocks, a block
is compared with itself and with the window before it by one matrix product, and pairs that are
among the best of either side are candidates. The candidates of all curves are merged, reranked by
their exact cosine, and cut to k. No step gathers more than a window.

What travels to the curves is not the vector but its components rounded to four bits, 32 bytes of 64
dimensions: enough to tell candidates, as the exact cosine decides. Equal directions (copies) are
one class with one row on each curve, and rows of one curve position are told apart by their class,
so neither copies nor a crowded cell make a bucket large. Of a class only its smallest members can
be neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the rounding of the components can change in the difference of two cosines.
ROUNDING = 0.1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, d), each coordinate of ``bits`` bits (bits * d <= 62).

    Gray-code transform of the transposed index, vectorised over the points.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Keys of unit vectors on one curve: rotation, projection, shift, quantisation, Hilbert index."""
    rng = np.random.default_rng((seed, curve))
    basis, _ = np.linalg.qr(rng.normal(size=(unit.shape[1], dims)))
    scaled = (unit @ basis) * np.sqrt(unit.shape[1]) / 7.5 + 0.5 + rng.uniform(-0.1, 0.1, dims)
    return hilbert_keys(np.clip((scaled * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def _unit_rows(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, class, unit vector) of the usable rows of a batch whose second column is the vector."""
    arr = b.column(1)
    ok = arr.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim
    rows = arr.filter(pa.array(ok)).flatten()
    m = rows.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(rows) else np.zeros((0, dim))
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        good = np.isfinite(m).all(axis=1) & np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
        unit = (m[good] / norm[good]).astype(np.float32)
    unit += np.float32(0)  # one zero
    cls = np.array([int.from_bytes(blake2b(u.tobytes(), digest_size=8).digest(), "big", signed=True) for u in unit], np.int64)
    return np.nonzero(ok)[0][good], cls, unit


def _members(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cls, _unit = _unit_rows(b, dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(cls), b.column(2).take(pa.array(row))], ["id", "cls", "asked"])

    return run


def _units(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _row, cls, unit = _unit_rows(b, dim)
            cls, first = np.unique(cls, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([unit[k].tobytes() for k in first], pa.binary())], ["cls", "unit"])

    return run


def rough(unit: np.ndarray) -> np.ndarray:
    """Components in steps of a seventh of the largest, two to a byte."""
    q = np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 7).astype(np.int8) + 8
    if q.shape[1] % 2:
        q = np.concatenate([q, np.full((len(q), 1), 8, np.int8)], axis=1)
    return (q[:, ::2] | q[:, 1::2] << 4).astype(np.uint8)


def smooth(raw: bytes, width: int) -> np.ndarray:
    """Unit vectors of rounded components."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, width)
    x = np.stack([b & 15, b >> 4], axis=2).reshape(len(b), -1).astype(np.float32) - 8
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Buckets:
    """Where each curve is cut: the first (position, class) of every bucket and the end of what the bucket before shares."""

    def __init__(self, unit: np.ndarray, cls: np.ndarray, n: int, curves: int, dims: int, bits: int, seed: int, window: int, rows: int):
        self.curves, self.dims, self.bits, self.seed = curves, dims, bits, seed
        count = max(1, -(-n // max(rows, 4 * window))) if len(unit) else 1
        share = 1.25 * window / max(n, 1) + 2 / max(len(unit), 1)
        self.count, self.cuts = count, []
        for c in range(curves):
            pos = curve_keys(unit, c, dims, bits, seed) if len(unit) else np.zeros(0, np.int64)
            order = np.lexsort((cls, pos))
            at = (np.arange(1, count) / count * len(order)).astype(np.int64)
            end = np.minimum(at + max(1, int(np.ceil(share * len(order)))), len(order) - 1)
            self.cuts.append(tuple(x[order[k]] for k in (at, end) for x in (pos, cls)))

    @staticmethod
    def _before(pos: np.ndarray, cls: np.ndarray, p: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How many of the sorted pairs (pos, cls) are at or before each (p, c)."""
        low, high = np.searchsorted(pos, p, "left"), np.searchsorted(pos, p, "right")
        out = low.copy()
        for k in np.nonzero(low < high)[0]:
            out[k] += np.searchsorted(cls[low[k] : high[k]], c[k], "right")
        return out

    def place(self, unit: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, bucket, position) on each curve; a row may lie in two buckets."""
        for c in range(self.curves):
            p = curve_keys(unit, c, self.dims, self.bits, self.seed)
            sp, sc, ep, ec = self.cuts[c]
            own = self._before(sp, sc, p, cls)
            guest = np.nonzero(self._before(ep, ec, p, cls) < own)[0]
            row = np.concatenate([np.arange(len(p)), guest])
            yield row, c * self.count + np.concatenate([own, own[guest] - 1]), p[row]


def _place(held, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cls, unit = _unit_rows(b, dim)
            asked = b.column(2).to_numpy(zero_copy_only=False)[row].astype(bool)
            order = np.lexsort((~asked, cls))
            first = order[np.unique(cls[order], return_index=True)[1]]
            cls, unit, asked = cls[first], unit[first], asked[first]
            vec = np.array([v.tobytes() for v in rough(unit)], object) if len(unit) else np.zeros(0, object)
            for row, bucket, pos in held.value.place(unit, cls):
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(pos), pa.array(cls[row]), pa.array(~asked[row]), pa.array(vec[row], pa.binary())], ["bucket", "pos", "cls", "idle", "vec"])

    return run


def _nearest(src: np.ndarray, sim: np.ndarray, k: int, most: int) -> np.ndarray:
    """Which of the entries reach the ``k``-th of their source but for the rounding, ``most`` of a source."""
    order = np.lexsort((-sim, src))
    s, v = src[order], sim[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    start = np.nonzero(new)[0]
    size = np.diff(np.append(start, len(s)))
    rank = np.arange(len(s)) - np.repeat(start, size)
    kth = v[start + np.minimum(size, k) - 1]
    out = np.zeros(len(s), bool)
    out[order] = (rank < k) | (rank < most) & (v >= np.repeat(kth, size) - ROUNDING)
    return out


def _compare(prev: np.ndarray, cur: np.ndarray, asked_prev: np.ndarray, asked: np.ndarray, k: int, most: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sim) of pairs of the window and a block, numbered window first, that an asked row may have among its ``k`` best."""
    n, w = len(cur), len(prev)
    every, ask = np.concatenate([prev, cur]), np.concatenate([asked_prev, asked])
    if not ask.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    sim = cur @ every.T
    sim[:, w:][np.tril_indices(n)] = -2  # each pair once
    hit = sim >= floor
    if not ask.all():
        hit &= asked[:, None] | ask[None, :]
    at = np.flatnonzero(hit)
    if len(at) > 64 * n:  # a crowded place: only the best of each row and column are listed
        hit[:] = False
        for view, out in ((sim, hit), (sim.T, hit.T)):
            m = min(most, view.shape[1])
            best = np.argpartition(-view, m - 1, axis=1)[:, :m]
            np.put_along_axis(out, best, True, axis=1)
        hit &= sim >= floor
        at = np.flatnonzero(hit)
    i, j = at // (w + n) + w, at % (w + n)
    s = sim.reshape(-1)[at]
    good = _nearest(np.concatenate([i, j]), np.concatenate([s, s]), k, most)
    use = good[: len(i)] & ask[i] | good[len(i) :] & ask[j]
    return i[use], j[use], s[use]


def _windows(k: int, most: int, window: int, block: int, floor: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last = None, None
        ids, vec, asked = np.zeros(0, np.int64), np.zeros((0, 2 * width), np.float32), np.zeros(0, bool)
        for b in batches:
            bk, cls = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            new = np.ones(len(cls), bool)  # a class comes once in a bucket, a row that asks before others
            new[1:] = (cls[1:] != cls[:-1]) | (bk[1:] != bk[:-1])
            if len(cls) and (bk[0], cls[0]) == last:
                new[0] = False
            if len(cls):
                last = (bk[-1], cls[-1])
            at = np.nonzero(new)[0]
            if not len(at):
                continue
            raw = smooth(b"".join(b.column(4).take(pa.array(at)).to_pylist()), width)
            bk, cls, ask = bk[at], cls[at], ~b.column(3).to_numpy(zero_copy_only=False).astype(bool)[at]
            edges = [0, *(np.nonzero(np.diff(bk))[0] + 1).tolist(), len(bk)]
            for lo, hi in zip(edges, edges[1:]):
                if bk[lo] != bucket:
                    bucket, ids, vec, asked = bk[lo], ids[:0], vec[:0], asked[:0]
                for s in range(lo, hi, block):
                    e = min(hi, s + block)
                    i, j, sim = _compare(vec, raw[s:e], asked, ask[s:e], k, most, floor)
                    ids, vec, asked = np.concatenate([ids, cls[s:e]]), np.concatenate([vec, raw[s:e]]), np.concatenate([asked, ask[s:e]])
                    if len(i):
                        x, y = ids[i], ids[j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sim, pa.float32())], ["a", "b", "sim"])
                    ids, vec, asked = ids[-window:], vec[-window:], asked[-window:]

    return run


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, k: int = 6, floor: float = -1.0, dim: int = 64, curves: int = 12, dims: int = 12, bits: int = 5, window: int = 1024, block: int = 512, bucket_rows: int = 1 << 15, sample: int = 20_000, seed: int = 11, asked: Column | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): for every usable vector up to ``k`` most similar ones, at least ``floor``.

    Ties go to the smaller id. Vectors that are null, of another length, all zero or hold a null, NaN
    or infinity take no part. Redelivered ids count once. The result is approximate: a neighbour is
    missed if no curve brings it into a window (recall is measured against brute force in the
    tests). Curves are cut by a sample of about ``sample`` vectors at most, which the driver reads; every
    row is placed. ``asked``, a condition on ``id``, restricts the rows that are queries; all rows stay
    possible neighbours. An empty table gives no rows; other columns are ignored.
    """
    spark, dims = df.sparkSession, min(dims, dim)
    bits = min(bits, 62 // dims)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    src = src.select("id", "v", (F.lit(True) if asked is None else asked).alias("asked"))
    n = src.count()
    part = src.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-2 * n // sample)))) == 0)
    seen = part.mapInArrow(_units(dim), "cls long, unit binary").limit(sample).toPandas().drop_duplicates("cls")
    unit = np.frombuffer(b"".join(seen["unit"]), np.float32).reshape(-1, dim)
    held = spark.sparkContext.broadcast(Buckets(unit, seen["cls"].to_numpy(np.int64), n, curves, dims, bits, seed, window, bucket_rows))

    members = src.mapInArrow(_members(dim), "id long, cls long, asked boolean").distinct()
    heads = members.select("cls", "id").withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("nth") <= k + 1)
    reps = src.mapInArrow(_units(dim), "cls long, unit binary").groupBy("cls").agg(F.first("unit").alias("unit"))
    near, most = floor - ROUNDING if floor > -1 else -1.5, 8 * k
    found = (
        src.mapInArrow(_place(held, dim), "bucket int, pos long, cls long, idle boolean, vec binary")
        .repartition("bucket").sortWithinPartitions("bucket", "pos", "cls", "idle")
        .mapInArrow(_windows(k, most, window, block, near, (dim + 1) // 2), "a long, b long, sim float")
        .groupBy("a", "b").agg(F.max("sim").alias("sim"))
    )
    # Of each side those that reach the k-th but for the rounding go on, as pairs a < b.
    best = Window.partitionBy("x").orderBy(F.desc("sim"), "y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = found.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "sim").select("p.x", "p.y", "sim")
    some = sides.withColumns({"r": F.row_number().over(best), "kth": F.nth_value("sim", k).over(best)}).where(F.col("r") <= most)
    some = some.where(F.coalesce(F.col("sim") >= F.col("kth") - ROUNDING, F.lit(True))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    some = some.repartition("a").dropDuplicates(["a", "b"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64) for c in (2, 3))
            cos = np.minimum((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), 1.0)
            ok = pa.array(cos >= floor)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(cos).filter(ok)], ["a", "b", "cos"])

    exact = (
        some.join(reps.select(F.col("cls").alias("a"), F.col("unit").alias("ua")), "a").join(reps.select(F.col("cls").alias("b"), F.col("unit").alias("ub")), "b")
        .select("a", "b", "ua", "ub").mapInArrow(rerank, "a long, b long, cos double")
    )
    exact = exact.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "cos").select("p.a", "p.b", "cos")
    exact = exact.unionByName(heads.where("nth = 2").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("cos")))
    # Candidates of a class: the first k + 1 members of it and of its neighbour classes; k + 1 as a member isn't its own neighbour.
    options = exact.join(heads.select(F.col("cls").alias("b"), F.col("id").alias("neighbour")), "b")
    top = Window.partitionBy("a").orderBy(F.desc("cos"), "neighbour")
    options = options.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    pairs = members.where("asked").select(F.col("cls").alias("a"), "id").join(options.select("a", "neighbour", "cos", "r"), "a").where("id <> neighbour")
    mine = Window.partitionBy("id").orderBy("r")
    return pairs.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("id", "neighbour", F.col("cos").alias("cosine"), "rank")
