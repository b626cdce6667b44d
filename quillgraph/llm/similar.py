"""Problem 1: near-duplicate texts by an exact set-similarity join that skips by set relations.

A text is the set of its runs of consecutive words, each hashed to 48 bits. Elements have one
global order: those found often come last (a bounded table of counts), the others by hash. Two sets
with Jaccard similarity t or more share at least ``depth`` elements of their prefixes, so only
prefixes are indexed. Set relations are used at three places:

* equal sets are one set: copies take the answers of their class;
* sets of one size with one prefix have the same candidates: they share one index entry, and a
  member derives its candidates from those computed for the entry (plus its fellows);
* an index list is sorted by (size, position) and read in blocks of one size: the first position of
  a block that can't reach the overlap any more skips the rest of the block, and the read goes on at
  the next block until sizes are out of range.

No task holds or pairs a whole hot list. The lists of elements counted as frequent are spread over
salted sub-lists before they are shuffled; a list that turns out long all the same is not paired where
it is read but cut into cells of one length, and pairs of cells whose sizes can meet go to tasks of
their own. Candidates are verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import mix64, words
from quillgraph.session import stage

_MASK = np.uint64((1 << 48) - 1)
_WORDS: dict[str, int] = {}


def _word_hash(w: str) -> int:
    h = _WORDS.get(w)
    if h is None:
        if len(_WORDS) > 1_000_000:
            _WORDS.clear()
        h = _WORDS[w] = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
    return h


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the runs of ``width`` words of a text."""
    ws = words(text)
    if len(ws) < width:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash, ws), np.uint64, len(ws))
    with np.errstate(over="ignore"):
        acc = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            acc = mix64(acc) + h[k : len(h) - width + 1 + k]
        return np.unique(mix64(acc) & _MASK)


def pack(values: np.ndarray) -> bytes:
    """48-bit values as 6 bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.reshape(-1).view("<u8")


def _sets(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sids, sizes, grams = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingle_set(t, width)
                if len(s) >= least:
                    raw = pack(s)
                    ids.append(i)
                    sids.append(int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True))
                    sizes.append(len(s))
                    grams.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(grams, pa.binary())], ["id", "sid", "n", "grams"])

    return run


def _often(floor: int, most: int):
    """Elements that a task finds ``floor`` times or more, the ``most`` frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vals, cnts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            six = unpack(b"".join(b.column(0).to_pylist()))
            v, c = np.unique(six, return_counts=True)
            both = np.concatenate([vals, v])
            vals, inv = np.unique(both, return_inverse=True)
            cnts = np.bincount(inv, weights=np.concatenate([cnts, c]), minlength=len(vals)).astype(np.int64)
            if len(vals) > 4_000_000:
                keep = cnts > 1
                vals, cnts = vals[keep], cnts[keep]
        keep = cnts >= floor
        vals, cnts = vals[keep], cnts[keep]
        if len(vals) > most:
            top = np.argpartition(-cnts, most)[:most]
            vals, cnts = vals[top], cnts[top]
        yield pa.RecordBatch.from_arrays([pa.array(vals.astype(np.int64)), pa.array(cnts)], ["token", "cnt"])

    return run


class _Order:
    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def count(self, values: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, values), len(self.tokens) - 1)
        return np.where(self.tokens[at] == values, self.counts[at], 0)


def _prefixes(batch: pa.RecordBatch, o: _Order, t: float, depth: int):
    """Of the sets (sid, n, grams) of a batch: pid of each, and set number, element, position, count of each prefix element."""
    n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    v = unpack(b"".join(batch.column(2).to_pylist()))
    who = np.repeat(np.arange(len(n)), n)
    cnt = o.count(v)
    by = np.lexsort((v, cnt, who))
    at = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
    p = np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + depth)
    take = at < p[who]
    pre, cnt, who, at = v[by][take], cnt[by][take], who[take], at[take]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix64(pre + np.uint64(1)), np.cumsum(p) - p) if len(n) else np.zeros(0, np.uint64)
        pid = mix64(mix64(sums) + n.astype(np.uint64)).view(np.int64)
    return n, pid, who, pre.astype(np.int64), at, cnt


def _relation(order, t: float, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_prefixes(b, order.value, t, depth)[1]), b.column(0)], ["pid", "sid"])

    return run


def _postings(order, t: float, depth: int, cell: int):
    """Index entries (token, pair of sub-lists, size and position, pid, own sub-list) of the prefix classes of a batch.

    An element counted ``cell`` times or more has as many sub-lists as its count needs, and an entry goes to each
    pair of sub-lists with its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, pid, who, pre, at, cnt = _prefixes(b, order.value, t, depth)
            first = np.zeros(len(n), bool)
            first[np.unique(pid, return_index=True)[1]] = True
            use = first[who]
            who, pre, at, cnt = who[use], pre[use], at[use], cnt[use]
            m = np.maximum(1, -(-cnt // cell))
            own = (pid[who].view(np.uint64) % m.astype(np.uint64)).astype(np.int64)
            k = np.repeat(np.arange(len(m)), m)
            other = np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)
            sub = (np.minimum(own[k], other) << 32) | np.maximum(own[k], other)
            yield pa.RecordBatch.from_arrays([pa.array(pre[k]), pa.array(sub), pa.array((n[who[k]] << 32) | at[k]), pa.array(pid[who[k]]), pa.array(own[k])], ["token", "sub", "np", "pid", "own"])

    return run


def list_pairs(tok: np.ndarray, size: np.ndarray, pos: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of entries of one list that can still reach similarity ``t``.

    Entries are sorted by (tok, size, pos). Each round, every probe reads one block (one token, one
    size) up to the first position that can't reach the overlap, then skips to the next block.
    """
    n = len(tok)
    new_block = np.ones(n, bool)
    new_block[1:] = (tok[1:] != tok[:-1]) | (size[1:] != size[:-1])
    block = np.cumsum(new_block) - 1
    starts = np.append(np.nonzero(new_block)[0], n)
    width = int(pos.max()) + 2 if n else 1
    rank = block * width + pos
    probe, left, right = np.arange(n), [], []
    cur = probe + 1
    while len(probe):
        ok = cur < n
        ok[ok] &= tok[cur[ok]] == tok[probe[ok]]
        ok[ok] &= t * size[cur[ok]] <= size[probe[ok]] + 1e-9
        probe, cur = probe[ok], cur[ok]
        if not len(probe):
            break
        s, u, p = size[probe], size[cur], pos[probe]
        need = np.ceil(t / (1 + t) * (s + u) - 1e-9).astype(np.int64)
        # q <= p: q + 1 + min(s-p-1, u-q-1) >= need;  q > p: p + 1 + min(s-p-1, u-q-1) >= need
        low = np.maximum(0, need - s + p)
        high = np.where(u >= need, p + u - need, -1)
        b = block[cur]
        end = np.searchsorted(rank, b * width + np.minimum(high, width - 2), side="right")
        begin = np.maximum(cur, np.searchsorted(rank, b * width + np.minimum(low, width - 1), side="left"))
        take = np.maximum(0, end - begin)
        total = int(take.sum())
        if total:
            left.append(np.repeat(probe, take))
            right.append(np.arange(total) - np.repeat(np.cumsum(take) - take, take) + np.repeat(begin, take))
        cur = starts[b + 1]
    none = np.zeros(0, np.int64)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


#: Columns of an index entry, and of what reading lists gives: pairs (a, b), or with ``own`` set the entries of a cell.
_ENTRY = "token long, sub long, np long, pid long, own long"
_READ = "a long, b long, token long, sub long, own long, np long"


def _paired(key: list[np.ndarray], np_: np.ndarray, pid: np.ndarray, own: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of pids of whole lists (entries of equal key) sorted by key, size and position."""
    new = np.ones(len(pid), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    tok = np.cumsum(new)
    alone = new.copy()
    alone[:-1] &= new[1:]
    keep = ~alone
    tok, np_, pid, own, sub = tok[keep], np_[keep], pid[keep], own[keep], key[1][keep]
    i, j = list_pairs(tok, np_ >> 32, np_ & 0xFFFFFFFF, t)
    low, high = sub[i] >> 32, sub[i] & 0xFFFFFFFF
    # In a pair of two sub-lists only pairs across them count; in a diagonal one all do.
    ok = (pid[i] != pid[j]) & ((low == high) | (own[i] != own[j]))
    return pid[i[ok]], pid[j[ok]]


def _probe(t: float, cell: int):
    """Read lists sorted by (token, sub, np, pid). Short ones are paired; of a long one (over ``cell`` entries) the
    entries are handed on, numbered by cells of ``cell`` entries in their order."""

    def out(a, b, token, sub, own, np_):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, token, sub, own, np_)], ["a", "b", "token", "sub", "own", "np"])

    def pairs(cols):
        a, b = _paired(cols[:2], *cols[2:], t)
        none = np.full(len(a), -1)
        return out(np.minimum(a, b), np.maximum(a, b), none, none, none, none)

    def entries(cols, at):
        # Both ends of ``sub`` and the own sub-list matter for which pairs count, so cells are cut within them.
        return out(cols[3], cols[4], cols[0], cols[1], (at + np.arange(len(cols[0]))) // cell, cols[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_key, at = None, None, 0
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if not len(now[0]):
                continue
            if long_key is not None:
                same = (now[0] == long_key[0]) & (now[1] == long_key[1])
                n = int(same.sum())
                if n:
                    yield entries([x[:n] for x in now], at)
                    at += n
                    now = [x[n:] for x in now]
                if not len(now[0]):
                    continue
                long_key = None
            if held is not None:
                now = [np.concatenate([h, x]) for h, x in zip(held, now)]
            new = np.ones(len(now[0]), bool)
            new[1:] = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])
            start = np.nonzero(new)[0]
            size = np.diff(np.append(start, len(new)))
            big = np.repeat(size > cell, size)
            last = start[-1]
            whole = ~big
            whole[last:] = False  # the last list may go on
            if whole.any():
                yield pairs([x[whole] for x in now])
            for k in np.nonzero(size > cell)[0]:
                part = slice(start[k], start[k] + size[k])
                yield entries([x[part] for x in now], 0)
            if size[-1] > cell:
                long_key, at, held = (now[0][last], now[1][last]), int(size[-1]), None
            else:
                held = [x[last:] for x in now]
        if held is not None and len(held[0]):
            yield pairs(held)

    return run


def _cell_pairs(t: float):
    """Pairs of pids of pairs of cells: rows (key, np, pid, own, side) sorted by (key, np, pid); side 2 is a cell with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if held is not None:
                now = [np.concatenate([h, x]) for h, x in zip(held, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
            held = [x[cut:] for x in now]
            if cut:
                yield pairs([x[:cut] for x in now])
        if held is not None and len(held[0]):
            yield pairs(held)

    def pairs(cols):
        key, sub, np_, pid, own, side = cols
        i, j = list_pairs(key, np_ >> 32, np_ & 0xFFFFFFFF, t)
        low, high = sub[i] >> 32, sub[i] & 0xFFFFFFFF
        ok = (pid[i] != pid[j]) & ((low == high) | (own[i] != own[j])) & ((side[i] == 2) | (side[i] != side[j]))
        a, b = pid[i[ok]], pid[j[ok]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _verify(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1 << 12):
                part = b.slice(s, 1 << 12)
                ra, rb = part.column(2).to_pylist(), part.column(3).to_pylist()
                na, nb = (np.fromiter(map(len, r), np.int64, len(r)) // 6 for r in (ra, rb))
                k = np.arange(len(ra), dtype=np.uint64) << np.uint64(48)
                # Pair number and element in one key: both sides are sorted, and what both hold comes twice.
                both = np.concatenate([unpack(b"".join(r)) | np.repeat(k, n) for r, n in ((ra, na), (rb, nb))])
                both.sort(kind="stable")
                shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(48)).astype(np.int64), minlength=len(ra))
                sim = shared / np.maximum(1, na + nb - shared)
                ok = pa.array(sim >= t)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok), pa.array(sim).filter(ok)], ["sa", "sb", "sim"])

    return run


class SimilarSets:
    """The parts of one similarity join: ``members`` (id, sid) and ``links`` (sa, sb, sim), sa < sb,
    between different sets."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """(a, b, sim), a < b, every pair of different ids; equal sets count with 1. The size of this
        relation is that of its result; for groups of copies use ``classes``."""
        m = self.members
        across = self.links.join(m.select(F.col("id").alias("x"), F.col("sid").alias("sa")), "sa").join(m.select(F.col("id").alias("y"), F.col("sid").alias("sb")), "sb")
        across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")
        same = m.select(F.col("id").alias("a"), "sid").join(m.select(F.col("id").alias("b"), "sid"), "sid").where("a < b")
        return across.unionByName(same.select("a", "b", F.lit(1.0).alias("sim"))).where("a <> b").distinct()

    def classes(self) -> DataFrame:
        """(id, class_id, n_copies, n_links): class = smallest id with the same set, links = similar other classes."""
        head = self.members.groupBy("sid").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
        ends = self.links.select(F.col("sa").alias("sid")).unionAll(self.links.select(F.col("sb").alias("sid")))
        deg = ends.groupBy("sid").agg(F.count("*").alias("n_links"))
        return self.members.join(head.join(deg, "sid", "left"), "sid").select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _long_lists(read: DataFrame, t: float) -> DataFrame:
    """(a, b) of the entries of long lists: each cell meets itself and those whose sizes can meet its own, each pair of
    cells in a task of its own."""
    e = read.where("own >= 0").select("token", "sub", F.col("own").alias("cell"), "np", F.col("a").alias("pid"), F.col("b").alias("own"))
    size = F.shiftright("np", 32)
    cells = e.groupBy("token", "sub", "cell").agg(F.min(size).alias("lo"), F.max(size).alias("hi"))
    y = cells.select("token", "sub", F.col("cell").alias("y"), F.col("lo").alias("ylo"))
    met = cells.withColumnRenamed("cell", "x").join(y, ["token", "sub"]).where((F.col("x") <= F.col("y")) & (F.lit(t) * F.col("ylo") <= F.col("hi") + 1e-9))
    met = met.select("token", "sub", "x", "y", F.xxhash64("token", "sub", "x", "y").alias("key"))
    left = e.join(met.withColumnRenamed("x", "cell"), ["token", "sub", "cell"]).select("key", "sub", "np", "pid", "own", F.when(F.col("cell") == F.col("y"), 2).otherwise(0).cast("long").alias("side"))
    right = e.join(met.where("x < y").withColumnRenamed("y", "cell"), ["token", "sub", "cell"]).select("key", "sub", "np", "pid", "own", F.lit(1).cast("long").alias("side"))
    rows = left.unionByName(right).repartition("key").sortWithinPartitions("key", "np", "pid")
    return rows.mapInArrow(_cell_pairs(t), "a long, b long")


def _fellow_pairs(related: DataFrame, cell: int) -> DataFrame:
    """(x, y), x < y, of the sets of one prefix class; a large class is met in pairs of sub-classes of about ``cell`` sets."""
    many = related.groupBy("pid").agg(F.count("*").alias("n")).where("n > 1").select("pid", F.ceil(F.col("n") / cell).cast("int").alias("m"))
    r = related.join(many, "pid").withColumn("u", F.pmod(F.xxhash64("sid"), F.col("m")).cast("int"))
    left = r.select("pid", F.col("sid").alias("x"), "u", F.explode(F.sequence("u", F.col("m") - 1)).alias("v"))
    right = r.select("pid", F.col("sid").alias("y"), F.col("u").alias("v"), F.explode(F.sequence(F.lit(0), "u")).alias("u"))
    return left.join(right, ["pid", "u", "v"]).where("u < v or x < y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def similar_sets(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, least: int = 1, depth: int = 3, order_size: int = 1 << 17, often: int = 4, cell: int = 4096) -> SimilarSets:
    """All pairs of texts whose sets of ``width``-word runs have Jaccard similarity ``threshold`` or more.

    Sets under ``least`` elements take no part; so don't null or empty texts. Redelivered ids count
    once. Exact up to collisions of 48-bit hashes within a pair. ``order_size`` bounds the table of
    frequent elements that is broadcast (16 bytes each); it orders elements and spreads the longest lists, so
    results don't depend on it. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    depth = max(1, min(depth, int(np.ceil(threshold * max(1, least) - 1e-9))))
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    sets = stage(src.mapInArrow(_sets(width, max(1, least)), "id long, sid long, n int, grams binary"), "p1-sets", "none")
    members = sets.select("id", "sid").distinct()
    counts = sets.select("grams").mapInArrow(_often(often, order_size), "token long, cnt long").groupBy("token").agg(F.sum("cnt").alias("cnt"))
    top = counts.orderBy(F.desc("cnt"), "token").limit(order_size).toPandas()
    order = spark.sparkContext.broadcast(_Order(top["token"].to_numpy(np.uint64), top["cnt"].to_numpy(np.int64)))
    keyed = sets.select("sid", "n", "grams")
    related = stage(keyed.mapInArrow(_relation(order, threshold, depth), "pid long, sid long").distinct(), "p1-classes")
    lists = keyed.mapInArrow(_postings(order, threshold, depth, cell), _ENTRY)
    lists = lists.repartition("token", "sub").sortWithinPartitions("token", "sub", "np", "pid")
    read = stage(lists.mapInArrow(_once(_probe(threshold, cell)), _READ), "p1-read")
    hits = read.where("own < 0").select("a", "b").unionByName(_long_lists(read, threshold)).groupBy("a", "b").count().where(F.col("count") >= depth)
    across = hits.join(related.select(F.col("pid").alias("a"), F.col("sid").alias("x")), "a").join(related.select(F.col("pid").alias("b"), F.col("sid").alias("y")), "b").select("x", "y")
    cand = across.unionByName(_fellow_pairs(related, cell)).select(F.least("x", "y").alias("sa"), F.greatest("x", "y").alias("sb")).where("sa <> sb").distinct()
    cand = stage(cand, "p1-candidates")
    asked = cand.select(F.col("sa").alias("sid")).unionAll(cand.select(F.col("sb").alias("sid"))).distinct()
    full = sets.select("sid", "grams").join(asked, "sid", "left_semi").groupBy("sid").agg(F.first("grams").alias("grams"))
    joined = cand.join(full.select(F.col("sid").alias("sb"), F.col("grams").alias("gb")), "sb").join(full.select(F.col("sid").alias("sa"), F.col("grams").alias("ga")), "sa")
    links = joined.select("sa", "sb", "ga", "gb").mapInArrow(_verify(threshold), "sa long, sb long, sim double")
    return SimilarSets(members, links)


def _once(run):
    """Drop repeated rows of a sorted stream (one prefix class indexed by several tasks)."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            new = np.zeros(b.num_rows, bool)
            new[0] = last != tuple(c[0] for c in cols)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            last = tuple(c[-1] for c in cols)
            yield b.filter(pa.array(new))

    return lambda batches: run(only(batches))
