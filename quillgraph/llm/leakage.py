"""Problem 9: evaluation passages inside a corpus, by a BM25 inverted index with block-max WAND.

The index holds the test items; every passage of every training text is a query against it. The
threshold of an item is the smallest BM25 sum that any run of ``run_words`` of its words can have, so
a passage that holds such a run always reaches it and nothing is missed. A run has only words of
items, so passages are cut from stretches of such words; they overlap so that every run lies whole in
one of them. For each passage

* its terms are put in order of the most they can give. Terms up to the pivot, which together stay
  under the lowest threshold, can't lift an item over it: their lists are skipped, and only items in
  the lists from the pivot on are candidates, if what those give and the others can give is enough;
* a candidate's block (``block`` neighbouring items) is opened only if the block maxima of all the
  passage's terms reach the candidate's threshold;
* in open blocks the candidate's weights are looked up and summed.

Of the items at their threshold the run itself is then verified. Lists and block maxima are sparse
(term after term, items in order) and the steps run over all passages of a batch at once.

Only the test items are broadcast, in shards of a bounded number of words; a larger test set takes
more shards, each a further pass over the corpus, and never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import mix64, words

K1, B = 1.2, 0.75


def _run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` ids; runs of equal ids have equal hashes."""
    x = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(x) - n + 1), np.uint64)
        for k in range(n):
            acc = mix64(acc + x[k : k + len(acc)])
    return acc


def _with_item(hashes: np.ndarray, item: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(hashes + (item + np.int64(1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of the ranges [start, start + size)."""
    owner = np.repeat(np.arange(len(start)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of sorted keys, 0 where a key isn't there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return np.where(keys[at] == wanted, values[at], np.float32(0)) if len(keys) else np.zeros(len(wanted), np.float32)


class ItemIndex:
    """Inverted lists of one shard of items (id, words), with block maxima."""

    def __init__(self, items: list[tuple[int, list[str]]], run_words: int, block: int = 16):
        self.run, self.block = run_words, block
        items = sorted((i for i in items if len(i[1]) >= run_words), key=lambda i: len(i[1]))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.terms: dict[str, int] = {}
        put = self.terms.setdefault
        told = [np.array([put(w, len(self.terms)) for w in ws], np.int64) for _, ws in items]
        n, m = len(items), max(1, len(self.terms))
        self.size = np.array([len(t) for t in told], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.concatenate([*told, np.zeros(0, np.int64)])
        # Lists: one entry for each term and item, in order of the term and then of the item.
        self.n, self.n_blocks = max(1, n), max(1, -(-n // block))
        self.keys, tf = np.unique(self.words * self.n + np.repeat(np.arange(n), self.size), return_counts=True)
        term, item = self.keys // self.n, self.keys % self.n
        df = np.bincount(term, minlength=m)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * self.size / max(1.0, self.size.mean() if n else 1.0))
        self.weights = (idf[term] * tf * (K1 + 1) / (tf + norm[item])).astype(np.float32)
        self.first = np.searchsorted(term, np.arange(m + 1))
        self.most = np.zeros(m, np.float32)
        np.maximum.at(self.most, term, self.weights)
        self.block_keys, at = np.unique(term * self.n_blocks + item // block, return_inverse=True)
        self.block_max = np.zeros(len(self.block_keys), np.float32)
        np.maximum.at(self.block_max, at, self.weights)
        # Thresholds and runs. Rounding of sums is allowed for.
        self.need, runs = np.zeros(n, np.float32), [np.zeros(0, np.uint64)]
        for k, t in enumerate(told):
            weight = _find(self.keys, self.weights, t * self.n + k)
            win = np.lib.stride_tricks.sliding_window_view(np.arange(len(t)), run_words)
            ids = t[win]
            order = np.argsort(ids, axis=1, kind="stable")
            new = np.ones(ids.shape, bool)
            ranked = np.take_along_axis(ids, order, 1)
            new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
            self.need[k] = (np.take_along_axis(weight[win], order, 1) * new).sum(axis=1).min() * (1 - 1e-4)
            runs.append(_with_item(_run_hashes(t, run_words), np.int64(k)))
        self.runs = np.unique(np.concatenate(runs))
        self.least = float(self.need.min()) if n else np.inf

    def search(self, texts: list[list[str]], passage: int) -> list[tuple[int, int]]:
        """(text, item id) of every item of which a text (its words) holds a run."""
        run, get = self.run, self.terms.get
        step = passage - run + 1
        known = [np.fromiter([get(w, -1) for w in ws], np.int64, len(ws)) for ws in texts]
        if not len(self.ids) or not known:
            return []
        none = np.full(1, -1)
        flat = np.concatenate([x for k in known for x in (k, none)])  # an unknown word ends each text
        size = np.array([len(k) + 1 for k in known], np.int64)
        edge = np.diff((flat >= 0).astype(np.int8), prepend=0)
        begin, end = np.nonzero(edge > 0)[0], np.nonzero(edge < 0)[0]
        begin, end = begin[end - begin >= run], end[end - begin >= run]
        stretch, nth = _spread(np.zeros(len(begin), np.int64), -(-(end - begin - run + 1) // step))
        text = np.searchsorted(np.cumsum(size), begin, "right")[stretch]
        begin, end = begin[stretch] + nth * step, np.minimum(begin[stretch] + nth * step + passage, end[stretch])
        if not len(begin):
            return []
        # The distinct terms of each passage, by what they can give at most.
        p, at = _spread(begin, end - begin)
        m = len(self.most)
        key = np.unique(p * m + flat[at])
        p, term = key // m, key % m
        order = np.lexsort((self.most[term], p))
        p, term = p[order], term[order]
        most = self.most[term].astype(np.float64)
        total = np.cumsum(most)
        cut = np.searchsorted(p, np.arange(len(begin) + 1))  # the terms of passage k: cut[k] to cut[k + 1]
        before = np.concatenate([[0.0], total])[cut[:-1]]
        essential = np.nonzero(total - before[p] >= self.least)[0]  # from the pivot on
        if not len(essential):
            return []
        owner, at = _spread(self.first[term[essential]], np.diff(self.first)[term[essential]])
        cand, back = np.unique(p[essential][owner] * self.n + self.keys[at] % self.n, return_inverse=True)
        cp, item = cand // self.n, cand % self.n
        # What the essential terms give, and the others can give at most.
        given = np.bincount(back, self.weights[at])
        rest = np.bincount(p, most, len(begin)) - np.bincount(p[essential], most[essential], len(begin))
        keep = given + rest[cp] >= self.need[item]
        cp, item = cp[keep], item[keep]

        def sums(passages: np.ndarray, where: np.ndarray, keys: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
            owner, at = _spread(cut[passages], cut[passages + 1] - cut[passages])
            return np.bincount(owner, _find(keys, values, term[at] * width + where[owner]), len(passages))

        opened, back = np.unique(cp * self.n_blocks + item // self.block, return_inverse=True)
        bound = sums(opened // self.n_blocks, opened % self.n_blocks, self.block_keys, self.block_max, self.n_blocks)[back]
        keep = bound >= self.need[item]
        cp, item = cp[keep], item[keep]
        keep = sums(cp, item, self.keys, self.weights, self.n) >= self.need[item]
        found = set()
        cp, item = cp[keep], item[keep]
        for k, i, s in self._runs(flat, begin[cp], end[cp], item):
            hit = (int(text[cp[k]]), i)
            if hit not in found and self._holds(flat[s : s + run], i):
                found.add(hit)
        return [(t, int(self.ids[i])) for t, i in found]

    def _runs(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(candidate, item, start) where a run of a passage has the hash of a run of the candidate item."""
        hashes = _run_hashes(flat, self.run)
        cand, at = _spread(begin, end - begin - self.run + 1)
        key = _with_item(hashes[at], item[cand])
        there = np.minimum(np.searchsorted(self.runs, key), len(self.runs) - 1)
        for x in np.nonzero(self.runs[there] == key)[0].tolist():
            yield int(cand[x]), int(item[cand[x]]), int(at[x])

    def _holds(self, part: np.ndarray, item: int) -> bool:
        """Whether a run stands in the item, word for word."""
        own = self.words[self.start[item] : self.start[item] + self.size[item]]
        return bool((np.lib.stride_tricks.sliding_window_view(own, self.run) == part).all(axis=1).any())


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run_words: int = 12, passage_words: int = 60, shard_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id): at least ``run_words`` consecutive words of the item stand so in the text.

    Null and empty texts and items under ``run_words`` words give no rows. Repeated documents or
    items count once by id. The items are read by the driver in shards of at most ``shard_words``
    words or one longer item; an index takes up to about 60 bytes a word, so a broadcast is at most about 60 MB.
    """
    if passage_words < 2 * run_words:
        raise ValueError("a passage must hold two runs at least")
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    out, shard, size = None, [], 0

    def scan(shard: list[tuple[int, list[str]]]) -> DataFrame:
        index = spark.sparkContext.broadcast(ItemIndex(shard, run_words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                part, size = [], 0
                for k, t in enumerate(texts):  # groups of about a million characters bound the memory
                    part.append((ids[k], words(t)))
                    size += len(t)
                    if size > 1_000_000 or k + 1 == len(texts):
                        hits = ix.search([w for _, w in part], passage_words)
                        if hits:
                            yield pa.RecordBatch.from_arrays([pa.array([part[d][0] for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], ["doc_id", "item_id"])
                        part, size = [], 0

        return src.mapInArrow(run, "doc_id long, item_id long")

    for r in rows.orderBy("i", "t").toLocalIterator():
        ws = words(r.t)
        if shard and size + len(ws) > shard_words:
            out, shard, size = scan(shard) if out is None else out.unionAll(scan(shard)), [], 0
        shard.append((r.i, ws))
        size += len(ws)
    last = scan(shard)
    return (last if out is None else out.unionAll(last)).distinct()
