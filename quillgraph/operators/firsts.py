"""Rank of the first target of each held-out item, without a list of all documents for every item."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import _HUMPS, B, FIELD_WEIGHTS, K1, recall_tokens
from quillgraph.session import release, stage

#: Items of one pass over the documents, words a worker remembers, texts and scores held at once.
BLOCK, KNOWN, TEXTS, CELLS = 4096, 500_000, 2048, 1_000_000
_POSTINGS = "path string, wlen double, term array<int>, wtf array<float>, hit array<int>"


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of the ranges [start, start + size)."""
    owner = np.repeat(np.arange(len(start)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner]


def _hashes(windows: np.ndarray) -> np.ndarray:
    """A hash of each row of ids; equal rows have equal hashes."""
    acc = np.zeros(len(windows), np.uint64)
    for k in range(windows.shape[1]):
        acc = (acc ^ (windows[:, k] + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc


class Items:
    """A block of items (item_id, tk): their terms numbered, how often each has each, and the runs that make a document a target."""

    def __init__(self, rows: list[tuple[int, list[str]]], run: int):
        self.ids = sorted({i for i, _ in rows})
        at = {i: k for k, i in enumerate(self.ids)}
        self.terms: dict[str, int] = {}
        put = self.terms.setdefault
        told = [(at[i], np.array([put(t, len(self.terms)) for t in tk], np.int64)) for i, tk in rows if tk]
        key = np.concatenate([t * len(self.ids) + k for k, t in told] or [np.zeros(0, np.int64)])
        key, self.mult = np.unique(key, return_counts=True)
        self.term, self.item = key // max(1, len(self.ids)), key % max(1, len(self.ids))
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, t in told:
            n = min(len(t), run)
            by.setdefault(n, []).append((k, np.lib.stride_tricks.sliding_window_view(t, n)))
        self.runs = {}
        for n, ws in by.items():
            win, who = np.concatenate([w for _, w in ws]), np.repeat([k for k, _ in ws], [len(w) for _, w in ws])
            order = np.argsort(h := _hashes(win))
            self.runs[n] = (h[order], who[order], win[order])

    def targets(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the runs in ``words``, the numbers (-1 for others) of the tokens of all rows one after the other."""
        rows, items = [], []
        for n, (hashes, who, win) in self.runs.items():
            if len(words) < n:
                continue
            here = np.lib.stride_tricks.sliding_window_view(words, n)
            h = _hashes(here)
            first = np.searchsorted(hashes, h)
            maybe = np.nonzero((hashes[np.minimum(first, len(hashes) - 1)] == h) & (row[: len(h)] == row[n - 1 :]))[0]
            owner, at = _spread(first[maybe], np.searchsorted(hashes, h[maybe], "right") - first[maybe])
            same = (here[maybe[owner]] == win[at]).all(axis=1)
            rows.append(row[maybe[owner[same]]])
            items.append(who[at[same]])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.unique(np.concatenate(rows) * len(self.ids) + np.concatenate(items))
        return key // len(self.ids), key % len(self.ids)


class Weights:
    """BM25 of some items of a block from the hits of documents: terms of many items as a matrix, all others as lists."""

    def __init__(self, items: Items, df: np.ndarray, n: int, avg: float, wanted: list[int]):
        self.avg, self.n = avg, len(wanted)
        column = np.full(max(1, len(items.ids)), -1)
        column[wanted] = np.arange(len(wanted))
        own = column[items.item] >= 0
        term, item = items.term[own], column[items.item[own]]
        weight = items.mult[own] * np.log1p((n - df + 0.5) / (df + 0.5))[term] * (K1 + 1)
        size = np.bincount(term, minlength=len(items.terms))
        many = size * 8 > len(wanted)
        self.place = np.where(many, np.cumsum(many) - 1, -1)
        self.matrix = np.zeros((int(many.sum()), len(wanted)))
        self.matrix[self.place[term[many[term]]], item[many[term]]] = weight[many[term]]
        few = ~many[term]
        self.size = np.where(many, 0, size)
        self.first = np.cumsum(self.size) - self.size
        self.item, self.weight = item[few], weight[few]

    def scores(self, length: np.ndarray, term: np.ndarray, wtf: np.ndarray, wlen: np.ndarray) -> np.ndarray:
        """One row a document, one column an item; 0 where they share no term."""
        row = np.repeat(np.arange(len(length)), length)
        part = wtf / (wtf + K1 * (1 - B + B * wlen[row] / self.avg))
        at = self.place[term]
        many = at >= 0
        dense = np.zeros((len(length), len(self.matrix)))
        dense[row[many], at[many]] = part[many]
        owner, at = _spread(self.first[term[~many]], self.size[term[~many]])
        sparse = np.bincount(row[~many][owner] * self.n + self.item[at], part[~many][owner] * self.weight[at], len(length) * self.n)
        return dense @ self.matrix + sparse.reshape(len(length), self.n)

    def each(self, b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores) of slices of a batch (path, wlen, term, wtf, hit)."""
        step = max(1, CELLS // max(self.n, len(self.matrix), 1))
        for k in range(0, b.num_rows, step):
            c = b.slice(k, step)
            length = c.column(2).value_lengths().to_numpy(zero_copy_only=False)
            term, wtf = (c.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            yield k, self.scores(length, term, wtf.astype(np.float64), c.column(1).to_numpy(zero_copy_only=False))


def _postings(docs: DataFrame, held) -> DataFrame:
    """(path, wlen, term, wtf, hit) of each document with a token: weighted length, numbers and frequencies of the items' terms, and the items it is a target of.

    ASCII texts, whose tokens are their humps, are cut by the workers; the tokens of all others come from ``recall_tokens``.
    """

    def other(f: str) -> Column:
        return F.when(F.octet_length(f) != F.length(f), recall_tokens(F.col(f)))

    fields = ["body", *(f for f in FIELD_WEIGHTS if f != "body")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, humps = held.value, re.compile(_HUMPS).findall

        class Codes(dict):
            """Number of a token as it stands: -1 if no item has it, -2 if it is too short to be one."""

            def __missing__(self, t: str) -> int:
                n = items.terms.get(t.lower() if t.isascii() else t, -1) if len(t) > 1 else -2
                if len(self) < KNOWN:
                    self[t] = n
                return n

        code = Codes().__getitem__
        for b in (x.slice(k, TEXTS) for x in batches for k in range(0, x.num_rows, TEXTS)):
            m = b.num_rows
            wlen, keys, weight, hit = np.zeros(m), [], [], (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for k, f in enumerate(fields):
                texts, others = b.column(k + 1).to_pylist(), b.column(k + 1 + len(fields)).to_pylist()
                told = [list(map(code, humps(t or "") if o is None else o)) for t, o in zip(texts, others)]
                size = np.fromiter(map(len, told), np.int64, m)
                words = np.fromiter((x for ws in told for x in ws), np.int64, int(size.sum()))
                row = np.repeat(np.arange(m), size)
                row, words = row[words > -2], words[words > -2]
                wlen += np.bincount(row, minlength=m) * FIELD_WEIGHTS[f]
                if f == "body":
                    hit = items.targets(words, row)
                keys.append(row[words >= 0] * len(items.terms) + words[words >= 0])
                weight.append(np.full(len(keys[-1]), FIELD_WEIGHTS[f]))
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            row = key // max(1, len(items.terms))
            wtf = np.bincount(back, np.concatenate(weight), len(key)).astype(np.float32)
            ends, hits = (np.searchsorted(r, np.arange(m + 1)).astype(np.int32) for r in (row, hit[0]))
            term = pa.ListArray.from_arrays(pa.array(ends), pa.array((key % max(1, len(items.terms))).astype(np.int32)))
            cols = [b.column(0), pa.array(wlen), term, pa.ListArray.from_arrays(pa.array(ends), pa.array(wtf)), pa.ListArray.from_arrays(pa.array(hits), pa.array(hit[1].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, ["path", "wlen", "term", "wtf", "hit"]).filter(pa.array(wlen > 0))

    return docs.select(F.col("path").alias("key"), *fields, *[other(f).alias(f"t_{f}") for f in fields]).mapInArrow(run, _POSTINGS)


def _one_each(once: DataFrame) -> DataFrame:
    """Staged postings with one row a path: those of one path are one document."""
    keyed = once.withColumn("h", F.xxhash64("path"))
    again = stage(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    if again.isEmpty():
        release(again)
        return once
    rows = keyed.join(again, "h", "left_semi")
    cells = rows.select("path", F.explode(F.arrays_zip("term", "wtf")).alias("x")).groupBy("path", F.col("x.term").alias("term")).agg(F.sum("x.wtf").alias("wtf"))
    lists = cells.groupBy("path").agg(F.collect_list(F.struct("term", "wtf")).alias("x"))
    heads = rows.groupBy("path").agg(F.sum("wlen").alias("wlen"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"))
    x = F.coalesce("x", F.array().cast("array<struct<term:int,wtf:double>>"))
    merged = heads.join(lists, "path", "left").select("path", "wlen", F.transform(x, lambda e: e.term).alias("term"), F.transform(x, lambda e: e.wtf.cast("float")).alias("wtf"), "hit")
    whole = stage(keyed.join(again, "h", "left_anti").drop("h").unionByName(merged), "postings")
    release(once, again)
    return whole


def _block(docs: DataFrame, rows: list[tuple[int, list[str]]], run: int) -> list[tuple[int, int]]:
    """(item_id, first) of the items of one block that have a target."""
    context, items = docs.sparkSession.sparkContext, Items(rows, run)
    if not items.terms:
        return []
    held = context.broadcast(items)
    once = _one_each(stage(_postings(docs, held), "postings"))
    n, total = once.agg(F.count("*"), F.sum("wlen")).first()
    df = np.zeros(len(items.terms))
    for r in once.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]
    targets = once.where(F.size("hit") > 0)
    wanted = sorted(r["k"] for r in targets.select(F.explode("hit").alias("k")).distinct().collect())
    found: list[tuple[int, int]] = []
    if wanted:
        weights = context.broadcast(Weights(items, df, n, total / n, wanted))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            column = {k: c for c, k in enumerate(wanted)}
            for b in batches:
                for at, s in weights.value.each(b):
                    hit = b.column(4).slice(at, len(s)).to_pylist()
                    pairs = [(r, column[k]) for r, ks in enumerate(hit) for k in ks]
                    r, c = np.array(pairs, np.int64).reshape(-1, 2).T
                    yield pa.RecordBatch.from_arrays([pa.array(c), b.column(0).take(pa.array(r + at)), pa.array(np.round(s[r, c], 6))], ["item", "path", "s"])

        top = targets.mapInArrow(own, "item long, path string, s double").groupBy("item").agg(F.min(F.struct((-F.col("s")).alias("s"), "path")).alias("b"))
        best = {r["item"]: (-r["b"]["s"], r["b"]["path"]) for r in top.collect()}
        least, path = np.array([best[c][0] for c in range(len(wanted))]), pa.array([best[c][1] for c in range(len(wanted))])

        def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            many = np.zeros(len(wanted), np.int64)
            for b in batches:
                for at, s in weights.value.each(b):
                    above = np.round(s, 6) - least
                    many += (above > 1.5e-6).sum(axis=0)
                    r, c = np.nonzero((np.abs(above) <= 1.5e-6) & (s > 0))  # names count where scores are equal, and the target itself never does
                    names, mine = b.column(0).take(pa.array(r + at)), path.take(pa.array(c))
                    before = np.where(above[r, c] > 5e-7, pc.not_equal(names, mine).to_numpy(zero_copy_only=False), (above[r, c] > -5e-7) & pc.less(names, mine).to_numpy(zero_copy_only=False))
                    many += np.bincount(c[before], minlength=len(wanted))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wanted))), pa.array(many)], ["item", "n"])

        counts = once.mapInArrow(ahead, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).collect()
        found = [(items.ids[wanted[r["item"]]], r["n"] + 1) for r in counts]
        weights.destroy()
    held.destroy()
    release(once)
    return found


def first_ranks(items: DataFrame, docs: DataFrame, run: int, block: int = BLOCK) -> DataFrame:
    """(item_id, suite, first): the BM25 rank of the first target of each item (item_id, suite, text), null if it has none.

    Targets are the documents whose body holds any ``run`` tokens in a row of the item, or all of a shorter one. The best target of an item is known from
    its own score, so its rank is one more than the number of documents that come before it: those are counted where they are read, and no score
    of the others is moved or sorted. The driver reads the tokens of ``block`` items at a time; each block is a pass over the texts, of which a length and the hits of
    the block's terms are kept. Rows of one path are one document, rows of one item_id one query.
    """
    spark = docs.sparkSession
    found: list[tuple[int, int]] = []
    rows: list[tuple[int, list[str]]] = []
    seen: set[int] = set()
    for r in items.where("item_id is not null").select("item_id", recall_tokens(F.col("text")).alias("tk")).sort("item_id").toLocalIterator():
        if len(seen) == block and r["item_id"] not in seen:
            found += _block(docs, rows, run)
            rows, seen = [], set()
        rows.append((r["item_id"], r["tk"]))
        seen.add(r["item_id"])
    found += _block(docs, rows, run)
    first = spark.createDataFrame(found, "item_id long, first int")
    return items.select("item_id", "suite").distinct().join(first, "item_id", "left")
