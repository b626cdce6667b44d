"""Problem 5: records that differ only in formatting, by progressive partition refinement.

Two records are copies if their texts hold the same words the same number of times.
Level 1 splits all records by two cheap invariants of that relation, the length of the text
stripped to letters and digits and the histogram of those characters. Level 2 computes the
costly key, a digest of the sorted words, only inside level-1 classes that have two different
members. Every aggregate is combined on the map side, so a class with a third of all rows
sends one row per task, and no class is ever gathered in one place.

Level 2 reads the texts again and drops those of other classes where they are read, by a filter of a
fixed number of bits that the classes set; what passes is met with the classes themselves. The filter
only saves shuffled bytes: with more classes than bits it lets more pass, and results are the same.
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

_KEEP = bytes(c for c in range(128) if chr(c).isalnum())
_DROP = bytes(c for c in range(256) if c not in _KEEP and c < 128)
_LOWER = bytes(range(256)).lower()
_WEIGHT = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _stripped(text: str) -> bytes:
    if text.isascii():
        return text.encode().translate(_LOWER, _DROP)
    return "".join(words(text)).encode()


def cheap_invariants(text: str) -> tuple[int, int]:
    """(stripped length in bytes, digest of the character histogram) of a text."""
    raw = _stripped(text)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.uint64)
    with np.errstate(over="ignore"):
        return len(raw), int((hist * _WEIGHT).sum().view(np.int64))


def costly_key(text: str, min_words: int) -> bytes | None:
    """Digest of the sorted words, or None below ``min_words``."""
    found = words(text)
    if len(found) < min_words:
        return None
    found.sort()
    return blake2b("\n".join(found).encode(), digest_size=16).digest()


#: Bits of the filter (2 MB), and how many of them a class sets.
FILTER_BITS, PROBES = 1 << 24, 3


def _probes(slen: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """(class, probe): the bits of classes."""
    with np.errstate(over="ignore"):
        key = mix64(slen.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hist.astype(np.int64).view(np.uint64))
        return np.stack([mix64(key + np.uint64(k)) % np.uint64(FILTER_BITS) for k in range(PROBES)], 1)


def class_filter(classes: DataFrame) -> np.ndarray:
    """A bit for each probe of each class (slen, hist): tasks set bits, words of 64 bits are combined, and the filter, of one size whatever the classes, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for b in batches:
            p = _probes(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)).reshape(-1)
            np.bitwise_or.at(bits, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.nonzero(bits)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], ["at", "bits"])

    got = classes.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _passes(bits: np.ndarray, slen: np.ndarray, hist: np.ndarray) -> np.ndarray:
    p = _probes(slen, hist)
    return ((bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _level1(held=None):
    """(id, slen, hist); with a filter given, of what passes it and with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [cheap_invariants(t) for t in b.column(1).to_pylist()]
            slen, hist = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
            cols, names = [b.column(0), pa.array(slen), pa.array(hist)], ["id", "slen", "hist"]
            if held is not None:
                cols.append(b.column(1))
                names.append("text")
                keep = pa.array(_passes(held.value, slen, hist)) if len(pairs) else pa.array([], pa.bool_())
                cols = [c.filter(keep) for c in cols]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _level2(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [costly_key(t, min_words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], ["id", "key"])

    return run


def fold_copies(df: DataFrame, id_col: str, text_col: str, min_words: int = 8) -> DataFrame:
    """Members of formatting-copy groups: (id, keep_id, n_copies), one row per different id.

    ``keep_id`` is the smallest id of the group and ``n_copies`` the number of different ids in it;
    records without a copy are not returned. Null texts and texts under ``min_words`` words have no
    copies. Redelivered rows (same id) count once. An empty table gives no rows; other columns of
    ``df`` are ignored, whatever their names. Ids must be integers; null ids are dropped.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    src = src.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    level1 = src.mapInArrow(_level1(), "id long, slen long, hist long")
    classes = (
        level1.groupBy("slen", "hist")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        .where("lo < hi")
        .select("slen", "hist")
    )
    classes = stage(classes, "p5-classes")
    held = df.sparkSession.sparkContext.broadcast(class_filter(classes))
    inside = src.mapInArrow(_level1(held), "id long, slen long, hist long, text string").join(
        classes, ["slen", "hist"], "left_semi"
    )
    keyed = stage(
        inside.select("id", "text").mapInArrow(_level2(min_words), "id long, key binary").where("key is not null").distinct(),
        "p5-keys",
    )
    groups = keyed.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return keyed.join(groups, "key").select("id", "keep_id", "n_copies")
