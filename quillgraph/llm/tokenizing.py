"""Problem 8: token ids of a public byte-level BPE tokenizer, by prefix-sharing trie traversal.

The encoding of a word is determined by the last token of each of its prefixes: the last token of
a prefix is the one token that ends there, is compatible with the last token of what stands before
it (the two encode to themselves when joined), and so on back to the start. The distinct words of
an Arrow batch are visited in byte order, which is the depth-first order of their trie; the stack
of prefix states is kept up to the common prefix with the word before, so states of a shared prefix
are computed once. Words seen before come from a bounded table of the worker.

The job is one map over the rows: nothing is shuffled, broadcast or collected.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, "TrieEncoder"] = {}


class TrieEncoder:
    """Encoder of one vocabulary; a worker keeps one for each vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 400_000):
        self.ranks, self.memo = ranks, memo
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[int, bool] = {}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT)

    @classmethod
    def of(cls, path: str) -> "TrieEncoder":
        if path not in _ENCODERS:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            _ENCODERS[path] = cls(ranks)
        return _ENCODERS[path]

    def merges(self, raw: bytes) -> list[int]:
        """Plain merging by rank of a short byte string; decides compatibility and nothing else."""
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[key] = self.merges(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def walk(self, words: list[str]) -> None:
        """Fill ``seen`` for new words, depth first over their trie."""
        ranks, longest, compatible = self.ranks, self.longest, self.compatible
        last: list[int] = []  # last token of the prefix of length k + 1
        before = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, upto = 0, min(len(raw), len(before))
            while shared < upto and raw[shared] == before[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(raw) + 1):
                for start in range(max(0, end - longest), end):
                    t = ranks.get(raw[start:end])
                    if t is not None and (start == 0 or compatible(last[start - 1], t)):
                        last.append(t)
                        break
                else:
                    raise ValueError(f"the vocabulary has no encoding of {raw[:end]!r}")
            ids, end = [], len(raw)
            while end:
                ids.append(last[end - 1])
                end -= len(self.bytes_of[last[end - 1]])
            self.seen[word] = tuple(reversed(ids))
            before = raw

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split.findall(t) if t else [] for t in texts]
        if len(self.seen) > self.memo:
            self.seen.clear()
        seen = self.seen
        self.walk(list({w for ws in split for w in ws} - seen.keys()))
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += seen[w]
            out.append(ids)
        return out


def encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary
    text. Rows are neither merged nor dropped, so repeated rows stay repeated. Texts of any length
    are encoded whole. ``ranks_path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TrieEncoder.of(ranks_path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = enc.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, ids array<int>")
