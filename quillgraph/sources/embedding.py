"""Embedding of texts by a client: batches, cut texts, waits after refusals, and failures as data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import cosine, failure_reason

#: Texts of a call, characters of a text, waits in seconds, and the longest wait a server may ask for.
BATCH, MAX_CHARS, WAITS, LONGEST_WAIT = 32, 30_000, (1.0, 2.0, 4.0), 60.0


class RateLimited(Exception):
    """The client was refused for now; ``retry_after`` is in seconds, None if the server doesn't say."""

    def __init__(self, retry_after: float | None = None):
        super().__init__("429 rate limited")
        self.retry_after = retry_after


def embed(df: DataFrame, id_col: str, text_col: str, make_client: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, embedding, reason): one row per row; ``reason`` says why there is no embedding.

    ``make_client`` is called once a task. Null texts count as empty. A refused call is tried again after
    the given waits; a call that fails otherwise gives its rows a reason and the rest goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for b in batches:
            ids, texts = b.column(0), [(t or "")[:MAX_CHARS] for t in b.column(1).to_pylist()]
            vecs: list = []
            why: list = []
            for s in range(0, len(texts), batch):
                part = texts[s : s + batch]
                got, said = None, None
                for wait in (*WAITS, None):
                    try:
                        got = client(part)
                        break
                    except RateLimited as e:
                        said = str(e)
                        if wait is None:
                            break
                        sleep(min(LONGEST_WAIT, e.retry_after if e.retry_after is not None else wait))
                    except Exception as e:
                        said = str(e) or type(e).__name__
                        break
                vecs += got if got is not None else [None] * len(part)
                why += [None if got is not None else said] * len(part)
            yield pa.RecordBatch.from_arrays([ids, pa.array(vecs, pa.list_(pa.float32())), pa.array(why, pa.string())], ["id", "embedding", "why"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, embedding array<float>, why string")
    return out.select("id", "embedding", F.when(F.col("why").isNotNull(), failure_reason(F.col("why"))).alias("reason"))


def incoherent(stored: DataFrame, again: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, cos) of stored vectors (id, embedding) that a new embedding of the same text doesn't resemble."""
    both = stored.select("id", F.col("embedding").alias("a")).join(again.select("id", F.col("embedding").alias("b")), "id")
    return both.select("id", cosine(F.col("a"), F.col("b")).alias("cos")).where(F.col("cos").isNull() | (F.col("cos") < least))
