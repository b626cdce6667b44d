"""Lexical ranking over weighted fields, rank fusion, graph boost and evidence flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import B, FIELD_WEIGHTS, K1, recall_tokens
from quillgraph.operators.vectors import hashed_vectors, knn
from quillgraph.session import release, stage

#: Fixed values of the fusion and of the evidence floors.
RRF_K, BOOST, FLOOR_COS, FLOOR_BM25 = 30, 0.25, 0.48, 6.0


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("path", *[recall_tokens(F.col(f)).alias(f"t_{f}") for f in FIELD_WEIGHTS])


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(path, wlen) of the documents that have a token; no token is exploded for it."""
    total = sum((F.size(f"t_{f}") * F.lit(w) for f, w in FIELD_WEIGHTS.items()), F.lit(0.0))
    return _tokens(docs).select("path", total.alias("wlen")).where("wlen > 0")


def _weighted(terms: list[str] | None) -> Column:
    """Array of (term, w) over all fields; only ``terms`` if given."""

    def of(f: str, w: float) -> Column:
        col = F.col(f"t_{f}")
        if terms is not None:
            col = F.filter(col, lambda t: t.isin(*terms))
        return F.transform(col, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    return F.flatten(F.array(*[of(f, w) for f, w in FIELD_WEIGHTS.items()]))


def query_postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(path, wlen, hits) of every document, from one pass over the texts; hits are of ``terms`` only.

    Documents without a token have length 0; a filter here would move below and split each text twice.
    """
    total = sum((F.size(f"t_{f}") * F.lit(w) for f, w in FIELD_WEIGHTS.items()), F.lit(0.0))
    return _tokens(docs).select("path", total.alias("wlen"), _weighted(terms).alias("hits"))


def postings(docs: DataFrame) -> DataFrame:
    """(path, term, wtf): weighted frequency of every term."""
    return _tokens(docs).select("path", F.explode(_weighted(None)).alias("x")).groupBy("path", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("wtf"))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, idf) of the whole vocabulary."""
    n = doc_lengths(docs).count()
    return postings(docs).groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.col("df"), F.lit(n)))


def query_terms(spark, queries: dict[str, str]) -> DataFrame:
    """(q, term, mult): tokens of each query with their number."""
    rows = spark.createDataFrame(list(queries.items()), "q string, text string")
    return rows.select("q", F.explode(recall_tokens(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("mult"))


def bm25f(docs: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(q, path, bm25) of every document with a positive score, for a stated set of queries.

    The driver reads the terms of the queries (stated by the caller) and two corpus numbers. The texts
    are read and split into tokens once; what is kept of them is a length and the hits of the query terms. An empty corpus or query gives no rows.
    """
    spark = docs.sparkSession
    q = query_terms(spark, queries)
    terms = sorted({r["term"] for r in q.collect()})
    if not terms:
        return spark.createDataFrame([], "q string, path string, bm25 double")
    once = stage(query_postings(docs, terms), "postings").where("wlen > 0")
    n, avg = once.agg(F.count("*"), F.avg("wlen")).first()
    if not n:
        return spark.createDataFrame([], "q string, path string, bm25 double")
    post = once.select("path", "wlen", F.explode("hits").alias("x")).groupBy("path", "wlen", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("wtf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    scored = (
        post.join(F.broadcast(q.join(df, "term")), "term")
        .withColumn("s", F.col("mult") * idf(F.col("df"), F.lit(n)) * F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("wlen") / avg)))
    )
    return scored.groupBy("q", "path").agg(F.sum("s").alias("bm25")).where("bm25 > 0")


def ranked(scores: DataFrame, score: str, by: list[str], key: str, digits: int = 6) -> DataFrame:
    """Rank from 1 by the rounded score, ties by key; the round makes order and output agree."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return scores.withColumn(score, F.round(score, digits)).withColumn("rank", F.row_number().over(w))


Embed = Callable[[DataFrame, str, Column], DataFrame]


def nearest(rows: DataFrame, text: Column, queries: dict[str, str], top: int = 40, embed: Embed = hashed_vectors, key: str = "path") -> DataFrame:
    """(q, key, cos, rank): the ``top`` nearest rows of each query by the vectors of their texts, exact; ties by key.

    ``embed`` turns (rows, key, text) into (key, embedding). Rows are numbered in the order of their keys, so that ties at
    the cut go by key too.
    """
    spark = rows.sparkSession
    number = {q: -k for k, q in enumerate(queries, 1)}
    asked = embed(spark.createDataFrame([(str(number[q]), t) for q, t in queries.items()], "id string, text string").coalesce(1), "id", F.col("text"))
    made = stage(embed(rows, key, text), "embedded")  # the sort below reads it twice, to find its ranges first
    held = stage(made.sort(key).withColumn("id", F.monotonically_increasing_id()), "numbered")
    release(made)
    near = knn(asked.select(F.col("id").cast("long").alias("id"), "embedding"), held.select("id", "embedding"), top)
    who = spark.createDataFrame([(k, q) for q, k in number.items()], "asked long, q string")
    found = near.join(F.broadcast(who), near.q == who.asked).select(who.q, "id", F.col("sim").alias("cos"))
    return ranked(found.join(held.select("id", key), "id").select("q", key, "cos"), "cos", ["q"], key)


def vector_side(docs: DataFrame, queries: dict[str, str], embed: Embed = hashed_vectors, top: int = 40) -> DataFrame:
    """(q, path, cos, rank): the nearest documents of each query by titles, sources and texts."""
    return nearest(docs, F.concat_ws("\n", "class_name", "symbols", "body"), queries, top, embed)


def rrf(sides: list[tuple[str, DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Fuse ranked sides (tag, (q, path, rank), weight): sum of w / (k + rank), and which kinds of sides knew the document."""
    every = None
    for tag, df, w in sides:
        part = df.select("q", "path", (F.lit(w) / (k + F.col("rank"))).alias("s"), F.lit(tag).alias("side"))
        every = part if every is None else every.unionByName(part)
    names = F.array_sort(F.collect_set("side"))
    return every.groupBy("q", "path").agg(F.sum("s").alias("score"), F.when(F.size(names) > 1, "both").otherwise(names[0]).alias("src"))


def graph_boost(fused: DataFrame, wires: DataFrame, top: int, lam: float = BOOST, k: int = RRF_K) -> DataFrame:
    """Neighbours of the first ``top`` documents gain lam / (k + 1) / (position + 1), positions from 0."""
    first = ranked(fused, "score", ["q"], "path").where(F.col("rank") <= top)
    near = wires.select("src_file", "dst_file").unionByName(wires.select(F.col("dst_file").alias("src_file"), F.col("src_file").alias("dst_file"))).distinct()
    gain = first.join(near, first.path == near.src_file).select("q", F.col("dst_file").alias("path"), (F.lit(lam) / (k + 1) / F.col("rank")).alias("score"), F.lit("graph").alias("src"))
    own = fused.select("q", "path", "score", "src")
    return own.unionByName(gain).groupBy("q", "path").agg(F.sum("score").alias("score"), F.min(F.when(F.col("src") != "graph", F.col("src"))).alias("s")).select(
        "q", "path", "score", F.coalesce("s", F.lit("graph")).alias("src")
    )


def hop_context(hits: DataFrame, wires: DataFrame, top: int = 3) -> DataFrame:
    """(path, ctx): the ``top`` neighbours of each hit by wires both ways, then path."""
    both = wires.select(F.col("src_file").alias("path"), F.col("dst_file").alias("nb"), "w").unionByName(wires.select(F.col("dst_file").alias("path"), F.col("src_file").alias("nb"), "w"))
    near = both.join(hits.select("path").distinct(), "path").groupBy("path", "nb").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("path").orderBy(F.desc("w"), "nb")
    best = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return best.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "nb"))), lambda x: x.nb).alias("ctx"))


def weak(cos: Column, bm25: Column) -> Column:
    """Whether all evidence of a hit is missing or under its floor."""
    return (F.coalesce(cos, F.lit(-1.0)) < FLOOR_COS) & (F.coalesce(bm25, F.lit(-1.0)) < FLOOR_BM25)


def fold_hits(hits: DataFrame, own: list[str], n: int) -> DataFrame:
    """Hits (q, rank, ...) with the best-ranked one of each ``own`` (the pieces of one function are one), the first ``n`` of a query; ``place`` from 1."""
    one = hits.withColumn("nth", F.row_number().over(Window.partitionBy("q", *own).orderBy("rank"))).where("nth = 1").drop("nth")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("place") <= n)


def first_per_group(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The best row of each group; used to fold the chunks of a function into one hit."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def shortlist(hits: DataFrame, names: int = 4) -> DataFrame:
    """(q, file, score, n, names) of function hits (q, file, name, cos, rank): the files with their best score and first names."""
    first = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return hits.groupBy("q", "file").agg(F.max("cos").alias("score"), F.count("*").alias("n"), F.slice(first, 1, names).alias("names"))


def lexical_fallback(functions: DataFrame, tokens: Column) -> DataFrame:
    """Functions by how many query tokens their name holds, 1 if only path or class hold one."""
    name = F.size(F.filter(tokens, lambda t: F.lower(F.col("name")).contains(t)))
    other = F.exists(tokens, lambda t: F.lower("path").contains(t))
    strength = F.when(name > 0, name).when(other, 1).otherwise(0)
    return functions.withColumn("strength", strength).where("strength > 0").withColumn("score", F.lit(0.5) + 0.1 * F.least("strength", F.lit(5)))
