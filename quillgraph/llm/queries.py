"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.distinctive import term_scores, top_terms
from quillgraph.llm.folding import fold_copies
from quillgraph.llm.languages import KernelModel, document_labels, label_paragraphs, named_language, train
from quillgraph.llm.leakage import leaked_items
from quillgraph.llm.neighbours import similar_vectors
from quillgraph.llm.similar import SimilarSets, similar_sets
from quillgraph.llm.splitting import split_oversized
from quillgraph.llm.syntax import broken_rates, broken_sources
from quillgraph.llm.tokenizing import encode


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _p1(s: SparkSession, d: str) -> SimilarSets:
    return similar_sets(_t(s, d, "funcs"), "func_id", "body", threshold=0.7, width=3, least=20)


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return _p1(s, d).pairs().select(F.col("a").alias("func_a"), F.col("b").alias("func_b"))


def p1_classes(s: SparkSession, d: str) -> DataFrame:
    """At the default of five words and 0.8: one row per function with its class of equal sets and its links."""
    return similar_sets(_t(s, d, "funcs"), "func_id", "body").classes().withColumnRenamed("id", "func_id")


def p2_found(s: SparkSession, d: str) -> DataFrame:
    near = similar_vectors(_t(s, d, "vectors"), "vec_id", "embedding", k=6, floor=0.85)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def p2_top(s: SparkSession, d: str) -> DataFrame:
    """The approximate six nearest at any similarity, of every vector whose id is divisible by 100."""
    near = similar_vectors(_t(s, d, "vectors"), "vec_id", "embedding", k=6, asked=F.col("id") % 100 == 0)
    return near.select(F.col("id").alias("vec_id"), "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return fold_copies(_t(s, d, "funcs"), "func_id", "body").where("id <> keep_id").select("keep_id", F.col("id").alias("func_id"))


def p5_counts(s: SparkSession, d: str) -> DataFrame:
    """One row per kept record that has copies, with the number of records it stands for."""
    return fold_copies(_t(s, d, "funcs"), "func_id", "body").where("id = keep_id").select("keep_id", "n_copies")


def _p6(s: SparkSession, d: str) -> DataFrame:
    return term_scores(_t(s, d, "cluster_members"), "cluster_id", ["repo", "path"], "class_name")


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return top_terms(_p6(s, d), "cluster_id", "ctfidf", 3).select("cluster_id", "term")


def p6_dfr(s: SparkSession, d: str) -> DataFrame:
    """Divergence from randomness of every term of every cluster."""
    return _p6(s, d).select("cluster_id", "term", "f", "df", F.round("dfr", 6).alias("dfr"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return split_oversized(_t(s, d, "funcs"), "func_id", "body", "line").withColumnRenamed("id", "func_id")


def p7_balanced(s: SparkSession, d: str) -> DataFrame:
    """The same texts cut by the least sum of penalties and size imbalance."""
    return split_oversized(_t(s, d, "funcs"), "func_id", "body", "line", objective="balanced").withColumnRenamed("id", "func_id")


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return encode(_t(s, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leaked_items(_t(s, d, "documents"), "doc_id", "text", _t(s, d, "eval_items"), "item_id", "text")


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return broken_sources(_t(s, d, "raw_sources"), "file_id", "text", "ext").where("broken").select(F.col("id").alias("file_id")).distinct()


def p4_rates(s: SparkSession, d: str) -> DataFrame:
    return broken_rates(_t(s, d, "raw_sources"), "file_id", "text", "ext", "repo")


_MODELS: dict[tuple[str, str], KernelModel] = {}


def _p10(s: SparkSession, d: str) -> DataFrame:
    """The three queries over one folder share the model that the first of them trains in a session."""
    docs, key = _t(s, d, "documents"), (s.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = train(docs, "text", "lang")
    return label_paragraphs(docs, "doc_id", "text", "lang", model=_MODELS[key])


def p10_found(s: SparkSession, d: str) -> DataFrame:
    named = named_language(F.col("label"))
    return _p10(s, d).where(named.isNull() | (named != F.col("lang"))).select(F.col("id").alias("doc_id"), "lang").distinct()


def p10_segments(s: SparkSession, d: str) -> DataFrame:
    """Every paragraph of prose with its language and confidence."""
    return _p10(s, d).select(F.col("id").alias("doc_id"), "paragraph", "lang", "n_words", F.round("confidence", 4).alias("confidence"))


def p10_labels(s: SparkSession, d: str) -> DataFrame:
    """The main language of every document that has prose."""
    return document_labels(_p10(s, d)).select(F.col("id").alias("doc_id"), "lang", F.round("confidence", 4).alias("confidence"), "n_langs")


_P6_TERMS = r"""
m AS (SELECT cluster_id, repo, path, max(class_name) AS name FROM cluster_members WHERE cluster_id IS NOT NULL GROUP BY ALL),
w AS (SELECT cluster_id, unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce(name, ''), '[_-]', ' ', 'g'),
        '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g')), '\s+')) AS term FROM m),
tf AS (SELECT cluster_id, term, count(*) AS f FROM w WHERE length(term) >= 3 AND NOT regexp_full_match(term, '\p{Nd}+') GROUP BY ALL),
n AS (SELECT cluster_id, sum(f)::BIGINT AS n FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(f)::BIGINT AS cf FROM tf GROUP BY ALL),
k AS (SELECT count(DISTINCT cluster_id) AS k, (SELECT avg(n) FROM n) AS mean FROM cluster_members)
"""

_WORDS = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _runs(rows: str, key: str, n: int) -> str:
    """Distinct (key, g) runs of ``n`` words of rows (key, ws)."""
    return f"(SELECT DISTINCT {key}, array_to_string(ws[i:i+{n - 1}], ' ') AS g FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM {rows} WHERE len(ws) >= {n}))"


ORACLE: dict[str, str] = {
    "p1_found": f"""WITH f AS (SELECT DISTINCT func_id, {_WORDS.format(x='body')} AS ws FROM funcs WHERE body IS NOT NULL), s0 AS MATERIALIZED {_runs('f', 'func_id', 3)},
n AS (SELECT func_id, count(*) AS n FROM s0 GROUP BY ALL HAVING count(*) >= 20), s AS MATERIALIZED (SELECT func_id, hash(g) AS g FROM s0 SEMI JOIN n USING (func_id)),
b AS (SELECT x.func_id AS a, y.func_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.func_id < y.func_id GROUP BY ALL)
SELECT a AS func_a, b AS func_b FROM b JOIN n p ON p.func_id = a JOIN n q ON q.func_id = b WHERE k >= 0.7 * (p.n + q.n - k)""",
    "p2_found": """WITH v AS (SELECT DISTINCT vec_id AS id, embedding::DOUBLE[] AS e FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS MATERIALIZED (SELECT id, list_transform(e, lambda x: x / n)::DOUBLE[64] AS w FROM (SELECT id, e, sqrt(list_inner_product(e, e)) AS n FROM v) WHERE n > 0),
pw AS MATERIALIZED (SELECT a.id AS a, b.id AS b, array_inner_product(a.w, b.w) AS c FROM u a JOIN u b ON a.id <> b.id WHERE array_inner_product(a.w, b.w) >= 0.849999)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS r FROM pw) WHERE r <= 6 AND c >= 0.85""",
    "p9_found": f"""WITH i AS (SELECT item_id, {_WORDS.format(x='text')} AS ws FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_WORDS.format(x='text')} AS ws FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM {_runs('d', 'doc_id', 12)} x JOIN {_runs('i', 'item_id', 12)} y USING (g)""",
    "p6_found": f"""WITH {_P6_TERMS}
SELECT cluster_id, term FROM (
  SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY round(f / n * ln(1 + k / df), 9) DESC, term) AS r
  FROM tf JOIN n USING (cluster_id) JOIN df USING (term), k) WHERE r <= 3""",
    "p6_dfr": f"""WITH {_P6_TERMS}
SELECT cluster_id, term, f, df, round((log2(1 + cf / k) + tfn * log2((1 + cf / k) / (cf / k))) / (tfn + 1), 6) AS dfr
FROM (SELECT *, f * log2(1 + mean / n) AS tfn FROM tf JOIN n USING (cluster_id) JOIN df USING (term), k)""",
    "p5_found": r"""WITH f AS (SELECT DISTINCT func_id, list_sort(list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS ws
  FROM funcs WHERE body IS NOT NULL)
SELECT keep_id, func_id FROM (SELECT func_id, min(func_id) OVER (PARTITION BY ws) AS keep_id FROM f WHERE len(ws) >= 8) WHERE keep_id <> func_id""",
    "p5_counts": r"""WITH f AS (SELECT DISTINCT func_id, list_sort(list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS ws
  FROM funcs WHERE body IS NOT NULL)
SELECT min(func_id) AS keep_id, count(*) AS n_copies FROM f WHERE len(ws) >= 8 GROUP BY ws HAVING count(*) > 1""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_classes, p2_found, p2_top, p4_found, p4_rates, p5_found, p5_counts, p6_found, p6_dfr, p7_found, p7_balanced, p8_ids, p9_found, p10_found, p10_segments, p10_labels)
}
