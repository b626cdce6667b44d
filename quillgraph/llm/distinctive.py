"""Problem 6: how characteristic a term is of a record, by divergence from randomness.

All scores come from the same two aggregates, term counts per record and record counts per term:

* ``dfr``: information content of the length-normalised frequency under the geometric
  (Bose-Einstein limit) model of the collection, times the Laplace after-effect gain;
* ``ctfidf``: f/n times ln(1 + K/df), the score by which clusters are labelled here.

Both are sums of map-side combined counts, so a record or term with a third of all rows is safe.
The driver reads two numbers, the count of groups and their mean length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_terms(name: Column, least: int = 3) -> Column:
    """Terms of an identifier: parts after ``_``, ``-``, blanks and camel humps, lower-cased,
    without those shorter than ``least`` and those all digits. Null gives an empty array."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[_-]", " "), r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda t: (F.length(t) >= least) & ~t.rlike(r"^\p{Nd}+$"))


def term_scores(members: DataFrame, group: str, keys: list[str], name: str, c: float = 1.0) -> DataFrame:
    """(group, term, f, n, df, k, ctfidf, dfr) for every term of every group.

    Members are distinct by ``keys`` within the group; of repeated rows the largest name counts. Null
    and empty names have no terms but their group counts in ``k``. Rows with a null group are dropped.
    An empty table gives no rows.
    """
    src = members.where(F.col(group).isNotNull())
    base = src.groupBy(F.col(group).alias("grp"), *[F.col(k).alias(f"key{j}") for j, k in enumerate(keys)]).agg(F.max(name).alias("name"))
    tf = base.select("grp", F.explode(name_terms(F.col("name"))).alias("term")).groupBy("grp", "term").agg(F.count("*").alias("f"))
    n = tf.groupBy("grp").agg(F.sum("f").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("coll_f"))
    total = src.agg(F.countDistinct(group).alias("k")).first()["k"]
    mean = n.agg(F.avg("n").alias("m")).first()["m"] or 0.0
    joined = tf.join(n, "grp").join(df, "term").withColumn("k", F.lit(total))
    tfn = F.col("f") * F.log2(1 + F.lit(c * mean) / F.col("n"))
    lam = F.col("coll_f") / F.col("k")
    info = F.log2(1 + lam) + tfn * F.log2((1 + lam) / lam)
    return joined.select(
        F.col("grp").alias(group), "term", "f", "n", "df", "k",
        (F.col("f") / F.col("n") * F.log1p(F.col("k") / F.col("df"))).alias("ctfidf"),
        (info / (tfn + 1)).alias("dfr"),
    )


def top_terms(scores: DataFrame, group: str, score: str, top: int, digits: int = 9) -> DataFrame:
    """The ``top`` terms of each group by the rounded score, ties by term ascending."""
    w = Window.partitionBy(group).orderBy(F.desc("rounded"), F.asc("term"))
    ranked = scores.withColumn("rounded", F.round(score, digits)).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top)
