"""Relations of the engine over the test tables; each has the SQL of the same relation beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(path, filename, class_name, symbols, body, kind) of ``documents``; nulls become empty."""
    t = table(spark, d, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md"))
    empty = F.lit("")
    return t.select(
        F.concat_ws("/", F.coalesce("repo", empty), F.coalesce("kind", empty), name).alias("path"),
        name.alias("filename"),
        F.coalesce("title", empty).alias("class_name"),
        F.coalesce("source", empty).alias("symbols"),
        F.coalesce("text", empty).alias("body"),
        F.coalesce("kind", empty).alias("kind"),
    )


DOCS = """docs AS (SELECT concat_ws('/', coalesce(repo, ''), coalesce(kind, ''), 'doc' || doc_id || '.md') AS path, 'doc' || doc_id || '.md' AS filename,
  coalesce(title, '') AS class_name, coalesce(source, '') AS symbols, coalesce(text, '') AS body, coalesce(kind, '') AS kind FROM documents)"""


def follow_edges(spark: SparkSession, d: str, least_quantity: int = 25) -> DataFrame:
    """(src_key, dst_key, type): parts of an order in line order, each an edge to the next.

    The lines of an order are at most a handful, so the window never holds a large group.
    """
    lines = table(spark, d, "lineitem").where(F.col("l_quantity") >= least_quantity)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "signal").otherwise("var")
    steps = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), kind.alias("type")).where("dst is not null and src <> dst").distinct()
    parts = table(spark, d, "part").select("p_partkey", part_key().alias("key"))
    return (
        steps.join(parts.select(F.col("p_partkey").alias("src"), F.col("key").alias("src_key")), "src")
        .join(parts.select(F.col("p_partkey").alias("dst"), F.col("key").alias("dst_key")), "dst")
        .select("src_key", "dst_key", "type")
    )


def part_file():
    """Path of the file that stands for a part: several parts of a brand share one."""
    return F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("/f"), F.col("p_partkey") % 97, F.lit(".gd"))


def part_key():
    """Node key of a part, ``file::name``."""
    return F.concat(part_file(), F.lit("::p"), F.col("p_partkey"))


EDGES = """parts AS (SELECT p_partkey, replace(p_brand, '#', '') || '/f' || (p_partkey % 97) || '.gd' AS file, replace(p_brand, '#', '') || '/f' || (p_partkey % 97) || '.gd::p' || p_partkey AS key,
  p_brand, p_type, p_size, p_name FROM part),
steps AS (SELECT DISTINCT src, dst, type FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
  CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'signal' ELSE 'var' END AS type FROM lineitem WHERE l_quantity >= 25) WHERE dst IS NOT NULL AND src <> dst),
edges AS (SELECT a.key AS src_key, b.key AS dst_key, type FROM steps JOIN parts a ON a.p_partkey = src JOIN parts b ON b.p_partkey = dst)"""


def part_symbols(spark: SparkSession, d: str) -> DataFrame:
    """(path, name, key, line, class_name, size): every part as a function of its file."""
    return table(spark, d, "part").select(
        part_file().alias("path"), F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), part_key().alias("key"),
        F.floor(F.col("p_partkey") / 97).cast("int").alias("line"), F.col("p_type").alias("class_name"), F.col("p_size").alias("size"),
    )


def part_membership(spark: SparkSession, d: str, without: str = "Brand25", tests: str = "Brand11") -> DataFrame:
    """(path, cluster): a brand's files are one cluster; those of ``without`` are in none, ``tests`` is called so."""
    brand = F.regexp_replace("p_brand", "#", "")
    return (
        table(spark, d, "part").select(part_file().alias("path"), F.when(brand == tests, "tests").otherwise(brand).alias("cluster"))
        .where(F.col("cluster") != without).distinct()
    )


MEMBERSHIP = """membership AS (SELECT DISTINCT file AS path, CASE WHEN replace(p_brand, '#', '') = 'Brand11' THEN 'tests' ELSE replace(p_brand, '#', '') END AS cluster
  FROM parts WHERE replace(p_brand, '#', '') <> 'Brand25')"""


def functions(spark: SparkSession, d: str) -> DataFrame:
    """(func_id, repo, path, name, line, body, params, ret, kind): ``funcs`` without redelivered rows.

    The delivery that came first is kept; the choice doesn't matter as the content is the same.
    """
    return table(spark, d, "funcs").drop("indexed_at", "ingested_at").dropDuplicates(["func_id"])


FUNCS = "fn AS (SELECT DISTINCT ON (func_id) func_id, repo, path, name, line, body, params, ret, kind, writes FROM funcs)"


def live_files(spark: SparkSession, d: str) -> DataFrame:
    """``files`` without redelivered and removed rows."""
    return table(spark, d, "files").where("removed_at is null").drop("ingested_at").dropDuplicates(["file_id"])


FILES = "lf AS (SELECT DISTINCT ON (file_id) * FROM files WHERE removed_at IS NULL)"
