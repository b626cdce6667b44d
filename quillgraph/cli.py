"""Commands over a source tree and its store: rescan, search, find, count, export-base, import-base, drop.

    python -m quillgraph.cli rescan ROOT STORE [--suffixes .py,.gd]
    python -m quillgraph.cli search STORE "words of a question" [-n 8]
    python -m quillgraph.cli find STORE PATTERN [--glob '*.py']
    python -m quillgraph.cli count|drop|crosstalk STORE
    python -m quillgraph.cli export-base|import-base STORE FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.parsing import parse_sources
from quillgraph.operators import recall as R
from quillgraph.operators import textsearch as S
from quillgraph.operators.changes import rescan as diff
from quillgraph.sources.code_tree import read_tree
from quillgraph.sources.collections import Collection, export_shards, import_shards
from quillgraph.sources.predicates import guard_store

STAMP = {"shape": "source-1"}


def store_of(spark: SparkSession, path: str) -> Collection:
    return Collection(spark, path, STAMP, "path")


def rescan(spark: SparkSession, root: str, store: str, suffixes: str = "") -> dict[str, int]:
    """Bring the store up to the tree; unchanged trees leave it as it is. Returns the actions with their counts."""
    tree = read_tree(spark, root, suffixes=suffixes).persist()
    col = store_of(spark, store)
    old = col.read()
    n = tree.count()
    if n == 0:
        guard_store(0, 0)
    acts = diff(old if old is not None else tree.limit(0), tree, ["path"]).persist()
    counts = {r["action"]: r["count"] for r in acts.groupBy("action").count().collect()}
    if old is None:
        col.replace(tree)
    elif set(counts) - {"unchanged"}:
        changed = acts.where("action in ('added', 'updated', 'touched')").select("path")
        col.upsert(tree.join(changed, "path", "left_semi"), live=tree.select("path"))
    acts.unpersist()
    tree.unpersist()
    return counts


def documents(rows: DataFrame) -> DataFrame:
    """Stored sources as (path, filename, class_name, symbols, body) for ranking."""
    ids = rows.withColumn("id", F.xxhash64("path"))
    found = parse_sources(ids, "id", "ext", "text")
    names = found.where("kind in ('func', 'type')").groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "type", F.col("name")))), " ").alias("class_name"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "func", F.col("name")))), " ").alias("symbols"),
    )
    return ids.join(names, "id", "left").select("path", F.substring_index("path", "/", -1).alias("filename"), F.coalesce("class_name", F.lit("")).alias("class_name"), F.coalesce("symbols", F.lit("")).alias("symbols"), F.coalesce("text", F.lit("")).alias("body"))


def search(spark: SparkSession, store: str, text: str, n: int = 8) -> DataFrame:
    """The first ``n`` (1 to 25) sources for a question; empty for an empty store."""
    rows = store_of(spark, store).read()
    if rows is None:
        return spark.createDataFrame([], "path string, bm25 double, rank int")
    got = R.ranked(R.bm25f(documents(rows), {"q": text}), "bm25", ["q"], "path")
    return got.where(F.col("rank") <= min(25, max(1, n))).select("path", "bm25", "rank").orderBy("rank")


def crosstalk(spark: SparkSession, store: str) -> DataFrame:
    """(x, y, calls) between top-level folders of the stored sources: calls of a name that one file of another folder alone declares."""
    rows = store_of(spark, store).read()
    if rows is None:
        return spark.createDataFrame([], "x string, y string, calls long")
    ids = rows.withColumn("id", F.xxhash64("path"))
    found = parse_sources(ids, "id", "ext", "text").join(ids.select("id", F.substring_index("path", "/", 1).alias("top"), "path"), "id")
    only = found.where("kind = 'func'").groupBy("name").agg(F.min("path").alias("p"), F.min("top").alias("y"), F.countDistinct("path").alias("n")).where("n = 1")
    calls = found.where("kind = 'call'").select("path", F.col("top").alias("x"), "name").distinct().join(only, "name").where("x <> y")
    return calls.groupBy("x", "y").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "x", "y")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["rescan", "search", "find", "count", "drop", "crosstalk", "export-base", "import-base"])
    p.add_argument("args", nargs="+")
    p.add_argument("-n", type=int, default=8)
    p.add_argument("--glob")
    p.add_argument("--suffixes", default="")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if a.command == "rescan":
        print(rescan(spark, a.args[0], a.args[1], a.suffixes))
        return 0
    col = store_of(spark, a.args[0])
    rows = col.read()
    if a.command == "search":
        search(spark, a.args[0], a.args[1], a.n).show(25, False)
    elif a.command == "count":
        print(0 if rows is None else rows.count())
    elif a.command == "drop":
        col.drop()
    elif a.command == "crosstalk":
        crosstalk(spark, a.args[0]).show(60, False)
    elif a.command == "import-base":
        if rows is not None:
            raise SystemExit("import needs an empty store")
        col.replace(import_shards(spark, a.args[1], id_col="path"))
    elif rows is None:
        print("the store is empty")
        return 1
    elif a.command == "export-base":
        export_shards(rows, a.args[1], "path")
    else:
        docs = rows.select("path", F.col("text").alias("body"))
        bad = S.bad_pattern(docs, a.args[1])
        if bad:
            print(bad)
            return 1
        S.search_text(docs, a.args[1], a.glob).show(60, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
