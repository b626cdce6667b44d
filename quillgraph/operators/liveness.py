"""Dead code by reachability and mentions, exact duplicates of normalised bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import file_ext, is_delegate, normal_body
from quillgraph.session import stage

#: Weights of the tiers in the share of a file, and the share from which a file counts as dead.
LIKELY, REVIEW, DEAD_SHARE = 1.0, 0.5, 0.4


def dead_shares(dead: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, share, dead): weighted share of dead symbols of each file that has any."""
    weight = F.sum(F.when(F.col("tier") == "likely", LIKELY).otherwise(REVIEW))
    n = symbols.groupBy("path").agg(F.count("*").alias("n"))
    s = dead.groupBy("path").agg(weight.alias("w")).join(n, "path").withColumn("share", F.round(F.col("w") / F.col("n"), 4))
    return s.select("path", "share", (F.col("share") >= DEAD_SHARE).alias("dead"))


def duplicate_members(functions: DataFrame, least_lines: int = 3) -> DataFrame:
    """(hash, func_id, n, delegate): members of groups of one normalised body of ``least_lines`` lines or more.

    A group whose first member only forwards is marked, to be counted and not shown. Only digests and ids are shuffled, redelivered
    rows are dropped among those, and a group of any size stays a set of rows.
    """
    ext = file_ext(F.col("path"))
    norm = functions.where("body is not null").select("func_id", ext.alias("ext"), normal_body(F.col("body"), ext).alias("norm"))
    # One value per id out of an aggregate: the filter then can't move below it and normalise each body twice.
    facts = F.max(F.struct(F.size(F.split("norm", "\n")).alias("lines"), F.sha1(F.encode("norm", "UTF-8")).alias("hash"), is_delegate(F.col("norm"), F.col("ext")).alias("delegate")))
    hashed = norm.groupBy("func_id").agg(facts.alias("f")).where(F.col("f.lines") >= least_lines).select("func_id", "f.hash", "f.delegate")
    hashed = stage(hashed, "body-hashes")
    n = hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min_by("delegate", "func_id").alias("delegate")).where("n >= 2")
    return hashed.drop("delegate").join(n, "hash").select(F.substring("hash", 1, 8).alias("hash"), "func_id", "n", "delegate")
