"""Line search with honest totals, windows of lines, mention counts, censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import glob_regex, mentions
from quillgraph.session import stage

#: Caps of the answer; totals are always those of the whole corpus.
MAX_FILES, MAX_LINES, MAX_CHARS = 20, 3, 200


def lines(docs: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(path, line, text), lines from 1, line ends of any kind, no empty last line."""
    parts = F.split(F.coalesce(F.col(body), F.lit("")), r"\r\n|\n|\r")
    return docs.select(F.col(path).alias("path"), F.posexplode(parts).alias("k", "text"), F.size(parts).alias("n")).where(
        (F.col("text") != "") | (F.col("k") < F.col("n") - 1)
    ).select("path", (F.col("k") + 1).alias("line"), "text")


def bad_pattern(docs: DataFrame, pattern: str) -> str | None:
    """What to answer instead of rows for an empty or invalid pattern."""
    if not pattern:
        return "empty pattern"
    try:
        docs.sparkSession.range(1).select(F.lit("x").rlike(pattern)).collect()
    except Exception:
        return f"invalid pattern: {pattern}"
    return None


def matching_lines(docs: DataFrame, pattern: str, glob: str | None = None) -> DataFrame:
    """Lines that match a regular expression, of the paths that match a glob."""
    if glob:
        docs = docs.where(F.col("path").rlike(glob_regex(glob)))
    return lines(docs).where(F.col("text").rlike(pattern))


def search_text(docs: DataFrame, pattern: str, glob: str | None = None, max_files: int = MAX_FILES, max_lines: int = MAX_LINES) -> DataFrame:
    """First lines of the first files that match, with the true totals beside each row.

    The corpus is read once, for its matches; the totals come from an aggregate per file, so no window
    runs over all matches.
    """
    hits = stage(matching_lines(docs, pattern, glob), "hits")
    per = hits.groupBy("path").agg(F.count("*").alias("in_file"))
    total = per.agg(F.sum("in_file").alias("n_matches"), F.count("*").alias("n_files"))
    first = per.orderBy("path").limit(max_files)
    w = Window.partitionBy("path").orderBy("line")
    rows = hits.join(F.broadcast(first), "path").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_lines)
    cut = F.when(F.length("text") > MAX_CHARS, F.concat(F.substring("text", 1, MAX_CHARS), F.lit("…"))).otherwise(F.col("text"))
    one = total.select(F.lit(1).alias("one"), "n_matches", "n_files")
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").select("path", "line", cut.alias("text"), "in_file", "n_matches", "n_files")


def search_files(docs: DataFrame, pattern: str, glob: str | None = None) -> DataFrame:
    return matching_lines(docs, pattern, glob).groupBy("path").agg(F.count("*").alias("in_file"))


def line_window(docs: DataFrame, path: str, start: int, end: int, max_chars: int, max_lines: int = 100) -> DataFrame:
    """Numbered lines start..end of one file, cut where the running size passes ``max_chars``."""
    got = lines(docs.where(F.col("path") == path)).where(F.col("line").between(start, min(end, start + max_lines - 1)))
    shown = got.withColumn("shown", F.concat_ws("\t", F.col("line").cast("string"), "text"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shown.withColumn("used", F.sum(F.length("shown") + 1).over(w)).where(F.col("used") <= max_chars).select("line", "shown", "used")


def mention_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(mentions(F.col("body"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def suffix_census(files: DataFrame) -> DataFrame:
    """Files by lower-cased suffix, or by whole name where there is none."""
    name = F.substring_index("path", "/", -1)
    suffix = F.regexp_extract(F.lower(name), r"(\.[^.]+)$", 1)
    return files.groupBy(F.coalesce(F.nullif(suffix, F.lit("")), name).alias("suffix")).agg(F.count("*").alias("n"))
